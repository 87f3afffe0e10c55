"""The distributed difference cover against sorted suffixes and counted windows."""

import random
from collections import Counter

import pytest

from loomwork.llm import difference_cover as dc


@pytest.mark.parametrize("text", ["", "ba", "mississippi", "aaaaaaaaaaaaaaaaa", "random"])
def test_ranks(spark, text):
    rnd = random.Random(2)
    s = [rnd.randrange(3) for _ in range(400)] if text == "random" else [ord(c) for c in text]
    df = spark.createDataFrame(list(enumerate(s)), "i long, c long")
    want = sorted(range(len(s)), key=lambda i: s[i:])
    got = {r.i: r.r for r in dc.suffix_ranks(spark, df, len(s)).collect()}
    assert got == {i: r for r, i in enumerate(want)}


def test_repeated_offsets(spark):
    rnd = random.Random(3)
    base = "".join(rnd.choice("abcdé ") for _ in range(300))
    texts = [base[i : i + 90] for i in rnd.choices(range(210), k=12)] + ["x" * 50, "", None, base[:40], "yz"]
    data = [(t or "").encode() for t in texts]
    df = spark.createDataFrame([(i, None if t is None else bytearray(t.encode())) for i, t in enumerate(texts)], "k long, text binary").repartition(3)
    count = Counter(t[i : i + 20] for t in data for i in range(len(t) - 19))
    want = {(d, i) for d, t in enumerate(data) for i in range(len(t) - 19) if count[t[i : i + 20]] > 1}
    got = [(r.k, r.offset) for r in dc.repeated_offsets(spark, df, 20).collect()]
    assert set(got) == want and len(got) == len(want) and want
    assert dc.repeated_offsets(spark, df.limit(0), 20).count() == 0


def test_dedup_by_the_distributed_way(spark):
    """The same rows as by sorting an anchor's contexts in one worker."""
    from loomwork.llm.suffix import drop_repeats

    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(200)]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [some(25) for _ in range(4)]
    texts = [f"{some(rnd.randrange(3, 30))} {rnd.choice(passages)[rnd.randrange(0, 40):]} {some(rnd.randrange(3, 30))}" for _ in range(30)] + [passages[0], passages[0], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda **k: sorted((r.doc_id, r.n_removed, bytes(r.kept), [tuple(s) for s in r.spans]) for r in drop_repeats(spark, df, 50, **k).collect())
    want = rows()
    assert rows(distributed=True) == want and sum(r[1] for r in want) > 1000
