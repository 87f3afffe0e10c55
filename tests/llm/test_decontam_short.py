"""Short passages with substitutions, against every aligned run."""

import random

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k long, key string, `start` long"


def longest(equal, share):
    """(length, equal tokens) of the best aligned run, by trying all."""
    n = len(equal)
    return max(((b - a, sum(equal[a:b])) for a in range(n) for b in range(a + 1, n + 1) if sum(equal[a:b]) >= share * (b - a)), default=(0, 0))


@pytest.mark.parametrize("share", [0.75, 0.8, 0.5, 1.0])
def test_overlap_is_the_longest_run(share):
    from loomwork.llm.decontam import overlap

    rnd = random.Random(7)
    for _ in range(400):
        equal = [rnd.random() < rnd.choice([0.3, 0.6, 0.8]) for _ in range(rnd.randint(1, 30))]
        first, length, n = overlap(np.array(equal), share)
        assert (length, n) == longest(equal, share) and sum(equal[first : first + length]) == n


def test_short_substituted_passages(spark):
    from loomwork.llm.decontam import MASKS, MIN_SHARE, MIN_TOKENS, drop_contaminated, find_overlaps

    rnd = random.Random(11)
    items, docs, want = [], [], {}

    def plant(size, places):
        i = len(items)
        item = [f"i{i}w{k}" for k in range(size)]
        equal = [k not in places for k in range(size)]
        docs.append([f"d{i}a{k}" for k in range(9)] + [w if e else f"s{i}w{k}" for k, (w, e) in enumerate(zip(item, equal, strict=True))] + [f"d{i}b{k}" for k in range(9)])
        items.append(item)
        seed = any(all(equal[a + j] for j, bit in enumerate(m) if bit == "1") for m in MASKS for a in range(size - len(m) + 1))
        best = longest(equal, MIN_SHARE)
        if seed and best[0] >= min(MIN_TOKENS, size):
            want[i] = best

    plant(14, {3, 10})
    plant(18, {3, 7, 14})
    assert set(want) == {0, 1}
    for size in (12, 16, 20, 30, 40):
        for share in (0.15, 0.2, 0.4):
            for _ in range(20):
                plant(size, {k for k in range(size) if rnd.random() < share})
    assert 50 < len(want) < len(items) - 50
    df = spark.createDataFrame([(i, " ".join(d), "en", "s", 1, 1, "k", 2) for i, d in enumerate(docs)], SCHEMA)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    rows = find_overlaps(spark, df, bench).collect()
    assert all(r.doc_id == r.item_id for r in rows) and {r.doc_id: (r.length, r.equal) for r in rows} == want
    assert {r.doc_id for r in drop_contaminated(spark, df, bench).collect()} == set(range(len(items))) - set(want)
