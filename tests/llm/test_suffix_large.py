"""Suffix sorts of more than 2**21 symbols, and one anchor with thousands of different contexts."""

import hashlib
from collections import Counter

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k long, key string, `start` long"
WINDOW = 400


def windows(text):
    return [hashlib.blake2b(text[i : i + WINDOW], digest_size=8).digest() for i in range(len(text) - WINDOW + 1)]


def test_suffix_array_beyond_21_bits():
    from loomwork.llm.suffix import suffix_array

    s = np.random.default_rng(2).integers(1, 5, 3_600_000)
    s[2_000_000:2_100_000] = s[:100_000]
    order = suffix_array(s)
    rank = np.full(len(s) + 1, -1)
    rank[order] = np.arange(len(s))
    assert (rank[:-1] >= 0).all()
    # neighbours are in order: by the first symbol, then by the rest, whose ranks are known
    a, b = order[:-1], order[1:]
    assert ((s[a] < s[b]) | (s[a] == s[b]) & (rank[a + 1] < rank[b + 1])).all()


def test_many_contexts_of_one_anchor(spark):
    from loomwork.llm.suffix import GRAM, MAX_CONTEXTS, Units, drop_repeats, repeated_starts
    from loomwork.llm.textkit import spans_hash

    rnd = np.random.default_rng(5)
    letters = lambda n: rnd.integers(97, 123, n, np.uint8)
    pool = letters(3_000_000)
    at = np.arange(len(pool) - GRAM)
    best = int(np.argmin(spans_hash(pool, at, at + GRAM)))
    anchor = pool[best : best + GRAM].tobytes()
    data = []
    for i in range(6500):
        left, right = letters(368).tobytes(), letters(200).tobytes()
        if i % 10 == 1:  # shares 450 bytes around the anchor with the text before
            left, right = left[:-300] + data[-1][68:368], data[-1][400:518] + right[118:]
        data.append(left + anchor + right)
    units = Units(data)
    n = max(Counter(units.anchor.tolist()).values())
    assert 6000 < n < MAX_CONTEXTS

    seen = Counter(w for t in data for w in windows(t))
    hit = [np.array([seen[w] > 1 for w in windows(t)]) for t in data]
    joined = b"\n".join(data)
    firsts = np.cumsum([0, *(len(t) + 1 for t in data)])[:-1]
    starts = np.concatenate([f + np.arange(len(h)) for f, h in zip(firsts, hit, strict=True)])
    assert len(joined) > 3_200_000 and sum(h.any() for h in hit) == 1300
    assert (repeated_starts(joined, starts) == np.concatenate(hit)).all()

    df = spark.createDataFrame([(i, t.decode(), "en", "s", 1, 1, "k", 2) for i, t in enumerate(data)], SCHEMA)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in drop_repeats(spark, df).collect()}
    # the hits of a text are one run of windows here
    assert got == {i: [(int(np.flatnonzero(h)[0]), int(np.flatnonzero(h)[-1]) + WINDOW)] if h.any() else [] for i, h in enumerate(hit)}
