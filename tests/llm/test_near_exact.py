"""Near-dedup against the exact similarities: nothing below 0.8 is linked, and no key is too large."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k long, key string, `start` long"


def shingles(text, n=5):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def similar(a, b):
    return len(a & b) / len(a | b)


def changed(rnd, words, k):
    """160 words with k of them replaced, more than a shingle apart: 2: 0.88, 3: 0.82, 4: 0.77, 5: 0.72, 6: 0.68."""
    w = list(words)
    for i in range(k):
        w[8 + 20 * i + rnd.randrange(14)] = f"n{rnd.randrange(10**9)}"
    return w


def test_links_are_similar(spark):
    from loomwork.llm.simhash import drop_near_duplicates

    rnd = random.Random(3)
    out = []
    for g in range(60):
        base = [f"v{rnd.randrange(10**6)}" for _ in range(160)]
        out += [base, changed(rnd, base, (4, 5, 6, 2)[g % 4])]
        if g % 8 == 3:  # near the second only: a chain
            out.append(changed(rnd, out[-1], 2))
    texts = [" ".join(w) for w in out]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 1, "k", 2) for i, t in enumerate(texts)], SCHEMA)
    kept = sorted(r.doc_id for r in drop_near_duplicates(spark, df).collect())
    sets = [shingles(t) for t in texts]
    below = [i for i, s in enumerate(sets) if all(similar(s, x) < 0.8 for x in sets if x is not s)]
    assert len(below) == 90 and set(below) <= set(kept)
    assert kept == [i for i, s in enumerate(sets) if not any(similar(s, x) >= 0.8 for x in sets[:i])]


def test_large_keys_lose_no_pair(spark):
    from loomwork.llm.simhash import WIDE_DISTANCE, groups

    rnd = random.Random(4)
    out = []
    for _ in range(60):
        base = [f"v{rnd.randrange(10**6)}" for _ in range(160)]
        out += [base, changed(rnd, base, 3)]
    df = spark.createDataFrame([(i, " ".join(w), "en", "s", 1, 1, "k", 2) for i, w in enumerate(out)], SCHEMA)
    found = [sorted((r.doc_id, r.component) for r in groups(spark, df, 5, WIDE_DISTANCE, wide=True, max_bucket=n).collect()) for n in (1, 10**6)]
    assert found[0] == found[1] and sum(i != c for i, c in found[0]) > 50


def test_similar_forest_joins_what_is_similar():
    import numpy as np

    from loomwork.llm.simhash import similar_forest

    rnd = np.random.default_rng(1)
    for _ in range(100):
        base = rnd.permutation(40).astype(np.uint64)
        sets = [np.unique(np.r_[base[: rnd.integers(0, 41)], rnd.integers(100, 110, rnd.integers(0, 5)).astype(np.uint64)]) for _ in range(12)]
        label = list(range(12))
        for a, b in similar_forest(np.zeros((12, 4), np.uint64), sets):
            label = [label[b] if x == label[a] else x for x in label]
        want = list(range(12))
        for a in range(12):
            for b in range(a):
                if len(sets[a]) and len(sets[b]) and len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8:
                    want = [want[b] if x == want[a] else x for x in want]
        assert [[x == y for y in label] for x in label] == [[x == y for y in want] for x in want]


def test_pairs_at_the_threshold_are_all_linked(spark):
    """Few bits of fingerprints of short texts tell little, and of pairs at 0.8 some share no block: all are linked."""
    from loomwork.llm.simhash import drop_near_duplicates

    rnd = random.Random(9)
    out = []
    for _ in range(700):
        base = [f"v{rnd.randrange(10**6)}" for _ in range(rnd.randrange(12, 60))]
        # words at the end: m shingles of which k are others
        m = len(base) - 4
        k = max(k for k in range(m) if (m - k) / (m + k) >= 0.8)
        out += [base, base[: len(base) - k] + [f"n{rnd.randrange(10**9)}" for _ in range(k)]]
    line = [f"c{i}" for i in range(40)]  # shingles that are in many texts
    for k in range(60):
        words = line + [f"u{k}_{j}" for j in range(rnd.randrange(0, 16))]
        out += [words, [f"w{k}_{j}" for j in range(10)] + line]
    texts = [" ".join(w) for w in out]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 1, "k", 2) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    places = {}
    for i, s in enumerate(sets):
        for j in {j for g in s for j in places.get(g, [])}:
            if similar(s, sets[j]) >= 0.8:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
        for g in s:
            places.setdefault(g, []).append(i)
    assert sorted(r.doc_id for r in drop_near_duplicates(spark, df).collect()) == [i for i in range(len(texts)) if find(i) == i]
