"""Near-dedup of the pipeline: recall by brute force, comparisons that don't grow with the corpus, large keys and labels in blocks."""

import random

import pytest
from pyspark.sql import functions as F

from loomwork.llm import simhash


def shingles(text, n=5):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"x{rnd.randrange(10**6)}"
    return out


SCHEMA = "doc_id long, text string"


def test_recall_of_pairs_at_the_similarity(spark):
    """Of all pairs of similarity 0.8 or more nine in ten at least end in one group, and no pair below it is linked alone."""
    rnd = random.Random(11)
    rows, pairs = [], []
    for i in range(400):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 400))]
        other = edited(rnd, words, rnd.randrange(0, max(2, len(words) // 25)))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        pairs.append((2 * i, len(a & b) / len(a | b)))
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark, df).collect()}
    close = [i for i, s in pairs if s >= 0.8]
    edge = [i for i, s in pairs if 0.8 <= s < 0.84]
    assert len(close) > 150 and len(edge) > 20
    assert sum(i + 1 not in kept for i in close) >= 0.9 * len(close) and sum(i + 1 not in kept for i in edge) >= 0.9 * len(edge)
    assert all(i in kept for i, _ in pairs) and all(i + 1 in kept for i, s in pairs if s < 0.8)


def test_comparisons_do_not_grow_with_the_corpus(spark):
    """Made fingerprints: the other ones under a document's keys stay about as many from 10^4 to 4 x 10^5."""
    met = []
    for n in (10_000, 400_000):
        bits, tables = simhash.wide_plan(n)
        some = min(tables, 6)  # keys are alike; six of them stand for all
        masks = simhash.random_masks((0,) * simhash.WIDE_WORDS, tables, bits)[:some]
        fps = spark.range(n).select(*(F.xxhash64("id", F.lit(i)).alias(f"f{i}") for i in range(simhash.WIDE_WORDS)))
        keys = [F.xxhash64(F.lit(k), *(F.col(f"f{i}").bitwiseAND(F.lit(simhash._signed(m[i]))) for i in range(simhash.WIDE_WORDS))) for k, m in enumerate(masks)]
        counts = fps.select(F.explode(F.array(*keys)).alias("key")).groupBy("key").count()
        met.append(counts.agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0] / n / some)
    assert max(met) <= simhash.WIDE_KEY
    plans = [simhash.wide_plan(10**k) for k in range(2, 12)]
    assert plans[0] == plans[4] == (16, 48) and all(10**k / 2**bits <= simhash.WIDE_KEY for k, (bits, _) in zip(range(2, 12), plans, strict=True))
    assert all(1 - (1 - (1 - simhash.WIDE_SHARE) ** b) ** t >= simhash.WIDE_RECALL for b, t in plans) and plans[-1][1] < 1000


@pytest.mark.parametrize("block", [7, 40])
def test_large_groups_in_blocks(spark, monkeypatch, block):
    """A crowd of near copies, a chain, and sets that share keys only: the same groups whether labels are large or not."""
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    rows = [(i, " ".join(edited(rnd, base, 3))) for i in range(60)]
    chain = list(base[:150])
    for i in range(25):
        chain = chain[3:] + [f"c{i}a", f"c{i}b", f"c{i}c"]
        rows.append((100 + i, " ".join(chain)))
    rows += [(200 + i, " ".join(f"w{rnd.randrange(5000)}" for _ in range(200))) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {r._k: r.component for r in simhash.groups(spark, df, 5, simhash.WIDE_DISTANCE, wide=True).collect()}
    monkeypatch.setattr(simhash, "SET_BLOCK", block)
    monkeypatch.setattr(simhash, "KEY_BLOCK", block)
    assert {r._k: r.component for r in simhash.groups(spark, df, 5, simhash.WIDE_DISTANCE, wide=True).collect()} == whole
    assert len({whole[i] for i in range(60)}) == 1 and len({whole[200 + i] for i in range(20)}) == 20
