"""Cuts of ordered groups against plain Python: ties, weights, hot groups, few keys at once, many groups."""

import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from loomwork.operators import cuts, store
from loomwork.operators import select as sel


def plain(rows, target, group, key, weight):
    """Numbers of rows that are in, by group: weight before a row below the target."""
    out = []
    by = defaultdict(list)
    for r in rows:
        by[group(r)].append(r)
    for g, members in by.items():
        before = 0
        for r in sorted(members, key=key):
            if before < target(g, members):
                out.append(r)
            before += weight(r)
    return out


def digest(i):
    return sha256(str(i).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    # one source has nearly all rows, one has none of a name, weights are zero at times
    return [(i, "hot" if i % 100 else rnd.choice(["a", "b", None]), digest(i), rnd.choice([0, 1, 5, 9])) for i in range(6000)]


@pytest.mark.parametrize(("cell", "numeric", "small"), [(20, False, False), (20, True, True), (cuts.CELL, False, True)])
def test_targets_by_group(spark, monkeypatch, rows, cell, numeric, small):
    monkeypatch.setattr(cuts, "CELL", cell)
    if not small:  # as with more groups than the driver may hold
        monkeypatch.setattr(cuts, "held", lambda df: store.held(df, 0))
    df = spark.createDataFrame(rows, "seq long, source string, k string, w int").repartition(5)
    key = "seq" if numeric else "k"
    at = 0 if numeric else 2
    for weight, target in ((None, 7), ("w", 20_000), (None, 0), ("w", 10**9)):
        got = cuts.mark(df, ["source"], key, cuts.fixed_goal(target), weight, ties=[]).filter("_in").select("seq").collect()
        want = plain(rows, lambda g, m: target, lambda r: r[1], lambda r: r[at], lambda r: 1 if weight is None else r[3])
        assert sorted(r.seq for r in got) == sorted(r[0] for r in want), (weight, target)
    every = cuts.mark(df, [], key, cuts.fixed_goal(F.floor(F.col("_n") * 0.3)), ties=[])
    assert {r.seq for r in every.filter("_in").collect()} == {r[0] for r in sorted(rows, key=lambda r: r[at])[:1800]} and every.count() == len(rows)


@pytest.mark.parametrize("cell", [5, cuts.CELL])
def test_ties_and_repeated_rows(spark, monkeypatch, cell):
    monkeypatch.setattr(cuts, "CELL", cell)
    rows = [("a", "k1", i % 3, None) for i in range(40)] + [("a", "k0", 1, 2)] * 30 + [("b", None, 1, 1)] * 3 + [("b", "k", 2, 2)]
    df = spark.createDataFrame(rows, "g string, k string, x int, w int")
    for n in (1, 30, 50, 99):
        got = cuts.mark(df, ["g"], "k", cuts.fixed_goal(n)).filter("_in").groupBy("g", "k").count().collect()
        assert {(r.g, r.k): r["count"] for r in got} == {k: v for k, v in {("a", "k0"): min(n, 30), ("a", "k1"): min(max(n - 30, 0), 40), ("b", None): min(n, 3), ("b", "k"): min(max(n - 3, 0), 1)}.items() if v}
        assert cuts.mark(df, ["g"], "k", cuts.fixed_goal(n), ties=[]).filter("_in").filter("g = 'a'").count() == min(n, 70)
    # thirty rows weigh two each: the row that crosses is in; then all others of the group weigh nothing
    assert cuts.mark(df, ["g"], "k", cuts.fixed_goal(11), "w").filter("_in AND g = 'a'").count() == 6
    assert cuts.mark(df, ["g"], "k", cuts.fixed_goal(61), "w").filter("_in AND g = 'a'").count() == 70
    assert cuts.mark(df.limit(0), ["g"], "k", cuts.fixed_goal(3)).count() == 0
    with pytest.raises(TypeError):
        cuts.mark(df.withColumn("d", F.lit(1.5)), ["g"], "d", cuts.fixed_goal(3))


def test_keys_with_a_long_common_beginning(spark, monkeypatch):
    monkeypatch.setattr(cuts, "CELL", 4)
    rows = [(i, "x" * 200 + digest(i)[: 1 + i % 40]) for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, k string")
    got = {r.seq for r in cuts.mark(df, [], "k", cuts.fixed_goal(123), ties=[]).filter("_in").collect()}
    assert got == {r[0] for r in sorted(rows, key=lambda r: r[1])[:123]}


def plans(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_window_over_a_group(spark, rows):
    df = spark.createDataFrame(rows, "seq long, source string, k string, w int")
    for out in (
        sel.quota_sample(df, "source", {"hot": 100, "a": 3}, F.col("k"), ties=[]), sel.stratified_holdout(df, ["source"], 100, F.col("k"), ties=[]),
        sel.mining_pool(df, "source", {"hot": 100, "a": 3}, ["seq"], F.col("k")), sel.running_budget(df, "w", F.col("k"), 50, ["source"], ties=[]),
        sel.balanced_replay(df, "source", "w", 500, F.col("k"), F.sha2("k", 256), ties=[]), sel.ordered_split(df, F.col("k"), ties=[]),
    ):
        assert "Window" not in plans(out)
    # queues number the rows that the cut has left: the limit of each source
    queue = sel.round_robin(df, "source", ["a"], "k", 20, ties=[])
    assert [r.turn for r in queue.collect()] == sorted([1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5])


def test_budgets_and_queues_against_plain_python(spark, monkeypatch, rows):
    monkeypatch.setattr(cuts, "CELL", 50)
    df = spark.createDataFrame([(*r, "truncated" if r[0] % 3 else "wrong_complete") for r in rows if r[1]], "seq long, source string, k string, w int, kind string")
    held = [(*r, "truncated" if r[0] % 3 else "wrong_complete") for r in rows if r[1]]
    total = sum(r[3] for r in held)
    out = sel.balanced_replay(df, "source", "w", 900, F.col("k"), F.sha2("k", 256), ties=[]).collect()
    first = plain(held, lambda g, m: round(900 * sum(x[3] for x in m) / total), lambda r: r[1], lambda r: r[2], lambda r: r[3])
    assert {r.seq for r in out if r.replay_part == "source"} == {r[0] for r in first}
    rest = [r for r in held if r[0] not in {x[0] for x in first}]
    fill = plain(rest, lambda g, m: 900 - sum(r[3] for r in first), lambda r: 0, lambda r: sha256(r[2].encode()).hexdigest(), lambda r: r[3])
    assert {r.seq for r in out if r.replay_part == "fill"} == {r[0] for r in fill}
    order = ["b"]
    turns = []
    for kind in ("truncated", "wrong_complete"):
        for s in ("hot", "a", "b"):
            mine = sorted((r for r in held if r[1] == s and r[4] == kind), key=lambda r: r[0])
            turns += [(kind, t, (s not in order, s), r[0]) for t, r in enumerate(mine)]
    want = set()
    for kind, n in (("truncated", 12), ("wrong_complete", 28)):
        want |= {x[3] for x in sorted(x for x in turns if x[0] == kind)[:n]}
    assert {r.seq for r in sel.failure_share(df, "kind", "source", order, "seq", 40, 0.3, ties=[]).collect()} == want
