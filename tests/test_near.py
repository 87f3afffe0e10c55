"""Near-duplicates, contained items, components and the normal form against plain Python."""

import random
import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.operators import graph, joins, near
from loomwork.plans import cleaning


def grams(t, n=5):
    return {t} if len(t) <= n else {t[i : i + n] for i in range(len(t) - n + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def ways(a, b, ratio=(0.75, 1.33)):
    return ratio[0] <= len(a) / max(1, len(b)) <= ratio[1]


def edited(rnd, t, n):
    t = list(t)
    for _ in range(n):
        i = rnd.randrange(len(t))
        t[i] = rnd.choice("abcdefgh")
    return "".join(t)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(90, 260))) for _ in range(12)]
    out = [edited(rnd, b, rnd.randrange(0, 3)) for b in base for _ in range(9)]
    out += [b + "x" * k for b in base[:3] for k in (5, 10, 20)] + [out[3]] * 3 + ["", "", "abc", "abc", "abd", None, None]
    rnd.shuffle(out)
    return list(enumerate(out))


def plain_groups(texts):
    """{id: (class, group)}, and {(class, class): similarity} of links with the ratio of the lesser's length to the other's."""
    first, links = {}, {}
    for i, t in texts:
        if t is not None:
            first.setdefault(t, i)
    sets = {t: grams(t) for t in first}
    parent = {i: i for i in first.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, i in first.items():
        for b, j in first.items():
            if i < j and (s := jaccard(sets[a], sets[b])) >= 0.85:
                if ways(a, b):
                    links[i, j] = s
                if ways(a, b) or ways(b, a):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return {i: (i, i) if t is None else (first[t], find(first[t])) for i, t in texts}, links


@pytest.mark.parametrize("crowd", [0, 3, 10**6])
def test_groups_and_pairs(spark, monkeypatch, texts, crowd):
    monkeypatch.setattr(near, "CROWD", crowd)
    df = spark.createDataFrame(texts, "id long, t string").repartition(4)
    groups, links = plain_groups(texts)
    assert len({g for _, g in groups.values()}) < len({c for c, _ in groups.values()}) and len(links) > 50
    assert {r.id: (r.class_id, r.group_id) for r in near.near_groups(df, "id", "t").collect()} == groups
    if crowd == 3:
        got = {(r.id_a, r.id_b): r.jaccard for r in near.near_pairs(df, "id", "t").collect()}
        assert set(got) == set(links) and all(abs(got[k] - links[k]) < 1e-9 for k in links)
        assert near.near_groups(df.limit(0), "id", "t").count() == 0 and near.near_pairs(df.limit(0), "id", "t").count() == 0


def test_every_link_counts(spark, texts):
    """Each row has its text's links with other texts, beside the class and group that plain comparison gives."""
    groups, _ = plain_groups(texts)
    first = {t: c for t, c in ((t, groups[i][0]) for i, t in texts if t is not None)}
    linked = {t: sum(u != t and (ways(t, u) or ways(u, t)) and jaccard(grams(t), grams(u)) >= 0.85 for u in first) for t in first}
    got = near.near_links(spark.createDataFrame(texts, "id long, t string").repartition(4), "id", "t").collect()
    assert {r.id: (r.class_id, r.group_id, r.n_links) for r in got} == {i: (*groups[i], linked.get(t, 0)) for i, t in texts}
    assert sum(n > 1 for n in linked.values()) > 20


def test_evaluation_sets(spark, texts):
    rnd = random.Random(5)
    known = [t for _, t in texts if t][::7] + [None, ""]
    known = [edited(rnd, t, 1) if t else t for t in known]
    out = near.near_evaluation(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(t,) for t in known], "t string"), "t")
    want = {i: any(k is not None and ways(t, k) and jaccard(grams(t), grams(k)) >= 0.85 or t == k for k in known) if t is not None else False for i, t in texts}
    assert {r.id: r.near_evaluation for r in out.collect()} == want and sum(want.values()) > 15


def test_a_crowd_of_near_copies_does_not_square(spark, monkeypatch):
    rnd = random.Random(6)
    base = "".join(rnd.choice("abcdefghijklmnop") for _ in range(300))
    n = 3000
    df = spark.createDataFrame([(i, edited(rnd, base, 1) + str(i)) for i in range(n)] + [(n, "quite another text that shares nothing")], "id long, t string")
    counted = []
    plain = near.compared
    monkeypatch.setattr(near, "compared", lambda pairs, *a: counted.append(pairs.count()) or plain(pairs, *a))
    groups = {r.id: r.group_id for r in near.near_groups(df, "id", "t").collect()}
    assert {groups[i] for i in range(n)} == {0} and groups[n] == n
    assert sum(counted) < 10 * n, counted


def test_contained_items(spark):
    rnd = random.Random(7)
    docs = [(i, "".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 300)))) for i in range(150)] + [(900, None), (901, ""), (902, "e" * 500)]
    items = [(i, d[k : k + n]) for i, (d, n) in enumerate((d, n) for _, d in docs if d and len(d) > 60 for n in (1, 3, 7, 16, 40)) for k in (5,)]
    items += [(5000, "abcdz" * 4), (5001, ""), (5002, None), (5003, items[4][1]), (5004, "eeee"), (5005, "z")]
    want = {(i, k) for i, d in docs if d for k, t in items if t and t in d}
    d = spark.createDataFrame(docs, "doc_id long, t string")
    i = spark.createDataFrame(items, "item_id long, t string")
    out = joins.contained_items(d, i, "doc_id", "item_id", "t")
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert joins.contained_items(d, i.limit(0), "doc_id", "item_id", "t").count() == 0
    assert joins.contained_items(d.limit(0), i, "doc_id", "item_id", "t").count() == 0


def test_components(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    near_to = defaultdict(set)
    for a, b in edges:
        near_to[a].add(b)
        near_to[b].add(a)
    want = {}
    for a, b in edges:
        if a != b:
            for x in (a, b):
                seen, todo = {x}, [x]
                while todo:
                    todo += near_to[todo.pop()] - seen
                    seen |= set(todo)
                want[x] = min(seen)
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == want and len(got) == len(want)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_that_show_their_normal_form():
    """Every character of the class is its own NFKC, and none is composed with the one before it."""
    stable = {c for c in map(chr, range(0x10000)) if re.match(X.NFKC_FORM, c)}
    assert all(unicodedata.normalize("NFKC", c) == c for c in stable) and not any(unicodedata.combining(c) for c in stable)
    second = {d[1] for c in map(chr, range(0x110000)) if not unicodedata.decomposition(c).startswith("<") and len(d := unicodedata.normalize("NFD", c)) > 1}
    assert not stable & second


def test_normal_form_is_worked_out_once(spark):
    rows = ["Plain ASCII, text_1!", "ﬁne Ⅻ", "été ÉTÉ", "Ａ１ 数学。", None, "", "Straße 𝐀"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string")
    out = df.withColumn("n", X.normalize_question("t"))
    want = {i: None if t is None else re.sub(r"[^\w]+", "", unicodedata.normalize("NFKC", t).lower()) for i, t in enumerate(rows)}
    assert {r.i: r.n for r in out.collect()} == want
    twice = out.filter("n IS NOT NULL AND n <> 'x'").select("i", F.sha2("n", 256).alias("a"), F.length("n").alias("b")).filter("a IS NOT NULL")
    plan = twice._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("groups", [1, 40])
def test_texts_meet_by_parts_not_by_single_grams(spark, monkeypatch, groups):
    """Links are those of plain comparison at sizes of many classes; texts of the same words meet in few pairs, though each gram is in most of them."""
    monkeypatch.setattr(near.similar, "GROUPS", groups)
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 9))) for _ in range(400)]
    out = ["".join(rnd.choice(words) for _ in range(rnd.choice((4, 30, 200, 220)))) for _ in range(240)]
    out += [edited(rnd, t, rnd.choice((1, len(t) // 80, len(t) // 65, len(t) // 60, len(t) // 50))) + "z" * rnd.randrange(3) for t in out[::2]]
    rows = list(enumerate(out))
    sets = [grams(t) for t in out]
    want = {(i, j): jaccard(a, b) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if out[i] != out[j] and min(len(a), len(b)) >= 0.85 * max(len(a), len(b))}
    want = {k: v for k, v in want.items() if v >= 0.85}
    compared, plain = [], near.similar.stored
    monkeypatch.setattr(near.similar, "stored", lambda df: compared.append(plain(df)) or compared[-1])
    got = {(r.id_a, r.id_b): r.jaccard for r in near.near_pairs(spark.createDataFrame(rows, "id long, t string").repartition(3), "id", "t", ratio=(0.5, 2.0)).collect()}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items()) and len(want) > 60 and min(want.values()) < 0.87
    assert compared[0].count() < 3 * len(want)


def test_evaluation_shuffles_no_text_for_labels(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cleaning._toxic_docs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
