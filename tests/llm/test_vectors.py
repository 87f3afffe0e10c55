"""Embedding near-dedup and vector codes against plain Python over all pairs and whole rounds."""

import hashlib
import math

import numpy as np
import pytest

from loomwork.llm import pq, spherical

INF, NAN = float("inf"), float("nan")


def brute_links(vectors, threshold=0.95):
    """{row: (links, least id)} of (id, vector) rows; ids may be None."""
    n = len(vectors)
    width = max({len(v) for _, v in vectors if v}, key=[len(v) for _, v in vectors if v].count, default=0)
    ok = [v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in vectors]
    near = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j]:
                a, b = np.array(vectors[i][1], float), np.array(vectors[j][1], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    near[i].add(j)
                    near[j].add(i)
    key = lambda i: 1 << 62 if vectors[i][0] is None else vectors[i][0]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo += near[todo.pop()] - seen
            seen |= set(todo)
        least = min(map(key, seen))
        out.append((vectors[i][0], len(near[i]), None if least == 1 << 62 else least, key(i) == least))
    return sorted(out, key=repr)


def planted(n, width, seed, crowd=40):
    """Random directions, near copies at all distances around the threshold, chains, exact copies, one crowd."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    base = [unit(rng.normal(size=width)) for _ in range(n)]
    rows = list(base)
    for i in range(n // 2):
        c = rng.uniform(0.9, 1)
        off = rng.normal(size=width)
        off = unit(off - (off @ base[i]) * base[i])
        rows.append(c * base[i] + math.sqrt(1 - c * c) * off)
    for k in range(10):  # a chain: each links with the next, ends don't
        a, b = base[k], unit(base[k + 10] - (base[k + 10] @ base[k]) * base[k])
        rows += [math.cos(0.25 * t) * a + math.sin(0.25 * t) * b for t in range(1, 6)]
    for _ in range(crowd):  # about a centroid, some within half the angle and some beyond
        rows.append(unit(base[0] + rng.normal(size=width) * rng.uniform(0.01, 0.5) / math.sqrt(width)))
    rows += [base[1] for _ in range(5)] + [base[2] * 1e-3, base[2] * 1e6]
    order = rng.permutation(len(rows))
    return [(int(k), [float(np.float32(x)) for x in rows[i]]) for k, i in enumerate(order)]


@pytest.mark.parametrize(("width", "spread", "cell_rows"), [(16, None, 40), (64, spherical.SPREAD, 60), (3, spherical.SPREAD, 50)])
def test_links_equal_brute_force(spark, monkeypatch, width, spread, cell_rows):
    monkeypatch.setattr(spherical, "BLOCK_VALUES", 1024 * width)
    rows = planted(300, width, width + cell_rows % 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(map(tuple, spherical.near_vectors(spark, df, spread=spread, cell_rows=cell_rows).collect()), key=repr)
    want = brute_links(rows)
    assert sum(r[1] for r in want) > 200
    if spread is None or width < 10:  # in few dimensions the margin is the one that misses nothing
        assert got == want
    else:
        assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_blocks_of_a_large_cell(spark, monkeypatch):
    """A cell in many blocks, and a crowd beyond the core, give the same links."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(k, [float(np.float32(x)) for x in base + rng.normal(size=8) * (0.1 if k % 3 else 0.6)]) for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(spherical, "BLOCK_VALUES", 0)
    monkeypatch.setattr(spherical, "max", lambda *x, **k: 130 if x == (1024, 0) else max(*x, **k), raising=False)
    got = sorted(map(tuple, spherical.near_vectors(spark, df, cell_rows=10**9).collect()), key=repr)
    assert got == brute_links(rows)


def test_odd_vectors(spark):
    one, two = [1.0, 2.0, 3.0, 4.0], [4.0, -2.0, 0.5, 1.0]
    rows = [(1, one), (2, one), (2, one), (None, one), (3, two), (4, None), (5, []), (6, [0.0] * 4), (7, [NAN, 1.0, 1.0, 1.0]), (8, [None, 1.0, 1.0, 1.0]), (9, [INF, 1.0, 1.0, 1.0]), (10, [1.0, 2.0, 3.0]), (None, two[::-1]), (None, None), (11, [1e300, 2e300, 3e300, 4e300]), (12, [1e-300, 2e-300, 3e-300, 4e-300])]
    df = spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "vec_id long, embedding array<double>, h long, n_links string")
    got = sorted(map(tuple, spherical.near_vectors(spark, df).collect()), key=repr)
    linked = {1, 2, 11, 12}
    assert [r for r in got if r[0] in linked] == sorted([(i, 5, 1, i == 1) for i in (1, 2, 2, 11, 12)], key=repr)
    assert sorted((r for r in got if r[0] is None), key=repr) == sorted([(None, 5, 1, False), (None, 0, None, True), (None, 0, None, True)], key=repr)
    assert all(r[1:] == (0, r[0], True) for r in got if r[0] is not None and r[0] not in linked) and len(got) == len(rows)
    assert spherical.near_vectors(spark, df.limit(0)).count() == 0
    assert spherical.near_vectors(spark, df.filter("embedding IS NULL")).count() == 2


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Whole rounds in plain Python, every entry looked at."""
    kept = [(i, lab, v) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max({len(v) for _, _, v in kept}, key=lambda n: (sum(len(v) == n for _, _, v in kept), n), default=0)
    size = -(-width // parts)
    cut = lambda v: [[math.floor(4096 * x) for x in v][p * size : (p + 1) * size] for p in range(parts)]
    kept = [(i, lab, cut(v)) for i, lab, v in kept if len(v) == width]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    books = [[r[2][p] for r in kept[:entries]] for p in range(parts)]
    best = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        got = [[[] for _ in b] for b in books]
        for r in kept:
            for p in range(parts):
                got[p][best(p, r[2][p])[1]].append(r[2][p])
        books = [[[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for g, e in zip(got[p], books[p], strict=True)] for p in range(parts)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(r[0], r[1], "".join(f"{best(p, r[2][p])[1]:02x}" for p in range(parts)), sum(best(p, r[2][p])[0] for p in range(parts))) for r in kept]
    total = {}
    for r in coded:
        total[r[1]] = total.get(r[1], 0) + r[3]
    return sorted(((*r, total[r[1]], sha) for r in coded), key=repr)


@pytest.mark.parametrize(("n", "width"), [(300, 16), (9, 16), (120, 19), (60, 3)])
def test_codes_equal_plain_rounds(spark, n, width):
    rng = np.random.default_rng(n + width)
    grid = rng.integers(-3, 4, size=(n, width)) / 8 + rng.integers(0, 2, size=(n, 1)) * rng.normal(size=(n, width)) / 1000  # many ties
    rows = [(int(i) if i % 17 else None, None if i % 5 == 0 else int(i % 3), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(n) + 1, grid, strict=True)]
    rows += [(5, 1, None), (6, 1, [NAN] + [0.0] * (width - 1)), (7, 1, [None] + [0.0] * (width - 1)), (8, None, [-INF] + [0.0] * (width - 1)), (9, 2, rows[0][2])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, label int, embedding array<float>, code long").repartition(3)
    got = sorted(map(tuple, pq.compress_vectors(spark, df).collect()), key=repr)
    assert got == plain_codes(rows)


def test_codes_of_odd_tables(spark):
    df = spark.createDataFrame([(1, 1, None), (2, None, [INF])], "vec_id long, label int, embedding array<float>")
    assert pq.compress_vectors(spark, df).count() == 0 and pq.compress_vectors(spark, df.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, 1, []), (2, None, [])], "vec_id long, label int, embedding array<float>")
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in pq.compress_vectors(spark, empty).collect()} == {(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0)}
    huge = spark.createDataFrame([(k, 1, [1e30 * (-1) ** k, float(k), 0.0]) for k in range(4)] + [(9, 1, [1.0])], "vec_id long, label int, embedding array<double>")
    assert pq.compress_vectors(spark, huge).count() == 4  # one has another length


def test_kd_tree_equals_all_entries():
    rng = np.random.default_rng(1)
    for size, many, span in ((3, 16, 3), (8, 16, 100), (1, 5, 2), (2, 200, 6), (4, 1, 9)):
        entries = rng.integers(-span, span, size=(many, size))
        x = rng.integers(-span - 1, span + 1, size=(500, size))
        d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        who, best = pq.KdTree.over(entries).nearest(x)
        assert (who == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
