"""Stored Katz tables against plain recursion at several orders, against the bigram scores, and their sums to one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from loomwork.llm import katz, katz_tables

BEGIN, END = 0, 1


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


class Plain:
    """The model by its definition, with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.c = [None, *(Counter() for _ in range(order))]
        for t in texts:
            seq = [BEGIN, *words(t)]
            for i in range(1, len(seq)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        self.c[k][tuple(seq[i - k + 1 : i + 1])] += 1
        self.n = sum(self.c[1].values())
        self.d = [None, *(katz.discounts([0, *(sum(v == r for v in c.values()) for r in range(1, katz.K + 2)), sum(v > katz.K + 1 for v in c.values())]) for c in self.c[1:])]
        self.after = [None] + [defaultdict(dict) for _ in range(order)]
        for k in range(2, order + 1):
            for g, c in self.c[k].items():
                self.after[k][g[:-1]][g[-1]] = c

    def kept(self, k, c):
        import numpy as np

        return float(self.d[k].kept(np.array([c]))[0])

    def p(self, history, w):
        k = len(history) + 1
        if k == 1:
            if (w,) in self.c[1]:
                return self.kept(1, self.c[1][w,]) / self.n
            return 1 - sum(self.kept(1, c) for c in self.c[1].values()) / self.n
        seen = self.after[k].get(history)
        if not seen:
            return self.p(history[1:], w)
        n = sum(seen.values())
        if w in seen:
            return self.kept(k, seen[w]) / n
        left = 1 - sum(self.kept(k, c) for c in seen.values()) / n
        return left / (1 - sum(self.p(history[1:], v) for v in seen)) * self.p(history[1:], w)

    def score(self, text):
        seq = [BEGIN, *words(text)]
        return sum(math.log10(self.p(tuple(seq[max(0, i - self.order + 1) : i]), seq[i])) for i in range(1, len(seq)))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    vocabulary = [f"W{int(rnd.paretovariate(0.7)) % 60}" for _ in range(400)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 40))) for _ in range(120)]
    return [*enumerate(texts), (7, texts[3]), (900, None), (901, "never seen words"), (None, texts[5])]


@pytest.mark.parametrize("order", [2, 3])
def test_scores(spark, rows, order):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tables = katz_tables.fit_tables(spark, docs, order)
    model = Plain([t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % katz.FOLDS], order)
    got = sorted(((r.doc_id, r.n_tokens, r.score) for r in katz_tables.score_with(spark, tables, docs).collect()), key=repr)
    want = sorted(((i, len(words(t)), model.score(t)) for i, t in rows), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want] and tables.tokens == model.n
    assert all(abs(g[2] - w[2]) < 1e-6 for g, w in zip(got, want, strict=True))
    if order == 2:
        same = sorted(((r.doc_id, r.score) for r in katz.score_documents(spark, docs).collect()), key=repr)
        assert all(a[0] == b[0] and abs(a[1] - b[2]) < 1e-6 for a, b in zip(same, got, strict=True))
    if order == 3:  # after any history the known words and the unknown class make one
        known = [g[0] for g in model.c[1]]
        for history in [*list(model.after[3])[:20], ("w1", "no such word"), ("w1", "w1")]:
            assert abs(sum(model.p(history, w) for w in known) + model.p(history, "?") - 1) < 1e-9
    assert katz_tables.score_with(spark, tables, docs.limit(0)).count() == 0
