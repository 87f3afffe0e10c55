"""Fill-in-middle against plain Python: boundaries of every grammar, cuts, forms, the way back, odd rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from loomwork.llm import fim

TEXTS = ["", "a", "ab", "one two  three\n", "\n\nx\r\ny", "𝐀𝐀b 𠀀𠀀 c12", "é é ü", "12ab--cd 3", "x<P>y", "a <M> b", "<S", "👨‍👩‍👧 hi", " lead", "tab\tand\x0bvt", "a\x00b", "words " * 50]


def kinds(grammar, c):
    return next(k for k, body in grammar.classes.items() if re.fullmatch(body.replace(r"\p{L}\p{M}", "".join(CLASS["LM"])).replace(r"\p{N}", "".join(CLASS["N"])), c, re.S))


def _classes():
    import unicodedata

    used = sorted(set("".join(TEXTS)))
    return {"LM": [re.escape(c) for c in used if unicodedata.category(c)[0] in "LM"], "N": [re.escape(c) for c in used if unicodedata.category(c)[0] == "N"]}


CLASS = _classes()


def plain_units(grammar, text):
    out = []
    for i, c in enumerate(text):
        if i and (kinds(grammar, text[i - 1]), kinds(grammar, c)) in grammar.together:
            out[-1] += c
        else:
            out.append(c)
    return out


def plain_fim(text, doc_id, grammar, seed=1):
    text = text or ""
    pieces = plain_units(grammar, text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(pieces)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (pieces[:a], pieces[a:b], pieces[b:]))
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, None, text
    if h[3] % 100 < 20:
        return n, "spm", pre, mid, suf, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", pre, mid, suf, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("name", list(fim.GRAMMARS))
def test_units_and_cuts(spark, name):
    grammar = fim.GRAMMARS[name]
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(20 * len(TEXTS))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = docs.select("text", fim.units(F.col("text"), grammar).alias("u")).collect()
    assert all(r.u == (plain_units(grammar, r.text) or [""]) for r in got)
    out = fim.fill_in_middle(docs, name).withColumn("back", fim.restored("fim_output", "fim_form")).collect()
    forms = set()
    for r in out:
        text = TEXTS[r.doc_id % len(TEXTS)]
        assert (r.fim_units, r.fim_form, r.fim_prefix, r.fim_middle, r.fim_suffix, r.fim_output) == plain_fim(text, r.doc_id, grammar), (name, r)
        assert r.back == text
        forms.add(r.fim_form)
    assert forms == {"plain", "psm", "spm"} and len(out) == len(rows)


def test_odd_rows(spark):
    long = "So 𝐀 it goes. " * 150_000
    rows = [(None, "some text here", 1, 2, 3), (None, "some text here", 4, 5, 6), (7, None, 7, 8, 9), (8, long, 0, 0, 0), (9, long[:9], 0, 0, 0), (9, long[:9], 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_____p` long, fim_form long, `a.b` long")
    out = fim.fill_in_middle(docs, "char")
    assert out.columns[:4] == ["doc_id", "text", "_____p", "a.b"] and out.columns.count("fim_form") == 1
    got = out.withColumn("back", fim.restored("fim_output", "fim_form")).collect()
    assert len(got) == 6
    texts = sorted(x or "" for _, x, *_ in rows)
    assert sorted(r.back for r in got) == texts
    for r in got:
        if r.doc_id == 8:
            assert r.fim_units == len(long) and (r.fim_form, r.fim_output) == plain_fim_chars(long, 8)
    assert [r.fim_output for r in got if r.doc_id == 7] == [""]
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def plain_fim_chars(text, doc_id):
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if h[2] % 100 >= 90:
        return "plain", text
    return ("spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}") if h[3] % 100 < 20 else ("psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")


def test_sentinels(spark):
    docs = spark.createDataFrame([(i, f"ab<c>{i}") for i in range(60)], "doc_id long, text string")
    marks = ("[[pre", "{suf", "(mid")
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, sentinels=marks)
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "ba", "c")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, sentinels=bad)
    marks = ("[pre", "{suf", "(mid")
    out = fim.fill_in_middle(docs, "word", sentinels=marks).withColumn("back", fim.restored("fim_output", "fim_form", marks)).collect()
    assert all(r.back == f"ab<c>{r.doc_id}" for r in out) and {r.fim_form for r in out} >= {"psm", "spm"}


def test_plan_stays_in_the_jvm_without_a_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = fim.fill_in_middle(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
