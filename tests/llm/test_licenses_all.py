"""Licence scan against a plain version over all lines of a table; names alone, unknown licences, ordinary sentences; any partitioning."""

import math
import re

import pytest

from loomwork.llm import licenses
from loomwork.llm.decontam import tokens

DOCS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS)


@pytest.fixture(scope="module")
def classifier(docs):
    return licenses.fit(docs)


def found(spark, classifier, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return [[f.family for f in r.found] for r in sorted(licenses.scan_licenses(spark, df, classifier).collect())]


def test_names_unknown_licences_and_ordinary_sentences(spark, classifier):
    named = {"MIT licence": "MIT", "Apache 2.0": "Apache-2.0", "MIT": "MIT", "GPLv3": "GPL", "CC BY-SA 4.0": "CC-BY-SA", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "SPDX-License-Identifier: MPL-2.0": "MPL-2.0"}
    unknown = ["Licensed under the WTFPL.", "Distributed under the Foo Public License 3.", "SPDX-License-Identifier: Beerware"]
    none = ["The driver's license must be renewed under the terms of the traffic law.", "Permission to leave the room is granted by the teacher.", "A hunting license is needed in the north of the country.", "The bridge was open to the general public in May."]
    assert found(spark, classifier, list(named)) == [[f] for f in named.values()]
    assert found(spark, classifier, unknown) == [[licenses.UNKNOWN]] * len(unknown)
    assert found(spark, classifier, none) == [[]] * len(none)


def test_threshold_is_the_calibrated_one(classifier):
    """Of the held-out paragraphs without a licence no more than the stated share pass; held-out licences nearly all do."""
    assert 0.5 <= classifier.threshold < 1
    lines = [v for t in licenses.ORDINARY for v in (t, t.upper())]
    words = tokens([t.encode() for t in lines])
    where, first, last = licenses.windows(words)
    assert (1 - classifier.probabilities(words, first, last)[:, -1] >= classifier.threshold).sum() <= 1


def test_same_results_in_any_partitioning(spark, docs):
    got = []
    for n in (1, 3, 7):
        licenses._fitted.clear()
        out = licenses.scan_licenses(spark, docs.repartition(n)).collect()
        got.append(sorted((r.doc_id, r.n_paragraphs, r.found) for r in out))
    assert got[0] == got[1] == got[2] and sum(len(r[2]) for r in got[0]) > 30


def plain(text, c):
    """What is found in one text, line by line, window by window, with sets of word pairs."""
    out, n = [], 0
    templates = licenses.templates()
    for number, line in enumerate((text or "").split("\n")):
        n += bool(re.search(rb"[^\x20\x09-\x0D]", line.encode()))
        words = tokens([line.encode()])
        single, double = (x.tolist() for x in licenses.features(words))
        size = len(words)
        if not size:
            continue
        step, width = licenses.WINDOW_STEP, licenses.WINDOW_WORDS
        spans = [(0, size)] if size <= width + step else [(a, min(a + width, size)) for a in range(0, size - width + step, step)]
        best = None
        for a, b in spans:
            z = [float(x) for x in c.bias]
            for key in [*single[a:b], *double[a : b - 1]]:
                z = [x + float(w) / math.sqrt(2 * (b - a) - 1) for x, w in zip(z, c.weights[key], strict=True)]
            e = [math.exp((x - max(z)) / c.temperature) for x in z]
            p = [x / sum(e) for x in e]
            if best is None or p[-1] < best[-1] - 1e-12:
                best = p
        if 1 - best[-1] < c.threshold:
            continue
        hashes = words.hashes().tolist()
        mine = set(zip(hashes, hashes[1:], strict=False)) or {tuple(hashes)}
        family, near = licenses.UNKNOWN, 0.0
        for k in sorted(range(len(c.families)), key=lambda k: -best[k])[:3]:
            top = 0.0
            for t, name in templates[c.families[k]]:
                theirs = tokens([t.encode()]).hashes().tolist()
                pairs = set(zip(theirs, theirs[1:], strict=False)) or {tuple(theirs)}
                both = len(pairs & mine)
                if both >= min(len(pairs), licenses.FEW_PAIRS) and set(tokens([name.encode()]).hashes().tolist()) <= set(hashes):
                    top = max(top, both / len(pairs), both / len(mine) if not name and both >= 2 * licenses.FEW_PAIRS else 0)
            if top >= licenses.CONFIRM:
                family, near = c.families[k], top
                break
        out.append((number, family, round(best[k] if family != licenses.UNKNOWN else 1 - best[-1], 4), round(near, 4)))
    return n, out


def test_all_lines_against_the_plain_version(spark, docs, classifier):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_paragraphs, [(f.paragraph, f.family, round(f.probability, 4), round(f.similarity, 4)) for f in r.found]) for r in licenses.scan_licenses(spark, docs, classifier).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        n, rows = plain(text, classifier)
        assert got[i][0] == n and len(got[i][1]) == len(rows), i
        for a, b in zip(got[i][1], rows, strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-4 and abs(a[3] - b[3]) < 2e-4, (i, a, b)
