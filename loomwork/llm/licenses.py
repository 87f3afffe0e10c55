"""Licence scans: a paragraph classifier on sparse word n-grams, an unknown class by calibrated probability, templates to confirm.

Classes are the families, a licence of no known family, and no licence. Features are words and word pairs; those of templates
and of the ordinary sentences below have weights, any other only makes a paragraph longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.decontam import tokens
from loomwork.llm.common import hash_sample
from loomwork.llm.textkit import Words, mix, release_memory, text_slices

#: Names by which notices call each family: fixed values.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "Expat License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU General Public License", "GPL-3.0", "GPL-2.0", "GPLv3", "GPLv2", "GNU GPL"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPL-3.0", "GNU LGPL"],
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL-3.0", "GNU AGPL"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
    "ISC": ["ISC License", "ISC licence"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC-BY-4.0"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0"],
    "CC-BY-ND": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0", "CC-BY-ND-4.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL-2.0"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "CC0": ["CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", "CC0-1.0"],
    "Unlicense": ["Unlicense"],
    "All-rights-reserved": [],
}
#: Sentences that notices put a name in: fixed values.
NOTICES = [
    "Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This project is licensed under the {}.",
    "Distributed under the {}.", "This file is distributed under the terms of the {}.", "Permission is granted under the {}.",
    "Published under the {}.", "The code is available under the {}.", "SPDX-License-Identifier: {}", "License: {}",
    "This program is free software and may be used under the terms of the {}.", "You may use this file under the {}.",
]
#: Sentences of the licences and their usual notices themselves: fixed values.
SENTENCES = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "Apache-2.0": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"],
    "CC-BY-ND": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nd/4.0/"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "CC0": ["the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "All-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved.", "No part of this publication may be reproduced without prior written permission.", "Proprietary and confidential. All rights reserved."],
}
#: Ordinary sentences with the words of licences, as examples of none: fixed values.
ORDINARY = [
    "The driver's license must be renewed every ten years.", "A fishing license is sold at the town hall.", "She took poetic licence with the facts.", "The license plate of the car was muddy.",
    "He lost his driving licence after the accident.", "The bar has no license to sell wine.", "Under the terms of the contract the rent is due in May.", "The law protects the rights of the tenants.",
    "Permission to enter the garden is granted by the mayor.", "The work of the public library is free of charge.", "The terms of the treaty were published in the morning.", "Copies of the book are distributed in schools.",
    "The general public was not allowed to use the bridge.", "The program of the evening may be changed without notice.", "This file of letters was found in the attic.", "The author holds the copyright of the song.",
    "A common attribution of the painting is wrong.", "The foundation of the house was built under the old wall.", "The new version of the play was published in the spring.", "The sale of software rose by a third.",
    "You may use the door at the back of the house.", "The code of conduct applies to all members of the club.", "The clause in the license of the pilot must be read under the light of the law.", "All of the rights of way are reserved for walkers.",
    "Released under the bright moon the birds flew away.", "He published his poems under another name.", "Distributed under the trees the chairs were soon taken.", "The king granted permission to build a mill.",
    "The city licensed the work under a law of that year.", "The room is available under the roof for guests.",
]
#: Names of licences that there are not, so that notices with names of no family are known for what they are.
OTHER_NAMES = ["{0} License", "{0} Public License", "{0} {1} License 1.1", "{2}", "{2} License", "{0}-{2}-2.0"]
UNKNOWN = "unknown"
#: Hashed features, and rows of the corpus (those of least hash) whose paragraphs serve as examples of no licence, at most so many.
FEATURE_BITS = 18
SAMPLE_ROWS = 400
SAMPLE_LINES = 1500
#: Share of a template's word pairs that a paragraph must hold; all of them where the template has no more than FEW_PAIRS.
CONFIRM = 0.5
FEW_PAIRS = 3
#: Bytes of texts that are classified at once: each word takes a number for each class.
CUT_BYTES = 1 << 17
#: Words of a window, and words from one to the next, in which a longer paragraph is classified.
WINDOW_WORDS = 24
WINDOW_STEP = 12
#: Of paragraphs without a licence at most so many may pass the calibrated threshold.
FALSE_SHARE = 0.01
#: Notices that each name is fitted with; all of them are templates.
FIT_NOTICES = 5
_fitted: dict[str, Classifier] = {}


def templates() -> dict[str, list[tuple[str, str]]]:
    """Of each family the templates, each with the name that a notice must hold whole (none in the licences' own sentences); the bare name is one."""
    return {f: [(t, "") for t in SENTENCES[f]] + [(name, name) for name in NAMES[f]] + [(n.format(name), name) for n in NOTICES for name in NAMES[f]] for f in NAMES}


def fit_texts() -> list[list[str]]:
    """Of each family the texts that the fit takes: sentences, bare names, and each name in FIT_NOTICES of the notices, by turns."""
    out = []
    for f, names in NAMES.items():
        turns = [[n.format(name) for n in (NOTICES * 2)[3 * j % len(NOTICES) :][:FIT_NOTICES]] for j, name in enumerate(names)]
        out.append([*SENTENCES[f], *names, *(t for turn in turns for t in turn)])
    return out


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word, and of each word with the next."""
    hashes = words.hashes()
    number = lambda x: (x >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    return number(hashes), number(mix(mix(hashes[:-1]) + hashes[1:]))


def windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, word after the last) of each window: a text with words whole, if it is no longer than a window and a step, else in overlapping ones."""
    first, last = words.at[:-1], words.at[1:]
    size = last - first
    count = np.where(size <= WINDOW_WORDS + WINDOW_STEP, (size > 0).astype(np.int64), -(-(size - WINDOW_WORDS) // WINDOW_STEP) + 1)
    text = np.repeat(np.arange(len(size)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = first[text] + step * WINDOW_STEP
    whole = count[text] == 1
    return text, begin, np.where(whole, last[text], np.minimum(begin + WINDOW_WORDS, last[text]))


@dataclass
class Classifier:
    """Multinomial logistic regression; the last class but one is a licence of no known family, the last is no licence."""

    families: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    templates: list[list[tuple[np.ndarray, np.ndarray]]]

    def probabilities(self, words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of each run of words the classes' probabilities."""
        total = np.zeros((len(first), len(self.bias)))
        for keys, end in zip(features(words), (last, last - 1), strict=True):  # words, and pairs that lie in the run
            sums = np.zeros((len(keys) + 1, len(self.bias)))
            np.cumsum(self.weights[keys], axis=0, out=sums[1:], dtype=np.float64)
            total += sums[end] - sums[first]
        total = total / np.sqrt(2 * (last - first) - 1)[:, None] + self.bias
        return softmax(total / self.temperature)

    def similarity(self, hashes: np.ndarray, family: int) -> float:
        """The largest share of a template's word pairs that the paragraph holds, or of a long template's sentence the share of the paragraph's; 0 without the template's name."""
        mine, best = word_pairs(hashes), 0.0
        for pairs, name in self.templates[family]:
            both = len(np.intersect1d(mine, pairs))
            if both < min(len(pairs), FEW_PAIRS) or not np.isin(name, hashes).all():
                continue
            share = both / len(pairs)
            if not len(name) and both >= 2 * FEW_PAIRS:  # a part of a licence's own sentence
                share = max(share, both / len(mine))
            best = max(best, share)
        return best


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def examples(negatives: list[str], seed: int = 7) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, classes, and which are held out for calibration.

    Texts of licences are whole, among words of the corpus, and with words left out. Those of no licence are paragraphs of the
    corpus, ordinary sentences, and parts of notices among other words. Every fifth text of a family is held out with all its
    variants, so calibration sees texts that the fit did not, and a fifth of those without a licence.
    """
    rnd = np.random.default_rng(seed)
    pool = [w for p in negatives[:2000] for w in p.split()] or ["word"]
    some = lambda n: " ".join(pool[i] for i in rnd.integers(0, len(pool), n))
    letters = lambda n: "".join(chr(65 + i) for i in rnd.integers(0, 26, n))
    texts, classes, rest = [], [], []

    def add(text: str, c: int, held: bool) -> None:
        cut = " ".join(w for w in text.split() if rnd.random() > 0.1) or text
        for v in (text, f"{some(4)} {text}", f"{some(9)} {text} {some(9)}", cut.lower()):
            texts.append(v)
            classes.append(c)
            rest.append(held)

    for c, group in enumerate(fit_texts()):
        for k, t in enumerate(group):
            add(t, c, k % 5 == 3)
    for k, notice in enumerate(NOTICES):
        for j, name in enumerate(OTHER_NAMES):
            add(notice.format(name.format(some(1).title(), some(1).title(), letters(4 + j % 3))), len(NAMES), (k + j) % 5 == 3)
    known, none = len(texts), len(NAMES) + 1
    # words of notices in other company are no licence
    spare = [n.replace("{}", "").split() for n in NOTICES] + [t.split() for group in SENTENCES.values() for t in group]
    for n, i in enumerate(rnd.integers(0, len(spare), 600)):
        size = int(rnd.integers(1, 4 if n % 2 else 3))
        k = int(rnd.integers(0, max(1, len(spare[i]) - size)))
        part = " ".join(spare[i][k : k + size])
        texts.append(f"{some(6)} {part} {some(6)}" if n % 2 else part)
        rest.append(n % 10 == 1)  # a part alone is no paragraph to be measured by
    texts += [v for t in ORDINARY for v in (t, f"{some(5)} {t}", f"{t} {some(8)}", t.lower())]
    texts += negatives
    classes += [none] * (len(texts) - known)
    rest += (rnd.random(len(texts) - len(rest)) < 0.2).tolist()
    return texts, np.array(classes), np.array(rest)


def train(negatives: list[str], rounds: int = 60, rate: float = 2.0, decay: float = 1e-5, seed: int = 7) -> Classifier:
    """Temperature and threshold are set on held-out examples by a fit without them; the weights are then fitted on all."""
    texts, classes, rest = examples(negatives, seed)
    numbers = lambda some: _numbers(tokens([t.encode() for t in some]))
    used = np.unique(numbers([t for group in fit_texts() for t in group] + ORDINARY + [n.replace("{}", "") for n in NOTICES])[0])
    keys, text, size = numbers(texts)
    at = np.searchsorted(used, keys).clip(max=len(used) - 1)
    mine = used[at] == keys
    n, k = len(texts), len(NAMES) + 2
    x = np.zeros((n, len(used)), np.float32)  # the few features that have weights
    np.add.at(x, (text[mine], at[mine]), (1 / np.sqrt(np.maximum(size, 1)))[text[mine]])
    target = np.eye(k, dtype=np.float32)[classes]

    def fitted(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, want = x[use], target[use]
        w, grown, bias = np.zeros((len(used), k), np.float32), np.full((len(used), k), 1e-8, np.float32), np.zeros(k, np.float32)
        share = 1 / np.maximum(np.bincount(classes[use], minlength=k), 1)[classes[use]]
        share = (share / share.sum()).astype(np.float32)
        last = np.inf
        for _ in range(rounds):
            p = softmax(own @ w + bias)
            loss = -float(share @ np.log((p * want).sum(axis=1) + 1e-12))
            if last - loss < 1e-5:
                break
            last = loss
            error = (p - want) * share[:, None]
            step = own.T @ error + decay * w
            grown += step**2
            w -= rate * step / np.sqrt(grown) * 0.1
            bias = bias - rate * error.sum(axis=0)
        return w, bias

    w, bias = fitted(~rest)
    z, truth = (x[rest] @ w + bias).astype(np.float64), classes[rest]
    temperature = min(np.geomspace(0.1, 3, 30), key=lambda t: -np.log(softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean())
    p = softmax(z / temperature)
    wrong = np.sort(1 - p[truth == k - 1, -1])
    threshold = max(0.5, float(wrong[int(len(wrong) * (1 - FALSE_SHARE))]) + 1e-6 if len(wrong) else 0.5)
    w, bias = fitted(np.ones(n, bool))
    weights = np.zeros((1 << FEATURE_BITS, k), np.float32)
    weights[used] = w
    return Classifier(list(NAMES), weights, bias.astype(np.float64), float(temperature), threshold, template_hashes())


def _numbers(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, the text that each is in, and how many each text has."""
    single, double = features(words)
    text = words.text_of()
    inner = text[1:] == text[:-1]
    text = np.concatenate([text, text[:-1][inner]])
    return np.concatenate([single, double[inner]]), text, np.bincount(text, minlength=len(words.at) - 1)


def word_pairs(hashes: np.ndarray) -> np.ndarray:
    return np.unique(mix(mix(hashes[:-1]) + hashes[1:])) if len(hashes) > 1 else np.unique(hashes)


def template_hashes() -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Of each family's templates the word pairs, and the words of the name."""
    of = lambda t: tokens([t.encode()]).hashes()
    return [[(word_pairs(of(t)), np.unique(of(name))) for t, name in group] for group in templates().values()]


def known_pairs() -> np.ndarray:
    """The word pairs of all templates."""
    return np.unique(np.concatenate([pairs for group in template_hashes() for pairs, _ in group]))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """A classifier with the paragraphs of at most ``sample_rows`` rows (those of least hash) as examples of no licence, but for those like a template.

    Fitted once in a session for one sample: the last classifiers are kept by its checksum.
    """
    table = hash_sample(docs, ["text"], sample_rows).toArrow()
    lines = [p for t in table.column("text").to_pylist() for p in (t or "").split("\n") if p.strip()]
    known = known_pairs()
    # a sentence in the middle of a paragraph counts too: a paragraph with over a few pairs of the templates is left out
    lines = [p for p in lines if np.isin(word_pairs(tokens([p.encode()]).hashes()), known).sum() < 2][:SAMPLE_LINES]
    key = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    if key not in _fitted:
        while len(_fitted) > 3:
            _fitted.pop(next(iter(_fitted)))
        _fitted[key] = train(lines)
    return _fitted[key]


def scan_licenses(spark: SparkSession, docs: DataFrame, classifier: Classifier | None = None, confirm: float = CONFIRM) -> DataFrame:
    """(doc_id, n_paragraphs, found) of each row; found lists (paragraph, family, probability, similarity), in order.

    Paragraphs are the lines with a word, counted from 0 over all lines; a long one is classified in overlapping windows, and
    the window with the least probability of no licence stands for it. If all families together reach the calibrated
    threshold there, the paragraph is of the most probable family that a template confirms: the paragraph holds ``confirm``
    of its word pairs and the whole name (see :meth:`Classifier.similarity`); of families of equal probability the first in
    NAMES. A paragraph that no template confirms is listed as unknown, whatever it holds. A null or empty text has no
    paragraphs. Repeated rows all come back. An empty table gives no rows (and a classifier without the corpus's examples).
    The fit takes the rows of least hash, so it depends on the rows, not on their order or place.
    Other columns play no part.
    """
    held = spark.sparkContext.broadcast(classifier or fit(docs))
    one = T.StructType([T.StructField("paragraph", T.LongType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("similarity", T.DoubleType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_paragraphs", T.LongType()), T.StructField("found", T.ArrayType(one))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c: Classifier = held.value
        kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))
        for b in batches:
            counts: list[int] = []
            found: list[list[dict]] = []
            for x, y, texts in text_slices(b.column(1), CUT_BYTES):
                lines = [t.split(b"\n") for t in texts]
                flat = [p for ls in lines for p in ls]
                owner = np.repeat(np.arange(y - x), [len(ls) for ls in lines])
                number = np.concatenate([np.arange(len(ls)) for ls in lines])
                words = tokens(flat)
                real = np.fromiter((bool(p.strip()) for p in flat), bool, len(flat))
                counts += np.bincount(owner[real], minlength=y - x).tolist()
                rows: list[list[dict]] = [[] for _ in range(y - x)]
                where, first, last = windows(words)
                p = c.probabilities(words, first, last)
                order = np.lexsort((p[:, -1], where))
                best = order[np.flatnonzero(np.diff(where[order], prepend=-1))]
                hashes = None
                for k in best[1 - p[best, -1] >= c.threshold].tolist():
                    i = int(where[k])
                    hashes = words.hashes() if hashes is None else hashes
                    mine = hashes[words.at[i] : words.at[i + 1]]
                    for family in np.argsort(-p[k, :-2], kind="stable")[:3].tolist():
                        near = c.similarity(mine, family)
                        if near >= confirm:
                            break
                    else:
                        family, near = -1, 0.0
                    rows[owner[i]].append({"paragraph": int(number[i]), "family": UNKNOWN if family < 0 else c.families[family], "probability": round(float(p[k, family] if family >= 0 else 1 - p[k, -1]), 6), "similarity": round(near, 6)})
                found += rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], names=schema.names)
            b = None
            release_memory()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
