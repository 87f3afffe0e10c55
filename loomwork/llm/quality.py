"""Quality rules as a short-circuit cascade, ordered by rejections per cost as measured on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import hash_sample
from loomwork.llm.textkit import IS_SPACE, Words, as_bytes, mix, release_memory, slices, spans_hash, text_slices, whole_windows, windows_hash

#: Rows on which costs and selectivities are estimated, at most so many: those of least hash of doc_id and text.
SAMPLE_ROWS = 2000
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
#: ASCII letters, and first bytes of code points beyond ASCII.
IS_LETTER = np.array([b >= 0xC0 or chr(b).isalpha() and b < 0x80 for b in range(256)])
REPEAT_WINDOW = 3


class Texts:
    """Some texts, with what the rules share computed at first use."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self._words: Words | None = None
        self._stats: dict[str, np.ndarray] = {}

    @property
    def words(self) -> Words:
        if self._words is None:
            self._words = Words(self.texts)
        return self._words

    def stat(self, name: str) -> np.ndarray:
        """A statistic of STATS for each text, computed once."""
        if name not in self._stats:
            self._stats[name] = STATS[name](self)
        return self._stats[name]

    def take(self, which: np.ndarray) -> Texts:
        """Some of the texts, with the statistics that are known."""
        if len(which) == len(self.texts):
            return self
        out = Texts([self.texts[i] for i in which])
        out._stats = {k: v[which] for k, v in self._stats.items()}
        return out


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[at[1:]] - total[at[:-1]]


def n_words(t: Texts) -> np.ndarray:
    return np.diff(t.words.at)


def word_chars(t: Texts) -> np.ndarray:
    """Code points in words."""
    buf = t.words.buf
    return _per_text(((buf & 0xC0) != 0x80) & ~IS_SPACE[buf], t.words.text_at)


def n_symbols(t: Texts) -> np.ndarray:
    return _per_text(IS_SYMBOL[t.words.buf], t.words.text_at)


def _again(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each key: 0 if it is the only one of its value in its group, 1 if the first of several, 2 if a later one."""
    code = mix(keys + mix(group.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(code, kind="stable")
    code = code[order]
    same = np.r_[False, code[1:] == code[:-1]] if len(code) else np.zeros(0, bool)
    out = np.zeros(len(code), np.int8)
    out[order[same]] = 2
    first = np.r_[same[1:], False] & ~same if len(code) else same
    out[order[first]] = 1
    return out


def n_repeat_words(t: Texts) -> np.ndarray:
    """Words that some 3-word window covers which the text holds twice or more."""
    w = t.words
    at = whole_windows(w, REPEAT_WINDOW)
    keys = windows_hash(w.hashes(), REPEAT_WINDOW)[at]
    begin = at[_again(keys, w.text_of()[at]) > 0]
    covered = np.zeros(len(w), bool)
    for j in range(REPEAT_WINDOW):
        covered[begin + j] = True
    return _per_text(covered, w.at)


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each line, and whether it has a word."""
    buf = t.words.buf
    end = np.flatnonzero(buf == 10)
    start = np.r_[0, end[:-1] + 1] if len(end) else end
    text = np.searchsorted(t.words.text_at, start, "right") - 1
    total = np.r_[0, np.cumsum(~IS_SPACE[buf])]
    return start, end, text, total[end] > total[start]


def n_dup_lines(t: Texts) -> np.ndarray:
    """Lines with a word that equal an earlier line."""
    start, end, text, real = _lines(t)
    start, end, text = start[real], end[real], text[real]
    later = _again(spans_hash(t.words.buf, start, end), text) == 2
    return np.bincount(text[later], minlength=len(t.texts))


def n_real_lines(t: Texts) -> np.ndarray:
    _, _, text, real = _lines(t)
    return np.bincount(text[real], minlength=len(t.texts))


def n_top_word(t: Texts) -> np.ndarray:
    """How often the most frequent word with a letter occurs."""
    w = t.words
    total = np.r_[0, np.cumsum(IS_LETTER[w.buf])]
    real = total[w.end] > total[w.start]
    out = np.zeros(len(t.texts), np.int64)
    if real.any():
        text, hashes = w.text_of()[real], w.hashes()[real]
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        edge = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])
        np.maximum.at(out, text[edge], np.diff(np.r_[edge, len(order)]))
    return out


def n_letters(t: Texts) -> np.ndarray:
    """ASCII letters and code points beyond ASCII."""
    return _per_text(IS_LETTER[t.words.buf], t.words.text_at)


def _line_ends(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: its start, the places of its first and of its last byte in a word, and its text number."""
    start, end, text, real = _lines(t)
    inside = np.flatnonzero(~IS_SPACE[t.words.buf])
    start, end, text = start[real], end[real], text[real]
    return start, inside[np.searchsorted(inside, start)], inside[np.searchsorted(inside, end) - 1], text


def n_bullet_lines(t: Texts) -> np.ndarray:
    """Lines with a word that begin with - or *."""
    _, first, _, text = _line_ends(t)
    return np.bincount(text[np.isin(t.words.buf[first], (0x2D, 0x2A))], minlength=len(t.texts))


def n_open_lines(t: Texts) -> np.ndarray:
    """Lines with a word that end with three full stops or an ellipsis."""
    start, _, last, text = _line_ends(t)
    buf, inner = t.words.buf, last - 2 >= start
    at = np.maximum(last, 2)
    three = [buf[at - 2], buf[at - 1], buf[at]]
    hit = inner & np.any([np.all([x == y for x, y in zip(three, mark, strict=True)], axis=0) for mark in (b"...", "…".encode())], axis=0)
    return np.bincount(text[hit], minlength=len(t.texts))


#: What op7 returns comes first.
BASE_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS: dict[str, Callable[[Texts], np.ndarray]] = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "n_real_lines": n_real_lines, "n_top_word": n_top_word, "n_letters": n_letters, "n_bullet_lines": n_bullet_lines, "n_open_lines": n_open_lines}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives a boolean for each text."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def too_short(t: Texts) -> np.ndarray:
    return t.stat("n_words") < 50


def too_repetitive(t: Texts) -> np.ndarray:
    return 100 * t.stat("n_repeat_words") > 50 * t.stat("n_words")


def too_many_symbols(t: Texts) -> np.ndarray:
    return 10 * t.stat("n_symbols") > 5 * t.stat("n_words")


def odd_words(t: Texts) -> np.ndarray:
    n, chars = t.stat("n_words"), t.stat("word_chars")
    return (chars < 2 * n) | (chars > 20 * n)


def repeated_lines(t: Texts) -> np.ndarray:
    return 2 * t.stat("n_dup_lines") > t.stat("n_real_lines")


def one_word(t: Texts) -> np.ndarray:
    return 100 * t.stat("n_top_word") > 30 * t.stat("n_words")


def few_letters(t: Texts) -> np.ndarray:
    return 2 * t.stat("n_letters") < t.stat("word_chars")


def bullet_lines(t: Texts) -> np.ndarray:
    return 10 * t.stat("n_bullet_lines") > 9 * t.stat("n_real_lines")


def open_lines(t: Texts) -> np.ndarray:
    return 10 * t.stat("n_open_lines") > 3 * t.stat("n_real_lines")


#: The base rules and the cascade's further rules. Statistics that no earlier rule needed are worked out for what is left only.
BASE_RULES = (Rule("too_short", too_short), Rule("too_repetitive", too_repetitive))
RULES = (*BASE_RULES, *(Rule(f.__name__, f) for f in (too_many_symbols, odd_words, repeated_lines, one_word, few_letters, bullet_lines, open_lines)))


@dataclass(frozen=True)
class Estimate:
    rule: str
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        """Rejections for each second spent."""
        return self.rejected / max(self.seconds, 1e-9)


def estimate(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[Estimate]:
    """Cost (seconds a text) and selectivity of each rule alone, the best rejections per cost first.

    Cutting a text into words is no rule's cost: the cascade does so before its first rule, whichever that is.
    """
    out = []
    for rule in rules:
        spent, hit = 0.0, 0
        for a, b in slices(texts):
            t = Texts(texts[a:b])
            t.words  # noqa: B018
            began = time.perf_counter()
            hit += int(rule.rejects(t).sum())
            spent += time.perf_counter() - began
        out.append(Estimate(rule.name, spent / max(len(texts), 1), hit / max(len(texts), 1)))
    return sorted(out, key=lambda e: (-e.rank, e.rule))


def fit_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules in the order in which the cascade tries them. The order changes costs, never verdicts."""
    sample = hash_sample(docs, ["text"], sample_rows).toArrow().column("text")
    texts = [x for chunk in sample.chunks for x in as_bytes(chunk)]
    by_name = {r.name: r for r in rules}
    return tuple(by_name[e.rule] for e in estimate(texts, rules)) if texts else rules


def cascade(t: Texts, rules: tuple[Rule, ...]) -> list[str | None]:
    """The rule that rejects each text, or None. Each rule sees only what those before it let pass."""
    out: list[str | None] = [None] * len(t.texts)
    alive = np.arange(len(t.texts))
    for rule in rules:
        if not len(alive):
            break
        bad = rule.rejects(t)
        for i in alive[bad]:
            out[i] = rule.name
        if bad.any():
            t, alive = t.take(np.flatnonzero(~bad)), alive[~bad]
    return out


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] | None = None, stats: bool = False, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with rejected_by (string, null for kept rows) and, if asked for, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    ``rules``: in this order; None: ordered by :func:`fit_order`. A null text is empty, has no words and so is too short.
    Verdicts depend on a row's text alone: repeated rows get equal ones. An empty table gives an empty result. Extra
    columns pass through; columns with the names of new ones are replaced. rejected_by names the first rule in the
    cascade's order, so it may differ between runs where several rules reject a row; whether it is null may not.
    """
    rules = fit_order(docs, sample_rows=sample_rows) if rules is None else rules
    added = [*(BASE_STATS if stats else ()), "rejected_by"]
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in added))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(s, T.LongType()) for s in added[:-1]), T.StructField("rejected_by", T.StringType())])
    at = [c.lower() for c in docs.columns].index("text")
    names = [f.name for f in schema.fields]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found: list[list] = [[] for _ in added]
            for _, _, texts in text_slices(batch.column(at)):
                t = Texts(texts)
                for k, name in enumerate(added[:-1]):
                    found[k].append(t.stat(name))
                found[-1] += cascade(t, rules)
            cols = [pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64()) for x in found[:-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols, pa.array(found[-1], pa.string())], names=names)
        release_memory()

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns, one called rejected_by among them; see :func:`apply_rules`."""
    rules = fit_order(docs, sample_rows=sample_rows)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for x, y, texts in text_slices(batch.column(at)):
                yield batch.slice(x, y - x).filter(pa.array([r is None for r in cascade(Texts(texts), rules)], pa.bool_()))
        release_memory()

    return docs.mapInArrow(run, docs.schema)
