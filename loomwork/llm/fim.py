"""Fill-in-middle: units by zero-width boundaries between neighbouring classes, cut twice, put together in another order.

A unit grammar says which classes of code points there are and which neighbours stay in one unit. It becomes a regular
expression of lookbehinds and lookaheads that matches, with no width, wherever one unit ends and the next begins; Spark's
split at it loses no character, so the pieces are the units.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: A literal beyond the basic plane that can't match: with it, lookbehinds go by code points and not by UTF-16 units.
WIDE = "|(?!)\U00010000"


@dataclass(frozen=True)
class Grammar:
    """``classes``: Java character classes by name, each code point in one of them. ``together``: neighbours (left, right) within a unit."""

    classes: dict[str, str]
    together: frozenset[tuple[str, str]] = frozenset()

    def boundary(self) -> str:
        """The zero-width boundary: a character of one class behind, one that doesn't belong to its unit ahead."""
        if len(self.classes) == 1 and not self.together:  # every code point is a unit: no lookbehind has to tell classes apart
            return r"(?s)(?<=.)(?=.)"
        ways = []
        for left, behind in self.classes.items():
            ahead = "".join(c for right, c in self.classes.items() if (left, right) not in self.together)
            if ahead:
                ways.append(f"(?<={behind})(?=[{ahead}])")
        return "|".join(ways) + WIDE


_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
GRAMMARS = {
    "char": Grammar({"any": r"[\s\S]"}),
    # a word with the white space behind it
    "word": Grammar({"space": _SPACE, "word": _WORD}, frozenset({("word", "word"), ("word", "space"), ("space", "space")})),
    # a line with its newline
    "line": Grammar({"end": r"[\n]", "text": r"[^\n]"}, frozenset({("text", "text"), ("text", "end")})),
    # runs of letters, of digits and of white space; every other character alone
    "token": Grammar({"letter": r"[\p{L}\p{M}]", "digit": r"[\p{N}]", "space": _SPACE, "mark": r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]"}, frozenset({("letter", "letter"), ("digit", "digit"), ("space", "space")})),
}


def units(text: Column, grammar: Grammar) -> Column:
    """The units of a text in order; joined they are the text. The empty text gives one empty piece, so count it apart (:func:`n_units`)."""
    return F.split(text, grammar.boundary(), -1)


def n_units(text: Column, pieces: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(pieces))


def draws(seed: int, doc_id: Column, n: int = 4) -> list[Column]:
    """The first ``n`` 8-digit groups of the SHA-256 of seed:doc_id as unsigned integers; a null id counts as empty."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def _checked(sentinels: tuple[str, str, str]) -> None:
    """A sentinel's first character occurs nowhere else in a sentinel: so none can arise where a piece meets one."""
    if not all(sentinels) or len(set(sentinels)) < 3 or any(t[0] in s[1:] for s in sentinels for t in sentinels):
        raise ValueError("sentinels must differ, and their first characters occur nowhere else in them")


def fill_in_middle(docs: DataFrame, grammar: Grammar | str = "char", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``docs`` with fim_units (long), fim_form, fim_prefix, fim_middle, fim_suffix (null if plain) and fim_output.

    A text of n units is cut after the smaller and after the larger of two draws from 0 to n (:func:`draws`). Form is plain if
    the text is empty or holds a sentinel, or by the third draw; otherwise spm or psm by the fourth. plain: the text; psm:
    prefix, suffix, middle, each behind its sentinel; spm: suffix, prefix, middle. :func:`restored` is the way back.

    A null text counts as empty and gives an empty output. A row depends on its doc_id and text alone: ties and repeated rows
    give equal results, a null doc_id is drawn for as the empty string. An empty table gives an empty result. Other columns
    pass through; columns with the names of the results are replaced. No row is shuffled. A text is split whole in the task
    that holds its row, at about 100 bytes a unit.
    """
    _checked(sentinels)
    grammar = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    made = ["fim_units", "fim_form", "fim_prefix", "fim_middle", "fim_suffix", "fim_output"]
    keep = [c for c in docs.columns if c.lower() not in made]
    mark = "_" * (1 + max(len(c) for c in docs.columns))  # longer than any name of the input
    t, p, n, a, b = (f"{mark}{x}" for x in "tpnab")
    h = draws(seed, F.col("doc_id"))
    rows = docs.select(*(f"`{c}`" for c in keep), F.coalesce(F.col("text"), F.lit("")).alias(t)).withColumn(p, units(F.col(t), grammar)).withColumn(n, n_units(F.col(t), F.col(p)).cast("long"))
    rows = rows.withColumns({a: F.least(h[0] % (F.col(n) + 1), h[1] % (F.col(n) + 1)).cast("int"), b: F.greatest(h[0] % (F.col(n) + 1), h[1] % (F.col(n) + 1)).cast("int")})
    held = F.lit(False)
    for s in sentinels:
        held = held | F.contains(F.col(t), F.lit(s))
    form = F.when((F.col(t) == "") | held | (h[2] % 100 >= 100 - plain_percent), PLAIN).when(h[3] % 100 < spm_percent, SPM).otherwise(PSM)
    pieces = lambda start, count: F.array_join(F.slice(p, start, count), "")
    rows = rows.withColumns({"fim_form": form, "fim_units": F.col(n)})
    cut = F.col("fim_form") != PLAIN
    rows = rows.withColumns({"fim_prefix": F.when(cut, pieces(F.lit(1), F.col(a))), "fim_middle": F.when(cut, pieces(F.col(a) + 1, F.col(b) - F.col(a))), "fim_suffix": F.when(cut, pieces(F.col(b) + 1, (F.col(n) - F.col(b)).cast("int")))})
    pre, suf, mid = (F.concat(F.lit(s), F.col(f"fim_{x}")) for s, x in zip(sentinels, ("prefix", "suffix", "middle"), strict=True))
    output = F.when(F.col("fim_form") == PSM, F.concat(pre, suf, mid)).when(F.col("fim_form") == SPM, F.concat(suf, pre, mid)).otherwise(F.col(t))
    return rows.select(*(f"`{c}`" for c in keep), *made[:-1], output.alias("fim_output"))


def restored(output: Column | str, form: Column | str, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of the given form was made from; null if either is null."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == PSM, F.concat(first, middle, second)).when(form == SPM, F.concat(second, middle, first)).when(form == PLAIN, output)
