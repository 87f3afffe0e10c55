"""Answer equivalence: three normal forms, numbers, comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.text import _col, strip

#: The commands unwrapped, and the marks replaced, by each normal form.
FORMS = {
    "full": (("text", "boxed", "mathrm"), (("×", "错误"), ("✗", "错误"), ("✓", "正确"), ("√", "正确"))),
    "reward": (("text", "boxed", "mathrm"), (("×", "错误"), ("✓", "正确"), ("√", "正确"))),
    "badcase": (("text", "boxed"), (("×", "错误"), ("✓", "正确"), ("√", "正确"))),
}


def normalize_answer(c: Column | str, form: str = "full") -> Column:
    """``full`` for evaluation, ``reward`` for rewards (which also reads dfrac as frac), ``badcase`` for the bad-case report."""
    commands, marks = FORMS[form]
    text = F.lower(strip(_col(c).cast("string")))
    for name in commands:
        text = F.regexp_replace(text, rf"\\{name}\{{(.*?)\}}", "$1")
    if form == "reward":
        text = F.replace(text, F.lit("\\dfrac"), F.lit("\\frac"))
    for old, new in marks:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", ""), r"^[\"'$]+|[\"'$]+$", "")


def extract_number(c: Column | str) -> Column:
    """The number that the text begins with, thousands separators dropped; null if it begins with none. "3/4" gives 3."""
    text = F.regexp_replace(_col(c).cast("string"), r"(?U)\s+", "")
    return F.replace(F.regexp_extract(text, r"^(-?[\d,]+\.?\d*)", 1), F.lit(","), F.lit("")).try_cast("double")


def check_correct(pred: Column | str, gold: Column | str, form: str = "full") -> Column:
    """Equal normal forms, or leading numbers within 1e-6. Null counts as empty."""
    p, g = (normalize_answer(F.coalesce(_col(x).cast("string"), F.lit("")), form) for x in (pred, gold))
    near = F.abs(extract_number(p) - extract_number(g)) < 1e-6
    return (p == g) | F.coalesce(near, F.lit(False))
