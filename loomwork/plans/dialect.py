"""Pieces of DuckDB SQL for the oracles, written apart from the column functions."""

from __future__ import annotations

MARKS = {"full": [("×", "错误"), ("✗", "错误"), ("✓", "正确"), ("√", "正确")], "reward": [("×", "错误"), ("✓", "正确"), ("√", "正确")], "badcase": [("×", "错误"), ("✓", "正确"), ("√", "正确")]}


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def tag(x: str, name: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '(?s)<{name}>.*?</{name}>') THEN {strip(f"regexp_extract({x}, '(?s)<{name}>(.*?)</{name}>', 1)")} END"


def norm(x: str, form: str = "full") -> str:
    out = f"lower({strip(x)})"
    for name in ("text", "boxed", *(("mathrm",) if form != "badcase" else ())):
        out = rf"regexp_replace({out}, '\\{name}\{{(.*?)\}}', '\1', 'g')"
    if form == "reward":
        out = rf"replace({out}, '\dfrac', '\frac')"
    for a, b in MARKS[form]:
        out = f"replace({out}, '{a}', '{b}')"
    return rf"""regexp_replace(regexp_replace({out}, '\s+', '', 'g'), '^["''$]+|["''$]+$', '', 'g')"""


def num(x: str) -> str:
    return rf"try_cast(replace(regexp_extract({x}, '^(-?[\d,]+\.?\d*)', 1), ',', '') AS DOUBLE)"


def scored(view: str, form: str = "full", name: str = "scored") -> str:
    """CTE members: ``view`` with a (the tag), last_line, np, ng, ok (tag against answer), complete."""
    return rf"""{name}_0 AS (SELECT *, {tag('prediction', 'answer')} AS a, {strip(f"list_last(string_split({strip('prediction')}, chr(10)))")} AS last_line,
    regexp_extract(prediction, '(?s)<think>(.*?)</think>', 1) AS think FROM {view}),
  {name}_1 AS (SELECT *, {norm("coalesce(a, '')", form)} AS np, {norm("coalesce(answer, '')", form)} AS ng, coalesce(a, last_line) AS fb FROM {name}_0),
  {name}_2 AS (SELECT *, np = ng OR coalesce(abs({num('np')} - {num('ng')}) < 1e-6, false) AS same, {norm('fb', form)} AS nf FROM {name}_1),
  {name} AS (SELECT *, coalesce(a <> '', false) AND same AS ok, nf = ng OR coalesce(abs({num('nf')} - {num('ng')}) < 1e-6, false) AS fb_ok,
    CASE WHEN NOT contains(prediction, '</think>') THEN 'no_</think>' WHEN NOT contains(prediction, '<answer>') THEN 'no_<answer>'
      WHEN NOT contains(prediction, '</answer>') THEN 'no_</answer>' WHEN coalesce(a, '') = '' THEN 'empty_answer' ELSE 'complete' END AS completeness
    FROM {name}_2)"""


BOX = r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"


def boxes(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{BOX}', 1), lambda b: {strip('b')})"


def full_boxes(x: str) -> str:
    return f"list_filter({boxes(x)}, lambda b: b <> '')"


def pct(x: str, p: float) -> str:
    """sorted[min(n - 1, int(n p))] of an aggregate's values."""
    return f"list_sort(list({x}))[least(count({x}) - 1, CAST(floor(count({x}) * {p}) AS BIGINT)) + 1]"


def question(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]+', '', 'g')"


def toks(x: str) -> str:
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')"


MATH = "'<|im_start|>user' || chr(10) || instruction || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || reasoning || chr(10) || '</think>' || chr(10) || chr(10) || '<answer>' || chr(10) || answer || chr(10) || '</answer><|im_end|>'"
PREFIX = "'<|im_start|>user' || chr(10) || instruction || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"
