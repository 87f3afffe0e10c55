"""Column functions against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomwork.functions import scoring as S
from loomwork.functions import text as X
from loomwork.functions.answers import check_correct, extract_number, normalize_answer


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(df.select("i", f("v").alias("o")).collect())]


def partners(text):
    """The place of each brace that closes one, by the place of that one."""
    out, waiting = {}, []
    for i, c in enumerate(text):
        if c == "{":
            waiting.append(i)
        elif c == "}" and waiting:
            out[waiting.pop()] = i
    return out


def boxes(text):
    """Every brace with its partner; of the markers whose brace has one, those in no other such pair."""
    partner = partners(text)
    pairs = [(m.end() - 1, partner[m.end() - 1]) for m in re.finditer(r"\\boxed\{", text) if m.end() - 1 in partner]
    return [text[x + 1 : y].strip() for x, y in pairs if not any(u < x and y < v for u, v in pairs)]


def first_box(text):
    """What the first marker's brace encloses."""
    found = re.search(r"\\boxed\{", text)
    end = partners(text).get(found.end() - 1) if found else None
    return None if end is None else text[found.end() : end].strip()


@pytest.mark.parametrize(
    "text,want",
    [
        (r"so \boxed{-7.5}.", ["-7.5"]), (r"\boxed{\sqrt{2}+\binom{5}{2}}", [r"\sqrt{2}+\binom{5}{2}"]), (r"\boxed{u}\boxed{ v }\boxed{w}", ["u", "v", "w"]), (r"open \boxed{\sqrt{9}", []), ("no box {here}", []),
        (r"\boxed{p + \boxed{q}", ["q"]), (r"\boxed{1 \boxed{2} 3} and \boxed{4}", [r"1 \boxed{2} 3", "4"]), (r"\boxed{ }", [""]), (r"}} \boxed{y} }", ["y"]), (r"{\boxed{z}}", ["z"]),
    ],
)
def test_boxes(spark, text, want):
    assert boxes(text) == want
    assert column(spark, X.balanced_boxes, [text]) == [want]


def test_boxes_of_random_texts(spark):
    rnd = random.Random(1)
    cases = ["".join(rnd.choice(["\\boxed{", "{", "}", "a", " ", "boxed"]) for _ in range(rnd.randint(0, 14))) for _ in range(800)]
    assert column(spark, X.balanced_boxes, cases) == [boxes(c) for c in cases]
    assert column(spark, X.first_box, cases) == [first_box(c) for c in cases]
    assert column(spark, X.balanced_boxes, [None]) == [None]


def test_tags_and_last_line(spark):
    v = ["<answer> 4\n </answer>", "a\nb \n", "<answer></answer>", "", "<think>x</think><answer>1</answer><answer>2</answer>"]
    assert column(spark, lambda c: X.tag(c, "answer"), v) == ["4", None, "", None, "1"]
    assert column(spark, X.answer_or_last_line, v) == ["4", "b", "", "", "1"]


def test_answers(spark):
    v = ["  \\text{Yes} ", "\\boxed{ 3 }", "×", "✗", "√", '"a b"', "$5$", "\\mathrm{x}", "\\dfrac{1}{2}"]
    assert column(spark, normalize_answer, v) == ["yes", "3", "错误", "错误", "正确", "ab", "5", "x", "\\dfrac{1}{2}"]
    assert column(spark, lambda c: normalize_answer(c, "reward"), v)[3:4] + column(spark, lambda c: normalize_answer(c, "reward"), v)[-1:] == ["✗", "\\frac{1}{2}"]
    assert column(spark, lambda c: normalize_answer(c, "badcase"), v)[-2] == "\\mathrm{x}"
    assert column(spark, extract_number, ["1,200.50 m", "-3", "x3", "3/4", "", ","]) == [1200.5, -3.0, None, 3.0, None, None]
    pairs = spark.createDataFrame([("3/4", "3/5"), ("12cm", "12"), ("a", "A "), ("1", "2"), (None, "")], "p string, g string")
    assert [r[0] for r in pairs.select(check_correct("p", "g")).collect()] == [True, True, True, False, True]


def test_ngrams_and_normal_form(spark):
    v = ["abcdefg", "abc", "", "ababababab", "漢字かな交じり"]
    want = [{t[i : i + 5] for i in range(len(t) - 4)} if len(t) > 5 else {t} for t in v]
    assert [set(x) for x in column(spark, X.ngrams, v)] == want
    assert column(spark, X.normalize_question, ["Ａ b_C, é!", "１２ 漢字。"]) == ["ab_cé", "12漢字"]


def test_steps(spark):
    long = "。".join(["句" * 60] * 4)
    v = ["a\n\nb\n \nc", "a\nb", " ", "one", long]
    assert column(spark, X.split_steps, v) == [["a", "b", "c"], ["a", "b"], [], ["one"], ["句" * 60 + "."] * 4]
    assert column(spark, lambda c: X.split_steps(c, by_sentence=False), v)[-1] == [long]


def test_teacher_text_and_json(spark):
    assert column(spark, X.teacher_text, ["a\\r\\nb\\n\\nc\\neq\\nX"]) == ["a\nb\n\nc\\neq\nX"]
    assert column(spark, X.model_json, ['```json\n{"a": 1}\n```', 'Sure {"a": 1} ok', "no", None]) == ['{"a": 1}', '{"a": 1}', None, None]
    assert column(spark, lambda c: X.compact(c, 10), ["0123456789", "0123456789ab"]) == ["0123456789", "0123" + X.COMPACT_MARK + "6789ab"]


def test_completeness_and_classes(spark):
    v = ["<think>a", "<think>a</think>", "<think>a</think><answer>4", "<think>a</think><answer> </answer>", "<think>a</think><answer>4</answer>"]
    assert column(spark, S.completeness, v) == ["no_</think>", "no_<answer>", "no_</answer>", "empty_answer", "complete"]
    df = spark.createDataFrame([(p, "4") for p in v], "prediction string, answer string")
    assert [r[0] for r in df.select(S.comparison_class()).collect()] == ["truncated", "no_answer", "no_answer", "wrong", "correct"]
    assert [r[0] for r in df.select(S.badcase_class()).collect()] == ["truncated"] * 3 + ["semantic", "correct"]


def test_rewards(spark):
    def v2(p, right):
        think = re.search(r"<think>(.*?)</think>", p, re.S)
        n = len(think.group(1)) if think else 0
        if "</answer>" not in p:
            return 0.0
        eff = 0 if n == 0 else 0.3 if n < 200 else 1.0 if n < 800 else 0.65 if n < 1500 else 0.3 if n < 2500 else 0.05
        bonus = (0.15 if n < 500 else 0.08 if n < 1000 else 0) if right and n else 0
        return min(1.0, 0.6 * right + 0.15 * ("</think>" in p) + 0.25 * eff + bonus)

    cases = [(f"<think>{'x' * n}</think><answer>{a}</answer>", a == 4) for n in (0, 10, 300, 900, 1600, 3000) for a in (4, 5)] + [("<answer>4", False), ("<answer>4</answer>", True)]
    df = spark.createDataFrame([(i, p, "4") for i, (p, _) in enumerate(cases)], "i int, prediction string, answer string")
    got = [r[1] for r in sorted(df.select("i", S.reward_v2()["total"]).collect())]
    assert got == pytest.approx([v2(p, r) for p, r in cases])


def test_chat(spark):
    m = [("system", "s"), ("user", "q"), ("assistant", "<think>\nr\n</think>\n\na"), ("tool", "t1"), ("tool", "t2"), ("user", "again"), ("assistant", "<think>\nr2\n</think>\n\nb")]
    df = spark.createDataFrame([(m,)], "m array<struct<role:string,content:string>>")
    s, e = "<|im_start|>", "<|im_end|>\n"
    want = f"{s}system\ns{e}{s}user\nq{e}{s}assistant\na{e}{s}user\n<tool_response>\nt1\n</tool_response>\n<tool_response>\nt2\n</tool_response>{e}{s}user\nagain{e}{s}assistant\n<think>\nr2\n</think>\n\nb{e}"
    assert df.select(X.render_chat(F.col("m"))).first()[0] == want
    assert df.select(X.render_chat(F.col("m"), True, False)).first()[0] == want + f"{s}assistant\n<think>\n\n</think>\n\n"


def test_chat_with_tools(spark):
    """Schemas, calls and reasoning fields as the template writes them; nested values as a JSON text with Python's spacing."""
    import json

    tools = [{"type": "function", "function": {"name": "f", "description": 'says "hi: you, there" \\ é\n\x1f', "parameters": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {}}, "required": ["a", "b"], "x": [1, -2.5, True, None, []]}}}, {"name": "g"}]
    call = "struct<name:string,arguments:struct<q:string,n:int,l:array<int>>>"
    kind = f"array<struct<role:string,content:string,reasoning_content:string,tool_calls:array<{call}>>>"
    m = [("system", "s", None, None), ("user", "q", None, None), ("assistant", "", "think\n", [("f", ('a "b", c: d', 3, [1, 2])), ("g", ("", None, []))]), ("tool", "t1", None, None), ("tool", "t2", None, None), ("assistant", "\n\nso", "\nmore\n", None), ("user", "<tool_response>x</tool_response>", None, None), ("assistant", "<think>\nr\n</think>\n\nend", None, [])]
    df = spark.createDataFrame([(m, [json.dumps(t, separators=(",", ":")) if i else json.dumps(t, indent=2, ensure_ascii=False) for i, t in enumerate(tools)]), (m[1:], None), (None, [])], f"m {kind}, t array<string>")
    s, e = "<|im_start|>", "<|im_end|>\n"
    said = f"""{s}user\nq{e}{s}assistant\n<think>\nthink\n</think>\n\n<tool_call>\n{{"name": "f", "arguments": {{"q": "a \\"b\\", c: d", "n": 3, "l": [1, 2]}}}}\n</tool_call>\n<tool_call>\n{{"name": "g", "arguments": {{"q": "", "l": []}}}}\n</tool_call>{e}"""
    said += f"{s}user\n<tool_response>\nt1\n</tool_response>\n<tool_response>\nt2\n</tool_response>{e}{s}assistant\n<think>\nmore\n</think>\n\nso{e}{s}user\n<tool_response>x</tool_response>{e}{s}assistant\n<think>\nr\n</think>\n\nend{e}"
    head = f"{s}system\ns\n\n{X.TOOLS_HEAD}" + "".join("\n" + json.dumps(t, ensure_ascii=False) for t in tools) + X.TOOLS_TAIL + e
    got = df.select(X.render_chat(F.col("m"), message=df.schema["m"].dataType.elementType, tools=F.col("t"))).collect()
    assert [r[0] for r in got] == [head + said, said, None]
    # calls in a field of their own, with arguments that are text already; no reasoning field
    kind = "array<struct<role:string,content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>"
    df = spark.createDataFrame([([("user", "q", None), ("assistant", "a", [(("f", '{"x":1}'),)])],)], f"m {kind}")
    got = df.select(X.render_chat(F.col("m"), message=df.schema["m"].dataType.elementType)).first()[0]
    assert got == f'{s}user\nq{e}{s}assistant\n<think>\n\n</think>\n\na\n<tool_call>\n{{"name": "f", "arguments": {{"x":1}}}}\n</tool_call>{e}'
