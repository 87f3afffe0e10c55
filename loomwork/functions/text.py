"""Column functions on text: tags, boxes, normal forms, prompts, steps. All but NFKC are native expressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markers and formats of the data.
BOX = "\\boxed{"
CHAT_START, CHAT_END = "<|im_start|>", "<|im_end|>"
COMPACT_MARK = "\n\n[中间重复/冗长部分已为节省上下文而省略；请根据题目、保留部分与参考答案重建严谨解法。]\n\n"
MATH_PATTERNS = [
    r"\d+\s*[\+\-\*\/\×\÷]\s*\d+",
    r"[＝=]\s*\d+",
    r"\\\\frac", r"\\\\sqrt",
    r"\bx\s*=", r"\by\s*=",
    r"\d+°",
    r"(sum|product|total|average|probability|percent)",
    r"(多少|计算|求解|等于|方程|面积|体积|角度|概率)",
    r"(angle|triangle|circle|square|rectangle)",
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def tag(c: Column | str, name: str) -> Column:
    """Stripped content of the first ``<name>…</name>``, null if there is none."""
    pattern = f"(?s)<{name}>(.*?)</{name}>"
    return F.when(_col(c).rlike(pattern), strip(F.regexp_extract(_col(c), pattern, 1)))


def think_text(c: Column | str) -> Column:
    """Raw content of the first think tag, empty if there is none."""
    return F.regexp_extract(_col(c), "(?s)<think>(.*?)</think>", 1)


def answer_or_last_line(c: Column | str) -> Column:
    """The answer tag's content, else the text's last line."""
    return F.coalesce(tag(c, "answer"), strip(F.element_at(F.split(strip(c), "\n", -1), -1)))


def balanced_boxes(c: Column | str) -> Column:
    """All outermost balanced ``\\boxed{…}`` contents, stripped, in order; an unbalanced box gives way to those inside it.

    A fold over markers, braces and what lies between them, with a stack of open braces; only texts with a marker take it.
    Null for null.
    """
    text = _col(c)
    opened = "array<struct<at:int,box:boolean>>"
    found = "array<struct<at:int,text:string>>"
    start = F.struct(F.lit(0).alias("i"), F.array().cast(opened).alias("open"), F.array().cast(found).alias("out"))
    pieces = F.regexp_extract_all(text, F.lit(r"(\\boxed\{|[{}]|[^{}\\]+|\\)"), F.lit(1))

    def step(s: Column, piece: Column) -> Column:
        i = s["i"] + F.length(piece)  # characters up to the piece's end, which is the brace of a marker
        top = F.try_element_at(s["open"], F.lit(-1))
        closes = (piece == "}") & top.isNotNull()
        inner = F.filter(s["out"], lambda o: o["at"] < top["at"])
        content = F.struct(top["at"].alias("at"), strip(F.substring(text, top["at"] + 1, i - top["at"] - 1)).alias("text"))
        stack = F.when(piece.isin("{", BOX), F.array_append(s["open"], F.struct(i.alias("at"), (piece == BOX).alias("box")))).when(closes, F.slice(s["open"], 1, F.size(s["open"]) - 1)).otherwise(s["open"])
        out = F.when(closes & top["box"], F.array_append(inner, content)).otherwise(s["out"])
        return F.struct(i.alias("i"), stack.alias("open"), out.alias("out"))

    folded = F.transform(F.aggregate(pieces, start, step)["out"], lambda o: o["text"])
    return F.when(text.contains(BOX), folded).when(text.isNotNull(), F.array().cast("array<string>"))


def first_box(c: Column | str) -> Column:
    """Content of the first marker if balanced, else null; later markers are not tried."""
    text = _col(c)
    at = F.instr(text, BOX)
    rest = F.substr(text, at + 7)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("end"))

    def step(s: Column, ch: Column) -> Column:
        depth = s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        i = s["i"] + 1
        return F.when(s["end"] > 0, s).otherwise(F.struct(depth.alias("depth"), i.alias("i"), F.when(depth == 0, i).otherwise(0).alias("end")))

    end = F.aggregate(F.split(rest, ""), start, step)["end"]
    return F.when((at > 0) & (end > 0), strip(F.substr(rest, F.lit(1), end - 1)))


def simple_boxes(c: Column | str) -> Column:
    """Contents of boxes without a closing brace in them."""
    return F.regexp_extract_all(_col(c), F.lit(r"\\boxed\{([^}]+)\}"), F.lit(1))


def last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def clean_answer_legacy(c: Column | str) -> Column:
    """The older answer cleaning, with its leading character class that eats letters; kept for parity, prefer :func:`balanced_boxes`."""
    text = strip(c)
    boxes = simple_boxes(text)
    # Fixed value: the class of characters that may lead.
    lead = r"(?i)^[因此所以故综上答案最终答案ThusThereforeHenceSoThe answer is]+[，,:.：\s]*"
    plain = strip(F.regexp_replace(text, lead, ""))
    for mark in ("\\(", "\\)", "\\[", "\\]"):
        plain = F.replace(plain, F.lit(mark), F.lit(""))
    number = last(F.regexp_extract_all(plain, F.lit(r"(-?\d+\.?\d*)"), F.lit(1)))
    return F.when(F.size(boxes) > 0, strip(last(boxes))).otherwise(strip(F.when(F.length(plain) > 100, F.coalesce(number, plain)).otherwise(plain)))


#: Texts of these characters only are in NFKC: ASCII, and letters of Latin, Cyrillic, kana and Han scripts that nothing is composed with.
NFKC_FORM = r"^[\x00-\x7F\u00C0-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0400-\u045F\u3001\u3002\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5]*$"


def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


#: Unicode NFKC; Spark has no builtin for it. Marked as non-deterministic so that no plan runs it twice for one column.
nfkc = F.pandas_udf(_nfkc, T.StringType()).asNondeterministic()


def normalize_question(c: Column | str, compat: bool = True) -> Column:
    """NFKC, lower case, word characters only. Texts that show they are in NFKC don't leave the JVM; ``compat=False`` takes all for such."""
    text = _col(c)
    if compat:
        text = F.coalesce(nfkc(F.when(~text.rlike(NFKC_FORM), text)), text)
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")


def ngrams(c: Column | str, n: int = 5) -> Column:
    """The set of character n-grams; a text of up to n characters is its own."""
    grams = F.array_distinct(F.regexp_extract_all(_col(c), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
    return F.when(F.length(_col(c)) <= n, F.array(_col(c))).otherwise(grams)


def repair_control_chars(c: Column | str) -> Column:
    """``\\b`` and ``\\f`` that an escape has eaten, put back before ``oxed`` and ``rac``."""
    return F.replace(F.replace(_col(c), F.lit("\x08oxed"), F.lit("\\boxed")), F.lit("\x0crac"), F.lit("\\frac"))


def has_control_char(c: Column | str) -> Column:
    return _col(c).rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def is_math(*columns: Column | str) -> Column:
    """Whether any of the math patterns occurs in the columns, joined by spaces."""
    text = F.concat_ws(" ", *map(_col, columns))
    return reduce(lambda a, b: a | b, (text.rlike(f"(?i){p}") for p in MATH_PATTERNS))


def suffix_answer(c: Column | str) -> Column:
    """First line after 答案是 and a colon, without full stops at its end; null if absent or over 50 characters."""
    pattern = r"(?s)答案是[：:]\s*(.+)"
    line = strip(F.element_at(F.split(strip(F.regexp_extract(_col(c), pattern, 1)), "\n", -1), 1))
    raw = F.regexp_replace(line, r"[.。]+$", "")
    return F.when(_col(c).rlike(pattern) & (F.length(raw) <= 50), strip(raw))


def sha_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by newlines, as hex; nulls count as empty."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(_col(p), F.lit("")) for p in parts)), 256)


def candidate_id(source: Column | str = "source", instruction: Column | str = "instruction") -> Column:
    return F.substring(sha_key(source, instruction), 1, 20)


def stable_key(seed: int, namespace: str, source: Column | str = "source", normalized: Column | str = "normalized") -> Column:
    """Order key of a row in a namespace."""
    return sha_key(F.lit(namespace), F.lit(str(seed)), source, normalized)


#: Escapes that a teacher writes out, and what they stand for; the last is none before a lower-case letter, where a LaTeX command begins.
WRITTEN_OUT = ((r"\\r\\n", "\n"), (r"\\n\\n", "\n\n"), (r"\\n(?=[^a-z])", "\n"))


def teacher_text(c: Column | str) -> Column:
    """The text with escapes that were written out resolved."""
    text = _col(c)
    for pattern, plain in WRITTEN_OUT:
        text = F.regexp_replace(text, pattern, plain)
    return text


def compact(c: Column | str, max_chars: int = 12_000) -> Column:
    """A long text's first two fifths and last three fifths of ``max_chars``, with a mark between."""
    head = max_chars * 2 // 5
    text = _col(c)
    return F.when(F.length(text) <= max_chars, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(COMPACT_MARK), F.right(text, F.lit(max_chars - head))))


def model_json(c: Column | str) -> Column:
    """The JSON object text in a reply: without a code fence, else from the first to the last brace; null where neither parses."""
    text = strip(F.coalesce(_col(c), F.lit("")))
    text = F.when(text.startswith("```"), F.regexp_replace(text, r"(?i)^```(?:json)?\s*|\s*```$", "")).otherwise(text)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parses = lambda t: F.get_json_object(t, "$").isNotNull()
    return F.when(parses(text), text).when(parses(inner), inner)


def step_score(c: Column | str) -> Column:
    """The number ``score`` of a scorer's reply, fenced or not; null where it doesn't parse."""
    text = strip(c)
    text = F.when(text.contains("```json"), F.element_at(F.split(F.element_at(F.split(text, "```json", -1), 2), "```", -1), 1)).when(text.contains("```"), F.element_at(F.split(text, "```", -1), 2)).otherwise(text)
    return F.get_json_object(strip(text), "$.score").try_cast("double")


def chat_turn(role: str, content: Column) -> Column:
    return F.concat(F.lit(f"{CHAT_START}{role}\n"), content, F.lit(CHAT_END))


def math_response(reasoning: Column | str = "reasoning", answer: Column | str = "answer") -> Column:
    r, a = (F.coalesce(_col(x), F.lit("")) for x in (reasoning, answer))
    return F.concat(F.lit("<think>\n"), r, F.lit("\n</think>\n\n<answer>\n"), a, F.lit("\n</answer>"))


def instruction_prefix(instruction: Column | str = "instruction") -> Column:
    return F.concat(chat_turn("user", _col(instruction)), F.lit(f"\n{CHAT_START}assistant\n"))


def format_math_sft(instruction: Column | str = "instruction", reasoning: Column | str = "reasoning", answer: Column | str = "answer") -> Column:
    return F.concat(instruction_prefix(instruction), math_response(reasoning, answer), F.lit(CHAT_END))


def format_generic_sft(instruction: Column | str, target: Column | str) -> Column:
    t = F.coalesce(_col(target), F.lit(""))
    return F.concat(instruction_prefix(instruction), F.when(t.contains("<think>"), t).otherwise(F.concat(F.lit("<think>\n"), t, F.lit("\n</think>"))), F.lit(CHAT_END))


def format_sft(df: DataFrame) -> Column:
    """The format that the columns ask for: the math one with reasoning and answer, else the generic one."""
    if {"reasoning", "answer"} <= set(df.columns):
        return format_math_sft("instruction" if "instruction" in df.columns else "input")
    return format_generic_sft("instruction" if "instruction" in df.columns else "input", "target" if "target" in df.columns else "output")


#: Prompts of the teacher, of the verifier and of a rollout. Their wording.
COMPRESS_PROMPT = """请压缩下面的数学样本。

要求：
1. 先判断原始推理是否能支持给定参考答案；如果题面或推理不可修复，status 返回 rejected。
2. 删除重复计算、自我怀疑、无效尝试、元话语和多次复算。
3. 保留得到答案所必需的公式、推导与关键论证，不能只给答案。
4. 最终答案必须严格保持为参考答案，不得自行修改。
5. reasoning 目标为 600-1500 个 Qwen token，复杂证明可略长，但完整样本必须能进入 2048 token。
6. reasoning 中不要出现 <think>、<answer> 或 ChatML 标签。
7. 严格返回：
{{"status":"accepted|rejected","reasoning":"...","answer":"...","reject_reason":"..."}}

题目：
{instruction}

原始冗长推理（可能已确定性截取首尾以避免上下文浪费）：
{reasoning}

已核验参考答案：
{answer}
{suffix}"""
COMPRESS_FEEDBACK = "\n上一次审校反馈：{feedback}\n请据此修正。"
VERIFY_PROMPT = """请审校下面的压缩数学推理。

检查：
1. 每个关键步骤是否正确；
2. 是否遗漏了导致结论无法成立的关键步骤；
3. 是否真正支持指定参考答案；
4. 是否存在无根据假设、题面缺失或循环论证；
5. 是否足够紧凑，且没有大量重复。

严格返回：
{{"valid":true|false,"supports_answer":true|false,"missing_key_step":true|false,"error":"..."}}

题目：
{instruction}

压缩推理：
{reasoning}

指定参考答案：
{answer}"""


def compress_prompt(instruction: Column | str = "instruction", reasoning: Column | str = "reasoning", answer: Column | str = "answer", feedback: Column | str | None = None) -> Column:
    """The teacher's prompt, with a long reasoning compacted; ``feedback`` of the attempt before, empty or null for none."""
    said = F.lit("") if feedback is None else F.coalesce(_col(feedback), F.lit(""))
    suffix = F.when(said == "", F.lit("")).otherwise(fill(COMPRESS_FEEDBACK, feedback=said))
    return fill(COMPRESS_PROMPT, instruction=instruction, reasoning=compact(reasoning), answer=answer, suffix=suffix)


def verify_prompt(instruction: Column | str = "instruction", reasoning: Column | str = "reasoning", answer: Column | str = "answer") -> Column:
    return fill(VERIFY_PROMPT, instruction=instruction, reasoning=reasoning, answer=answer)


def rollout_prompt(question: Column | str, steps: Column, index: Column) -> Column:
    """An open answer of the steps up to number ``index`` (from 0), to be gone on with."""
    before = F.array_join(F.transform(F.slice(steps, F.lit(1), index + 1), lambda s: F.concat(s, F.lit("\n\n"))), "")
    return F.concat(F.lit(f"{CHAT_START}user\n"), _col(question), F.lit(f"{CHAT_END}\n{CHAT_START}assistant\n<think>\n"), before)


def step_prompt(question: Column | str, step: Column | str) -> Column:
    """Prompt of the step scorer. Fixed value: its wording."""
    return F.concat(F.lit(f"{CHAT_START}user\n评估以下数学推理步骤的质量。\n\n问题: "), _col(question), F.lit("\n步骤: "), _col(step), F.lit(f"\n{CHAT_END}\n{CHAT_START}assistant\n"))


def fill(template: str, **columns: Column | str) -> Column:
    """A template whose ``{name}`` places take columns."""
    from string import Formatter

    parts: list[Column] = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(F.coalesce(_col(columns[name]).cast("string"), F.lit("")))
    return F.concat(*parts)


def split_steps(c: Column | str, by_sentence: bool = True) -> Column:
    """Steps of a reasoning: paragraphs; if that gives one, lines; if that does too and the text is long, sentences."""
    raw = strip(c)
    real = lambda a: F.filter(F.transform(a, strip), lambda s: s != "")
    paragraphs, lines = real(F.split(raw, r"\n\s*\n", -1)), real(F.split(raw, "\n", -1))
    steps = F.when(F.size(paragraphs) > 1, paragraphs).otherwise(lines)
    if by_sentence:
        sentences = F.transform(F.filter(F.split(raw, "。", -1), lambda s: strip(s) != ""), lambda s: F.concat(strip(s), F.lit(".")))
        steps = F.when((F.size(paragraphs) <= 1) & (F.size(lines) <= 1) & (F.length(raw) > 200), sentences).otherwise(steps)
    return F.when(raw == "", F.array().cast("array<string>")).otherwise(steps)


def prefix_context(steps: Column, index: Column) -> Column:
    """The numbered steps before ``index`` (from 0), one a line."""
    return F.array_join(F.transform(F.slice(steps, F.lit(1), index), lambda s, i: F.concat(F.lit("步骤"), (i + 1).cast("string"), F.lit(": "), s)), "\n")


def sentence_count(c: Column | str) -> Column:
    """Sentences in the think tag, split at 。！.! and newlines."""
    parts = F.split(think_text(c), r"[。！\.!\n]+", -1)
    return F.size(F.filter(parts, lambda s: strip(s) != ""))


#: Escapes of control characters with letters in them; Spark writes these in upper case, Python in lower case.
_ESCAPES = ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F")


def spaced_json(c: Column | str) -> Column:
    """A JSON text with a space after each comma and colon and no other between tokens; names, order and numbers stay as they are written."""
    tokens = F.regexp_extract_all(_col(c), F.lit(r'("(?:[^"\\]|\\.)*"|[^"]+)'), F.lit(1))

    def token(t: Column) -> Column:
        text = t
        for e in _ESCAPES:
            text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*)\\u{e}", rf"$1\\u{e.lower()}")
        text = F.when(t.contains("\\u00"), text).otherwise(t)
        return F.when(t.startswith('"'), text).otherwise(F.regexp_replace(F.regexp_replace(t, r"\s+", ""), "([,:])", "$1 "))

    return F.array_join(F.transform(tokens, token), "")


#: What stands before and after the tools' schemas.
TOOLS_HEAD = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
TOOLS_TAIL = '\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'


def _json_text(c: Column, kind: T.DataType) -> Column:
    """Strings as they are; anything else as JSON. Fields that are null are left out."""
    return c if isinstance(kind, T.StringType) else spaced_json(F.to_json(c))


def _tool_calls(message: Column, content: Column, kind: T.StructType) -> Column:
    """The calls of an assistant's turn, each in its tags; a call may stand in a field ``function``."""
    call = kind["tool_calls"].dataType.elementType

    def one(c: Column, i: Column) -> Column:
        inner, names = c, call
        if "function" in call.names:
            inner, names = c["function"], call["function"].dataType
        text = F.concat(F.lit('<tool_call>\n{"name": "'), inner["name"], F.lit('", "arguments": '), _json_text(inner["arguments"], names["arguments"].dataType), F.lit("}\n</tool_call>"))
        return F.concat(F.when((i > 0) | (content != ""), "\n").otherwise(""), text)

    return F.coalesce(F.array_join(F.transform(message["tool_calls"], one), ""), F.lit(""))


def render_chat(messages: Column, generation_prompt: bool = False, thinking: bool = True, message: T.StructType | None = None, tools: Column | None = None) -> Column:
    """Chat text of an array of messages in order.

    ``message`` is their type: role and content (a string), and if they have them reasoning_content (a string; where it is
    null, the reasoning is taken from the content) and tool_calls, an array of (name, arguments) or of (function: (name,
    arguments)) with arguments as a string or any nested value. ``tools``: an array of schemas as JSON texts, null or empty
    for none; they go into a system turn, after the text of a first system message. Reasoning in assistant turns stays after
    the last real user query only; successive tool turns share one user turn. With ``generation_prompt`` an open assistant
    turn follows, closed for thinking if not ``thinking``.
    """
    fields = message.names if message is not None else ["role", "content"]
    n = F.size(messages)
    real = F.transform(messages, lambda m, i: F.when((m["role"] == "user") & m["content"].isNotNull() & ~(m["content"].startswith("<tool_response>") & m["content"].endswith("</tool_response>")), i).otherwise(-1))
    found = F.array_max(real)
    query = F.when(found >= 0, found).otherwise(n - 1)
    nl = lambda c: F.regexp_replace(c, r"^\n+|\n+$", "")
    lead = lambda c: F.regexp_replace(c, r"^\n+", "")
    has_tools = F.lit(False) if tools is None else F.coalesce(F.size(tools) > 0, F.lit(False))
    first_system = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))

    def turn(m: Column, i: Column) -> Column:
        role, content = m["role"], F.coalesce(m["content"], F.lit(""))
        given = m["reasoning_content"] if "reasoning_content" in fields else F.lit(None).cast("string")
        thinks = content.contains("</think>") & given.isNull()
        before = F.regexp_replace(F.element_at(F.split(content, "</think>", -1), 1), r"\n+$", "")
        reasoning = F.when(given.isNotNull(), given).when(thinks, lead(F.element_at(F.split(before, "<think>", -1), -1))).otherwise("")
        body = F.when(thinks, lead(F.element_at(F.split(content, "</think>", -1), -1))).otherwise(content)
        shown = (i > query) & ((i == n - 1) | (reasoning != ""))
        calls = _tool_calls(m, body, message) if "tool_calls" in fields else F.lit("")
        answer = F.concat(F.lit(f"{CHAT_START}assistant\n"), F.when(shown, F.concat(F.lit("<think>\n"), nl(reasoning), F.lit("\n</think>\n\n"), lead(body))).otherwise(body), calls, F.lit(f"{CHAT_END}\n"))
        tool_before = F.coalesce(F.get(messages, i - 1)["role"] == "tool", F.lit(False))
        tool_after = F.coalesce(F.get(messages, i + 1)["role"] == "tool", F.lit(False))
        tool = F.concat(F.when(tool_before, F.lit("")).otherwise(F.lit(f"{CHAT_START}user")), F.lit("\n<tool_response>\n"), content, F.lit("\n</tool_response>"), F.when(tool_after, F.lit("")).otherwise(F.lit(f"{CHAT_END}\n")))
        plain = F.concat(F.lit(CHAT_START), role, F.lit("\n"), content, F.lit(f"{CHAT_END}\n"))
        said = (role == "user") | (role == "system") & ((i > 0) | ~has_tools)
        return F.when(said, plain).when(role == "assistant", answer).when(role == "tool", tool).otherwise("")

    text = F.array_join(F.transform(messages, turn), "")
    if tools is not None:
        opening = F.when(first_system, F.concat(F.coalesce(F.get(messages, F.lit(0))["content"], F.lit("")), F.lit("\n\n"))).otherwise("")
        schemas = F.array_join(F.transform(tools, lambda t: F.concat(F.lit("\n"), spaced_json(t))), "")
        text = F.concat(F.when(has_tools, F.concat(F.lit(f"{CHAT_START}system\n"), opening, F.lit(TOOLS_HEAD), schemas, F.lit(f"{TOOLS_TAIL}{CHAT_END}\n"))).otherwise(""), text)
    if generation_prompt:
        text = F.concat(text, F.lit(f"{CHAT_START}assistant\n" + ("" if thinking else "<think>\n\n</think>\n\n")))
    return text
