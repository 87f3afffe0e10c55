"""Queries that write and read: JSON lines in their tolerances, replaced and ordered tables, fingerprints, tools in chats, clients."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.operators import gates, ledger
from loomwork.operators.store import fresh_path, spread
from loomwork.plans import dialect as d
from loomwork.plans.fixtures import ctes, view
from loomwork.plans.registry import query
from loomwork.sources import ordered, versions
from loomwork.sources import records as io


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _in_order(df, key: str):
    """Parts whose files come in the order of the key."""
    return df.repartitionByRange(4, key).sortWithinPartitions(key)


@query("jsonl_round_trip", "SELECT source AS kind, doc_id::VARCHAR AS input, text AS target FROM documents UNION ALL SELECT source, doc_id::VARCHAR, '' FROM documents WHERE lang = 'en'")
def jsonl_round_trip(spark, sf_dir):
    """Two files and one that isn't there, written as JSON lines and read as one."""
    rows = _docs(spark, sf_dir).select(F.col("source").alias("kind"), F.col("doc_id").cast("string").alias("input"), F.col("text").alias("target"), "lang")
    one, two = fresh_path(spark, "lines"), fresh_path(spark, "lines")
    io.write_jsonl(rows.drop("lang"), one)
    io.write_jsonl(rows.filter("lang = 'en'").drop("lang").withColumn("target", F.lit("")), two)
    return io.merge_files(spark, [one, two + "-missing", two], io.RAW_INSTRUCT)


@query("jsonl_append", "SELECT 'first' AS instruction, doc_id::VARCHAR AS answer FROM documents UNION ALL SELECT 'appended', doc_id::VARCHAR FROM documents")
def jsonl_append(spark, sf_dir):
    """A file that is written if it isn't there, not written again, and appended to."""
    rows = lambda what: _docs(spark, sf_dir).select(F.lit(what).alias("instruction"), F.col("doc_id").cast("string").alias("answer"))
    path = fresh_path(spark, "ledger")
    for what in ("first", "second"):
        io.write_if_absent(rows(what), path)
    io.append_jsonl(rows("appended"), path)
    return io.read_jsonl(spark, path, io.SFT).select("instruction", "answer")


BROKEN = """WITH l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS seq, doc_id, source FROM documents)"""


def _lines(spark, sf_dir):
    """A file of records, some lines of which are cut, no object, or begin with bytes that are no text."""
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("instruction"), "source"))
    line = F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("cut "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 5 == 2, "[1, 2]").when(F.col("doc_id") % 5 == 3, F.concat(F.unhex(F.lit("FFC3")), line.cast("binary")).cast("string")).otherwise(line)
    path = fresh_path(spark, "raw")
    _in_order(_docs(spark, sf_dir).select("doc_id", line.alias("value")), "doc_id").select("value").write.text(path)
    return path


@query("jsonl_dropping", BROKEN + " SELECT doc_id::VARCHAR AS instruction, source FROM l WHERE doc_id % 5 NOT IN (1, 2)")
def jsonl_dropping(spark, sf_dir):
    """Records of lines that parse once bad bytes are out."""
    return io.read_jsonl_dropping(spark, _lines(spark, sf_dir), io.SFT).select("instruction", "source")


@query("jsonl_quarantined", BROKEN + """ SELECT seq, doc_id::VARCHAR AS instruction, NULL AS raw_line, NULL AS error FROM l WHERE doc_id % 5 NOT IN (1, 2)
  UNION ALL SELECT NULL, NULL, CASE doc_id % 5 WHEN 1 THEN 'cut ' || doc_id ELSE '[1, 2]' END, CASE doc_id % 5 WHEN 1 THEN 'Expecting value: line 1 column 1 (char 0)' ELSE 'not an object but list' END FROM l WHERE doc_id % 5 IN (1, 2)""")
def jsonl_quarantined(spark, sf_dir):
    """Good records with their place, broken lines with what the parser says."""
    good, bad = io.read_jsonl_quarantined(spark, _lines(spark, sf_dir), io.SFT)
    return good.select("seq", "instruction").unionByName(bad.select("raw_line", "error"), allowMissingColumns=True)


@query("replaced_table", "SELECT doc_id, source FROM documents WHERE lang = 'en'")
def replaced_table(spark, sf_dir):
    """A table that was replaced twice."""
    path = fresh_path(spark, "table")
    rows = _docs(spark, sf_dir).select("doc_id", "source", "lang")
    for part in (rows, rows.filter("lang <> 'en'"), rows.filter("lang = 'en'")):
        at = versions.replace(part.drop("lang"), path)
    assert at == 3
    return versions.read(spark, path)


@query("file_fingerprints", "SELECT source, (sum(length(doc_id::VARCHAR) + 65))::BIGINT AS bytes, sha256(string_agg(doc_id || sha256(coalesce(text, '')) || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY source")
def file_fingerprints(spark, sf_dir):
    """A file of digests for each source, and its fingerprint."""
    path = fresh_path(spark, "digests")
    line = F.concat(F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = _docs(spark, sf_dir).select("doc_id", "source", line.alias("value"))
    rows.repartition("source").sortWithinPartitions("source", "doc_id").select("value", "source").write.partitionBy("source").text(path)
    found = io.fingerprints(spark, f"{path}/source=*")
    return found.select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), "bytes", "sha256")


@query("final_order", "SELECT row_number() OVER (ORDER BY sha256('11' || chr(10) || doc_id::VARCHAR)) - 1 AS seq, doc_id FROM documents")
def final_order(spark, sf_dir):
    """Documents shuffled by a key into files, with their places as read back."""
    path = fresh_path(spark, "ordered")
    rows = _docs(spark, sf_dir).select("doc_id")
    ordered.write_ordered(rows, path, X.sha_key(F.lit("11"), F.col("doc_id").cast("string")), file_rows=400)
    return ordered.read_ordered(spark, path).select("seq", "doc_id")


@query("token_arrays", f"WITH {ctes('sft_records')} SELECT list_transform({d.toks('instruction')}, lambda x: length(x)::BIGINT) AS input_ids, list_transform({d.toks('instruction')}, lambda x: -100::BIGINT) AS labels FROM sft_records")
def token_arrays(spark, sf_dir):
    """Token arrays written and read back."""
    from loomwork.functions import tokens as K

    rows = view(spark, sf_dir, "sft_records").select(K.tokens(F.col("instruction")).alias("k"))
    path = fresh_path(spark, "tokens")
    io.write_tokens(rows.select(F.transform("k", F.length).alias("input_ids"), F.transform("k", lambda x: F.lit(-100)).alias("labels")), path)
    return io.read_tokens(spark, path)


@query("distilled_records", r"""SELECT 'q' || doc_id AS instruction, text AS reasoning, CASE doc_id % 3 WHEN 0 THEN (doc_id % 10)::VARCHAR ELSE 'plain ' || doc_id END AS answer, source FROM documents WHERE source IN ('src0', 'src1') AND text <> ''""")
def distilled_records(spark, sf_dir):
    """Records of two sources out of distilled rows, with the last box as answer where there is one."""
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("so \\boxed{7} or \\boxed{ "), (F.col("doc_id") % 10).cast("string"), F.lit(" }"))).otherwise(F.concat(F.lit(" plain "), F.col("doc_id").cast("string"), F.lit("\n")))
    rows = _docs(spark, sf_dir).select(F.col("source").alias("repo_name"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("input"), F.col("text").alias("reasoning_content"), content.alias("content"))
    return io.from_distilled(rows, ["src0", "src1"])


@query("length_guard", "SELECT doc_id, length(text) AS n FROM documents")
def length_guard(spark, sf_dir):
    """All documents; the query fails if one is over the limit."""
    rows = _docs(spark, sf_dir).select("doc_id", F.length("text").alias("n"))
    return gates.fail_if_longer(rows, F.col("n"), 1 << 24).select("doc_id", "n")


TOOL = {"type": "function", "function": {"name": "look_up", "parameters": {"type": "object", "properties": {"q": {"type": "string"}, "n": {"type": "integer"}}, "required": ["q", "n"]}}}
_HEAD = (X.TOOLS_HEAD + "\n" + json.dumps(TOOL) + X.TOOLS_TAIL).replace("'", "''").replace("\n", "' || chr(10) || '")
CALL = """'<tool_call>' || chr(10) || '{"name": "look_up", "arguments": {"q": ' || to_json(text) || ', "n": ' || turn || '}}' || chr(10) || '</tool_call>'"""


@query("chat_tools", f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS q FROM conversations),
  t AS (SELECT conv_id, i, CASE WHEN i = 0 AND role = 'system' THEN text || chr(10) || chr(10) END AS opening, CASE WHEN i = 0 AND role = 'system' THEN '' WHEN role = 'assistant' THEN '<|im_start|>assistant' || chr(10) ||
      CASE WHEN q IS NOT NULL AND turn > q THEN '<think>' || chr(10) || 'turn ' || turn || chr(10) || '</think>' || chr(10) || chr(10) || regexp_replace(text, '^\\n+', '') ELSE text END ||
      CASE WHEN turn % 4 = 1 THEN CASE WHEN text <> '' THEN chr(10) ELSE '' END || {CALL} ELSE '' END || '<|im_end|>' || chr(10)
    ELSE '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) END AS x FROM m)
  SELECT conv_id, '<|im_start|>system' || chr(10) || coalesce(max(opening), '') || '{_HEAD}<|im_end|>' || chr(10) || string_agg(x, '' ORDER BY i) AS text FROM t GROUP BY conv_id""")
def chat_tools(spark, sf_dir):
    """Conversations with a tool, some turns of which call it, and with reasoning in a field of its own."""
    call = F.struct(F.lit("look_up").alias("name"), F.struct(F.col("text").alias("q"), F.col("turn").alias("n")).alias("arguments"))
    thought = F.when(F.col("role") == "assistant", F.concat(F.lit("turn "), F.col("turn").cast("string")))
    calls = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), F.array(call))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.struct("turn", "role", F.col("text").alias("content"), thought.alias("reasoning_content"), calls.alias("tool_calls")).alias("m"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    text = X.render_chat(F.col("m"), message=rows.schema["m"].dataType.elementType, tools=F.array(F.lit(json.dumps(TOOL, separators=(",", ":")))))
    return rows.select("conv_id", text.alias("text"))


def _teacher():
    """A client that answers by the row's number in its prompt, and by what it was told of the attempt before."""

    def call(prompt: str, stage: str) -> tuple[dict, dict]:
        row = json.loads(prompt)
        k, again = row["k"] % 7, row["feedback"] != ""
        if stage == "verify":
            good = k != 3 or again
            return {"valid": good, "supports_answer": True, "missing_key_step": False, "error": "step 2"}, {"total_tokens": 1}
        if k == 4 or k == 5 and not again:
            raise ledger.RetryableError("down")
        words = {2: 1 if again else 2, 6: 5 if again else 50}.get(k, 4)
        return {"status": "rejected" if k == 1 else "accepted", "reject_reason": "unclear", "reasoning": " ".join(["w"] * words)}, {"total_tokens": 2}

    return call


@query("teacher_loop", f"""WITH {ctes('synthesis')}, s AS (SELECT seq, k % 7 AS k FROM synthesis)
  SELECT seq, CASE WHEN k IN (1, 2, 3) THEN 'rejected' WHEN k = 4 THEN 'transient' ELSE 'accepted' END AS outcome,
    CASE k WHEN 1 THEN 'teacher_rejected:unclear' WHEN 2 THEN 'reasoning_too_short' WHEN 3 THEN 'verifier_rejected:step 2' WHEN 4 THEN 'api_or_parse_error:RetryableError:down' END AS reject_reason,
    CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 6 WHEN 4 THEN 0 WHEN 5 THEN 2 ELSE 3 END AS calls, CASE k WHEN 6 THEN 5 WHEN 0 THEN 4 WHEN 5 THEN 4 END AS reasoning_tokens FROM s""")
def teacher_loop(spark, sf_dir):
    """Outcomes of a loop over a client with every kind of reply: three attempts, lengths, feedback, errors."""
    rows = spread(view(spark, sf_dir, "synthesis").select("seq", "k", F.col("seq").cast("string").alias("candidate_id")))
    limits = ledger.Limits(least=3, most=20)
    out = ledger.synthesize(rows, _teacher, lambda r, said: json.dumps({"k": int(r["k"]), "feedback": said}), lambda r, text: json.dumps({"k": int(r["k"]), "feedback": ""}), 3, limits, lambda s: None)
    calls = F.size(F.from_json("usage", "array<struct<stage:string>>"))
    return out.select(F.col("candidate_id").cast("long").alias("seq"), "outcome", "reject_reason", calls.alias("calls"), "reasoning_tokens")


@query("step_scoring", rf"WITH {ctes('sft_records')}, s AS (SELECT seq, unnest(string_split(reasoning, ' ')[1:3]) AS step, unnest(range(3)) AS i FROM sft_records) SELECT seq, i AS step_idx, step AS step_text, round(length(step) / 10.0, 6) AS score FROM s WHERE step IS NOT NULL AND length(step) <> 4")
def step_scoring(spark, sf_dir):
    """Steps scored by a client, those it fails on left out."""
    rows = view(spark, sf_dir, "sft_records").select("seq", "instruction", F.slice(F.split("reasoning", " ", -1), 1, 3).alias("steps"))
    scored = ledger.score_steps(spread(rows), lambda: lambda q, steps, i: (None if len(steps[i]) == 4 else len(steps[i]) / 10, "length"))
    return scored.select("seq", F.inline("scored_steps")).select("seq", "step_idx", "step_text", "score")


@query("batched_generation", f"WITH {ctes('sft_records')} SELECT seq, 'echo ' || instruction AS prediction FROM sft_records")
def batched_generation(spark, sf_dir):
    """A model's output for each prompt, a batch at a time."""
    rows = view(spark, sf_dir, "sft_records").select("seq", F.col("instruction").alias("prompt"))
    return ledger.generate(spread(rows), lambda: lambda prompts: [f"echo {p}" for p in prompts]).select("seq", "prediction")


@query("normalized_accepted", f"WITH {ctes('synthesis')} SELECT seq, replace(replace(instruction, 'e', 'E'), ' ', chr(10)) AS reasoning, len({d.toks("replace(instruction, 'e', 'E')")}) AS compressed_reasoning_tokens FROM synthesis WHERE state = 'accepted'")
def normalized_accepted(spark, sf_dir):
    """Accepted rows whose written-out newlines are resolved and whose tokens are counted anew."""
    from loomwork.functions import tokens as K

    rows = view(spark, sf_dir, "synthesis").filter("state = 'accepted'")
    rows = rows.withColumn("reasoning", F.replace(F.replace("instruction", F.lit("e"), F.lit("E")), F.lit(" "), F.lit("\\n\\n")))
    out = ledger.normalized_accepted(rows, K.token_length)
    return out.select("seq", F.replace("reasoning", F.lit("\n\n"), F.lit("\n")).alias("reasoning"), "compressed_reasoning_tokens")
