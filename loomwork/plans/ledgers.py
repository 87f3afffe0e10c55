"""Queries on synthesis ledgers, and the texts that go to teachers and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import scoring as S
from loomwork.functions import text as X
from loomwork.functions import tokens as K
from loomwork.operators import gates, ledger, stats
from loomwork.operators import select as sel
from loomwork.plans import dialect as d
from loomwork.plans.fixtures import ctes, view
from loomwork.plans.registry import query

#: A row of some states is in two ledgers.
LEDGERS = f"""WITH {ctes('synthesis')}, acc AS (SELECT * FROM synthesis WHERE state = 'accepted'), rej AS (SELECT * FROM synthesis WHERE state = 'rejected' OR k % 14 = 0), tra AS (SELECT * FROM synthesis WHERE state = 'transient' OR k % 21 = 1)"""


def _usage(df):
    """``df`` with the usage of its calls; some lack the cache's numbers."""
    item = lambda i: F.struct(
        F.when(i % 2 == 0, "compress").otherwise("verify").alias("stage"), i.cast("int").alias("attempt"), (F.col("k") % 100 + i).alias("prompt_tokens"), (F.col("k") % 50 + i).alias("completion_tokens"),
        F.when(F.col("k") % 4 != 0, F.col("k") % 30).alias("prompt_cache_hit_tokens"), F.when(F.col("k") % 4 != 1, F.col("k") % 70).alias("prompt_cache_miss_tokens"),
    )
    return df.withColumn("usage", F.transform(F.sequence(F.lit(1).cast("long"), F.col("calls").cast("long")), item))


def _ledgers(spark, sf_dir):
    q = view(spark, sf_dir, "synthesis")
    return q, q.filter("state = 'accepted'"), q.filter("state = 'rejected' OR k % 14 = 0"), q.filter("state = 'transient' OR k % 21 = 1")


STATUS = LEDGERS + """, st AS (SELECT s.*, CASE WHEN candidate_id IN (SELECT candidate_id FROM acc) THEN 'accepted' WHEN candidate_id IN (SELECT candidate_id FROM rej) THEN 'rejected' WHEN candidate_id IN (SELECT candidate_id FROM tra) THEN 'transient' ELSE 'missing' END AS status FROM synthesis s)"""


@query("ledger_status", STATUS + " SELECT source, status, count(*) AS n FROM st GROUP BY 1, 2")
def ledger_status(spark, sf_dir):
    return stats.counts(ledger.status(*_ledgers(spark, sf_dir)), "source", "status")


@query("ledger_status_by_length", STATUS + " SELECT CASE WHEN sft_token_length <= 4096 THEN '2049-4096' WHEN sft_token_length <= 8192 THEN '4097-8192' ELSE '>8192' END AS length, status, count(*) AS n FROM st GROUP BY 1, 2")
def ledger_status_by_length(spark, sf_dir):
    rows = ledger.status(*_ledgers(spark, sf_dir)).withColumn("length", S.length_bucket("sft_token_length"))
    return stats.counts(rows, "length", "status")


@query("resume_anti_join", LEDGERS + " SELECT candidate_id FROM synthesis WHERE candidate_id NOT IN (SELECT candidate_id FROM acc) AND candidate_id NOT IN (SELECT candidate_id FROM rej)")
def resume_anti_join(spark, sf_dir):
    q, a, r, _ = _ledgers(spark, sf_dir)
    return ledger.pending(q, a, r).select("candidate_id")


@query("unresolved_ids", LEDGERS + " SELECT candidate_id, count(*) AS attempts, list_sort(list(DISTINCT reject_reason)) AS transient_reasons FROM tra WHERE candidate_id NOT IN (SELECT candidate_id FROM acc) AND candidate_id NOT IN (SELECT candidate_id FROM rej) GROUP BY 1")
def unresolved_ids(spark, sf_dir):
    _, a, r, t = _ledgers(spark, sf_dir)
    return ledger.unresolved(t, a, r)


@query("ledger_overlaps", LEDGERS + """ SELECT (SELECT count(*) FROM (SELECT candidate_id FROM acc INTERSECT SELECT candidate_id FROM rej)) AS accepted_rejected, (SELECT count(*) FROM (SELECT candidate_id FROM acc INTERSECT SELECT candidate_id FROM tra)) AS accepted_transient,
  (SELECT count(*) FROM (SELECT candidate_id FROM rej INTERSECT SELECT candidate_id FROM tra)) AS rejected_transient""")
def ledger_overlaps(spark, sf_dir):
    return ledger.overlaps(*_ledgers(spark, sf_dir)[1:])


@query("reject_categories", LEDGERS + " SELECT CASE WHEN reject_reason LIKE 'teacher_rejected%' THEN 'teacher_rejected' WHEN reject_reason LIKE 'api_or_parse_error%' THEN 'api_or_parse_error' ELSE string_split(reject_reason, ':')[1] END AS category, count(*) AS n FROM rej GROUP BY 1")
def reject_categories(spark, sf_dir):
    return stats.counts(_ledgers(spark, sf_dir)[2].withColumn("category", S.reject_category("reject_reason")), "category")


PRICES = (0.02, 1.0, 2.0)
ITEMS = LEDGERS + """, un AS (SELECT * FROM acc UNION ALL SELECT * FROM rej UNION ALL SELECT * FROM tra), it AS (SELECT i, CASE WHEN i % 2 = 0 THEN 'compress' ELSE 'verify' END AS stage, coalesce(CASE WHEN k % 4 <> 0 THEN k % 30 END, 0) AS hit, coalesce(CASE WHEN k % 4 <> 1 THEN k % 70 END, k % 100 + i) AS miss, k % 50 + i AS outp FROM un, unnest(range(1, calls + 1)) AS t(i))"""


@query("usage_by_stage", ITEMS + " SELECT stage, count(*) AS calls, sum(outp)::BIGINT AS output FROM it GROUP BY 1")
def usage_by_stage(spark, sf_dir):
    _, a, r, t = _ledgers(spark, sf_dir)
    return ledger.usage_items(_usage(a.unionByName(r).unionByName(t))).groupBy("stage").agg(F.count("*").alias("calls"), F.sum("output").alias("output"))


@query("usage_cost", ITEMS + " SELECT count(*) AS calls, sum(hit)::BIGINT AS cache_hit, sum(miss)::BIGINT AS cache_miss, sum(outp)::BIGINT AS output, round((sum(hit) * 0.02 + sum(miss) * 1.0 + sum(outp) * 2.0)::DOUBLE / 1000000, 6) AS cost FROM it")
def usage_cost(spark, sf_dir):
    _, a, r, t = _ledgers(spark, sf_dir)
    return ledger.usage_cost(_usage(a.unionByName(r).unionByName(t)), PRICES)


@query("accepted_lengths", LEDGERS + """, l AS (SELECT length(reasoning) AS n FROM acc) SELECT min(n) AS min, quantile_cont(n, 0.5) AS p50, (list_sort(list(n)))[CAST(floor(0.9 * (count(n) - 1)) AS BIGINT) + 1] AS p90, max(n) AS max FROM l""")
def accepted_lengths(spark, sf_dir):
    rows = _ledgers(spark, sf_dir)[1].select(F.length("reasoning").alias("n"))
    ends = rows.agg(F.min("n").alias("min"), F.max("n").alias("max"))
    p50 = stats.order_statistic(rows, "n", {"p50": 0.5}, method="interpolated")
    return ends.crossJoin(F.broadcast(p50)).crossJoin(F.broadcast(stats.order_statistic(rows, "n", {"p90": 0.9}, method="floor_n1")))


@query("move_transient", LEDGERS + " SELECT 'rejected' AS ledger, candidate_id FROM rej WHERE reject_reason NOT LIKE 'api_or_parse_error%' UNION ALL SELECT 'transient', candidate_id FROM tra UNION ALL SELECT 'transient', candidate_id FROM rej WHERE reject_reason LIKE 'api_or_parse_error%'")
def move_transient(spark, sf_dir):
    _, _, r, t = _ledgers(spark, sf_dir)
    left, moved = ledger.move_transient(r, t)
    return left.select(F.lit("rejected").alias("ledger"), "candidate_id").unionByName(moved.select(F.lit("transient").alias("ledger"), "candidate_id"))


CLAIMS = f"""WITH {ctes('claims')}, b AS (SELECT seq, {d.question('instruction')} AS key, list_last({d.full_boxes('reasoning')}) AS box, answer, valid AND supports_answer AND NOT missing_key_step AS strict, len({d.toks(d.MATH)}) AS n FROM claims),
  r AS (SELECT seq, key, list_filter([CASE WHEN box <> answer THEN 'reasoning_box_answer_mismatch' END, CASE WHEN NOT strict THEN 'verifier_not_strictly_valid' END, CASE WHEN n > 150 THEN 'formatted_too_long' END], lambda x: x IS NOT NULL) AS reasons FROM b),
  c AS (SELECT *, min(CASE WHEN len(reasons) = 0 THEN seq END) OVER (PARTITION BY key) AS claim FROM r)"""


def _claims(spark, sf_dir):
    verifier = F.struct("valid", "supports_answer", "missing_key_step")
    rows = view(spark, sf_dir, "claims").withColumn("verifier", verifier)
    n = K.token_counts(X.format_math_sft(), X.instruction_prefix())
    rows = rows.withColumns({"full": n["full"], "supervised": n["supervised"], "key": F.sha2(X.normalize_question("instruction"), 256)})
    return sel.first_claims(gates.reasons(rows, gates.synthesis_rules("full", "supervised", 150)), "key", "seq", "reasons")


@query("first_claim_validation", CLAIMS + " SELECT seq, CASE WHEN seq > claim THEN list_append(reasons, 'internal_duplicate') ELSE reasons END AS reasons FROM c")
def first_claim_validation(spark, sf_dir):
    return _claims(spark, sf_dir).select("seq", "reasons")


@query("clean_pool", CLAIMS + " SELECT seq, key AS question FROM c WHERE len(reasons) = 0 AND NOT coalesce(seq > claim, false)")
def clean_pool(spark, sf_dir):
    """Rows that no rule and no earlier row with their question keeps out."""
    return _claims(spark, sf_dir).filter(F.size("reasons") == 0).select("seq", X.normalize_question("instruction").alias("question"))


@query("validation_counts", CLAIMS + ", u AS (SELECT unnest(CASE WHEN seq > claim THEN list_append(reasons, 'internal_duplicate') ELSE reasons END) AS reason FROM c) SELECT reason, count(*) AS n FROM u GROUP BY 1")
def validation_counts(spark, sf_dir):
    return stats.counts(_claims(spark, sf_dir).select(F.explode("reasons").alias("reason")), "reason")


@query("queue_metadata", STATUS + " SELECT a.candidate_id, q.sft_token_length IS NULL AS missing_queue_metadata FROM acc a LEFT JOIN (SELECT * FROM synthesis WHERE k % 10 <> 0) q USING (candidate_id)")
def queue_metadata(spark, sf_dir):
    q, a, _, _ = _ledgers(spark, sf_dir)
    held = q.filter("k % 10 <> 0").select("candidate_id", "sft_token_length")
    return a.select("candidate_id").join(held, "candidate_id", "left").select("candidate_id", F.col("sft_token_length").isNull().alias("missing_queue_metadata"))


TEACHER = r"WITH {0}, t AS (SELECT seq, reasoning || '\r\nA\n\nB\nC\neq \n1' AS t FROM sft_records), u AS (SELECT seq, replace(replace(t, '\r\n', chr(10)), '\n\n', chr(10) || chr(10)) AS t FROM t)".format(ctes("sft_records"))


@query("teacher_text_normalize", TEACHER + r" SELECT seq, regexp_replace(t, '\\n([^a-z])', chr(10) || '\1', 'g') AS reasoning FROM u")
def teacher_text_normalize(spark, sf_dir):
    raw = F.concat("reasoning", F.lit("\\r\\nA\\n\\nB\\nC\\neq \\n1"))
    return view(spark, sf_dir, "sft_records").select("seq", X.teacher_text(raw).alias("reasoning"))


@query("source_compaction", f"WITH {ctes('sft_records')} SELECT seq, CASE WHEN length(reasoning) <= 101 THEN reasoning ELSE substr(reasoning, 1, 40) || chr(10) || chr(10) || '[中间重复/冗长部分已为节省上下文而省略；请根据题目、保留部分与参考答案重建严谨解法。]' || chr(10) || chr(10) || right(reasoning, 61) END AS reasoning FROM sft_records")
def source_compaction(spark, sf_dir):
    return view(spark, sf_dir, "sft_records").select("seq", X.compact("reasoning", 101).alias("reasoning"))


@query("parse_model_json", f"""WITH {ctes('sft_records')} SELECT seq, CASE k % 4 WHEN 3 THEN NULL ELSE 'accepted' END AS status, CASE k % 4 WHEN 3 THEN NULL ELSE answer END AS answer FROM sft_records""")
def parse_model_json(spark, sf_dir):
    body = F.to_json(F.struct(F.lit("accepted").alias("status"), "answer"))
    reply = F.when(F.col("k") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("k") % 4 == 1, F.concat(F.lit("Sure: "), body, F.lit(" done"))).when(F.col("k") % 4 == 2, body).otherwise("no json")
    out = view(spark, sf_dir, "sft_records").select("seq", X.model_json(reply).alias("j"))
    return out.select("seq", F.get_json_object("j", "$.status").alias("status"), F.get_json_object("j", "$.answer").alias("answer"))


@query("step_score_replies", f"WITH {ctes('sft_records')} SELECT seq, CASE k % 4 WHEN 3 THEN NULL ELSE round((k % 10)::DOUBLE / 10, 6) END AS score FROM sft_records")
def step_score_replies(spark, sf_dir):
    body = F.concat(F.lit('{"score": '), ((F.col("k") % 10).cast("double") / 10).cast("string"), F.lit(', "reason": "x"}'))
    reply = F.when(F.col("k") % 4 == 0, F.concat(F.lit("a\n```json\n"), body, F.lit("\n```"))).when(F.col("k") % 4 == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).when(F.col("k") % 4 == 2, body).otherwise("none")
    return view(spark, sf_dir, "sft_records").select("seq", X.step_score(reply).alias("score"))


@query("prompt_templates", f"WITH {ctes('sft_records')} SELECT seq, '题目：' || chr(10) || instruction || chr(10) || chr(10) || '指定参考答案：' || chr(10) || answer AS prompt FROM sft_records")
def prompt_templates(spark, sf_dir):
    return view(spark, sf_dir, "sft_records").select("seq", X.fill("题目：\n{instruction}\n\n指定参考答案：\n{answer}", instruction="instruction", answer="answer").alias("prompt"))


def _sql_prompt(template: str, **columns: str) -> str:
    out = "'" + template.replace("'", "''").replace("{{", "{").replace("}}", "}").replace("\n", "' || chr(10) || '") + "'"
    for name, sql in columns.items():
        out = out.replace("{" + name + "}", f"' || {sql} || '")
    return out


TEACHER = _sql_prompt(X.COMPRESS_PROMPT, instruction="instruction", reasoning="reasoning", answer="answer", suffix=f"CASE WHEN k % 3 = 0 THEN {_sql_prompt(X.COMPRESS_FEEDBACK, feedback='source')} ELSE '' END")


@query("teacher_prompts", f"WITH {ctes('sft_records')} SELECT seq, {TEACHER} AS teacher, {_sql_prompt(X.VERIFY_PROMPT, instruction='instruction', reasoning='reasoning', answer='answer')} AS verifier FROM sft_records WHERE length(reasoning) <= 12000")
def teacher_prompts(spark, sf_dir):
    rows = view(spark, sf_dir, "sft_records").filter(F.length("reasoning") <= 12_000)
    said = F.when(F.col("k") % 3 == 0, F.col("source"))
    return rows.select("seq", X.compress_prompt(feedback=said).alias("teacher"), X.verify_prompt().alias("verifier"))


@query("candidate_ids", f"WITH {ctes('synthesis')} SELECT seq, candidate_id, sha256(source || chr(10) || {d.question('instruction')}) AS stable_score FROM synthesis")
def candidate_ids(spark, sf_dir):
    rows = view(spark, sf_dir, "sft_records")
    return rows.select("seq", X.candidate_id().alias("candidate_id"), X.sha_key("source", X.normalize_question("instruction")).alias("stable_score"))
