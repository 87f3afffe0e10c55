"""Queries that deduplicate, sample, split and mix."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import scoring as S
from loomwork.functions import text as X
from loomwork.functions import tokens as K
from loomwork.operators import joins, stats
from loomwork.operators import select as sel
from loomwork.plans import dialect as d
from loomwork.plans.evaluation import MINING, _predictions, _with
from loomwork.plans.fixtures import ctes, view
from loomwork.plans.registry import query
from loomwork.streaming import scoring as streams

DOC_KEY = "sha256('7' || chr(10) || doc_id::VARCHAR)"


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _key():
    return X.sha_key(F.lit("7"), F.col("doc_id").cast("string"))


@query("kind_quota_sample", f"SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src1', 'src2') QUALIFY row_number() OVER (PARTITION BY source ORDER BY {DOC_KEY}) <= CASE source WHEN 'src0' THEN 20 WHEN 'src1' THEN 5 ELSE 1000 END")
def kind_quota_sample(spark, sf_dir):
    quotas = sel.parse_quotas(["src0=20", "src1=5", "src2=1000"])
    return sel.quota_sample(_docs(spark, sf_dir), "source", quotas, _key(), ties=[]).select("doc_id", "source")


@query("mining_pool", f"""WITH r AS (SELECT doc_id, source, text, {DOC_KEY} AS key, row_number() OVER (PARTITION BY source ORDER BY {DOC_KEY}) <= CASE source WHEN 'src0' THEN 10 WHEN 'src1' THEN 6 WHEN 'none' THEN 9 ELSE 0 END AS q FROM documents),
  u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY text ORDER BY q DESC, key) = 1) SELECT doc_id, source, CASE WHEN q THEN 'quota' ELSE 'fill' END AS pool_part FROM u ORDER BY q DESC, key LIMIT 25""")
def mining_pool(spark, sf_dir):
    out = sel.mining_pool(_docs(spark, sf_dir), "source", {"src0": 10, "src1": 6, "none": 9}, ["text"], _key())
    return out.select("doc_id", "source", "pool_part")


@query("stratified_holdout", f"""WITH d AS (SELECT doc_id, lang, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END AS size, {DOC_KEY} AS key FROM documents), n AS (SELECT lang, size, count(*) AS n FROM d GROUP BY 1, 2),
  b AS (SELECT *, least(n, (100 * n) // (SELECT sum(n) FROM n)) AS base FROM n), c AS (SELECT *, 100 - sum(base) OVER () AS spare, row_number() OVER (ORDER BY n DESC, lang, size) AS rk FROM b),
  q AS (SELECT lang, size, base + CASE WHEN rk <= spare THEN 1 ELSE 0 END AS quota FROM c)
  SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY d.lang, d.size ORDER BY key) <= quota THEN 'validation' ELSE 'train' END AS split FROM d JOIN q ON d.lang = q.lang AND d.size = q.size""")
def stratified_holdout(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("size", F.when(F.col("n_chars") < 1000, "short").otherwise("long"))
    return sel.stratified_holdout(rows, ["lang", "size"], 100, _key(), ties=[]).select("doc_id", "split")


@query("train_val_split", f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {DOC_KEY}) <= floor((SELECT count(*) FROM documents) * 0.95) THEN 'train' ELSE 'validation' END AS split FROM documents")
def train_val_split(spark, sf_dir):
    return sel.ordered_split(_docs(spark, sf_dir), _key(), ties=[]).select("doc_id", "split")


@query("first_wins_dedup", f"SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lower({d.strip('text')}) ORDER BY CASE WHEN source = 'src0' THEN 0 ELSE 1 END, doc_id) = 1")
def first_wins_dedup(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumns({"k": F.sha2(F.lower(X.strip("text")), 256), "p": F.when(F.col("source") == "src0", 0).otherwise(1)})
    return sel.first_by(rows.select("doc_id", "k", "p"), ["k"], ["p", "doc_id"]).select("doc_id")


GROUPS = f"WITH g AS (SELECT doc_id, {d.question('text')} AS q, source AS a, n_chars FROM documents)"


@query("best_of_group_dedup", GROUPS + """ SELECT doc_id, CASE WHEN min(a) OVER w <> max(a) OVER w THEN 'duplicate_conflicting_answers' WHEN row_number() OVER (PARTITION BY q ORDER BY n_chars, sha256('7' || chr(10) || doc_id::VARCHAR)) = 1 THEN 'kept' ELSE 'internal_duplicate' END AS dedup_status FROM g WINDOW w AS (PARTITION BY q)""")
def best_of_group_dedup(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("q", F.sha2(X.normalize_question("text"), 256)).drop("text")
    return sel.best_of_group(rows, "q", "source", [F.col("n_chars"), _key()]).select("doc_id", "dedup_status")


@query("conflicting_answers", GROUPS + " SELECT min(doc_id) AS first_doc, count(*) AS n, count(DISTINCT a) AS answers FROM g GROUP BY q HAVING count(DISTINCT a) > 1")
def conflicting_answers(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("q", F.sha2(X.normalize_question("text"), 256))
    return rows.groupBy("q").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.countDistinct("source").alias("answers")).filter("answers > 1").drop("q")


RECORDS = f"WITH {ctes('sft_records')}, t AS (SELECT seq, source, len({d.toks(d.MATH)}) - len({d.toks(d.PREFIX)}) AS tokens, sha256('replay' || chr(10) || '11' || chr(10) || source || chr(10) || {d.question('instruction')}) AS key, sha256('fill' || chr(10) || '11' || chr(10) || source || chr(10) || {d.question('instruction')}) AS fill FROM sft_records)"


def _records(spark, sf_dir):
    c = K.token_counts(X.format_math_sft(), X.instruction_prefix())
    return view(spark, sf_dir, "sft_records").select("seq", "source", c["supervised"].cast("long").alias("tokens"), X.normalize_question("instruction").alias("normalized"))


@query("replay_budget", RECORDS + " SELECT seq, tokens FROM (SELECT *, sum(tokens) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) - tokens AS before FROM t) WHERE before < 2000")
def replay_budget(spark, sf_dir):
    return sel.running_budget(_records(spark, sf_dir), "tokens", X.stable_key(11, "replay"), 2000, ties=["seq"]).select("seq", "tokens")


BALANCED = RECORDS + """, q AS (SELECT source, round_even(CAST(3000 AS DOUBLE) * sum(tokens) / (SELECT sum(tokens) FROM t), 0)::BIGINT AS quota FROM t GROUP BY source),
  f AS (SELECT t.*, quota, sum(tokens) OVER (PARTITION BY t.source ORDER BY key ROWS UNBOUNDED PRECEDING) - tokens AS before FROM t JOIN q ON t.source = q.source), s AS (SELECT * FROM f WHERE before < quota), h AS (SELECT coalesce(sum(tokens), 0) AS have FROM s),
  r AS (SELECT t.*, sum(tokens) OVER (ORDER BY fill ROWS UNBOUNDED PRECEDING) - tokens AS before FROM t WHERE seq NOT IN (SELECT seq FROM s))"""


@query("source_balanced_replay", BALANCED + " SELECT seq, source, tokens, 'source' AS replay_part FROM s UNION ALL SELECT seq, source, tokens, 'fill' FROM r, h WHERE before < 3000 - have")
def source_balanced_replay(spark, sf_dir):
    out = sel.balanced_replay(_records(spark, sf_dir), "source", "tokens", 3000, X.stable_key(11, "replay"), X.stable_key(11, "fill"), ties=["seq"])
    return out.select("seq", "source", "tokens", "replay_part")


@query("mixture_summary", BALANCED + ", m AS (SELECT source, tokens FROM s UNION ALL SELECT source, tokens FROM r, h WHERE before < 3000 - have) SELECT source, count(*) AS samples, sum(tokens)::BIGINT AS supervised_tokens FROM m GROUP BY source")
def mixture_summary(spark, sf_dir):
    return source_balanced_replay(spark, sf_dir).groupBy("source").agg(F.count("*").alias("samples"), F.sum("tokens").alias("supervised_tokens"))


FAILED = _with() + f", f AS (SELECT seq, source, {MINING} AS kind FROM scored)"
ORDER = ["src3", "src1"]
PLACE = "CASE source WHEN 'src3' THEN '000001' WHEN 'src1' THEN '000002' ELSE '~' || source END"


def _failures(spark, sf_dir):
    return _predictions(spark, sf_dir).select("seq", "source", S.mining_class().alias("kind"))


@query("round_robin_queue", FAILED + f", r AS (SELECT seq, source, row_number() OVER (PARTITION BY source ORDER BY seq) AS turn, {PLACE} AS place FROM f WHERE kind = 'truncated') SELECT seq, source, turn FROM r ORDER BY turn, place LIMIT 15")
def round_robin_queue(spark, sf_dir):
    rows = _failures(spark, sf_dir).filter("kind = 'truncated'")
    return sel.round_robin(rows, "source", ORDER, "seq", 15, ties=["seq", "source"]).select("seq", "source", "turn")


@query("failure_share_queue", FAILED + f""", n AS (SELECT count(*) FILTER (WHERE kind = 'truncated') AS t, count(*) FILTER (WHERE kind = 'wrong_complete') AS w FROM f), l AS (SELECT least(30 - least(30 - least(12, t), w), t) AS cut, least(30 - least(12, t), w) AS wrong FROM n),
  r AS (SELECT *, row_number() OVER (PARTITION BY kind, source ORDER BY seq) AS turn, {PLACE} AS place FROM f WHERE kind <> 'correct_complete'), x AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY turn, place) AS rn FROM r)
  SELECT seq, source, kind FROM x, l WHERE rn <= CASE WHEN kind = 'truncated' THEN cut ELSE wrong END""")
def failure_share_queue(spark, sf_dir):
    return sel.failure_share(_failures(spark, sf_dir), "kind", "source", ORDER, "seq", 30, 0.4, ties=["seq", "source"])


@query("exclude_evaluated", "SELECT doc_id FROM documents WHERE (text, source) NOT IN (SELECT text, source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def exclude_evaluated(spark, sf_dir):
    """Documents whose text and source are no toxic one's, by digest."""
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").select("doc_id").distinct()
    rows = _docs(spark, sf_dir).select("doc_id", F.struct(F.sha2("text", 256).alias("text"), "source").alias("pair"))
    return joins.exact_overlap(rows, rows.join(toxic, "doc_id", "left_semi"), "pair", anti=True).select("doc_id")


@query("question_join", rf"WITH {ctes('sft_records', 'intermediates')}, r AS (SELECT regexp_replace({d.strip('instruction')}, '\s+', ' ', 'g') AS q, arg_max(answer, seq) AS last_answer FROM intermediates GROUP BY 1) SELECT s.seq, r.last_answer FROM sft_records s JOIN r ON regexp_replace({d.strip('s.instruction')}, '\s+', ' ', 'g') = r.q")
def question_join(spark, sf_dir):
    """Records with the answer of the last intermediate of their question."""
    key = F.regexp_replace(X.strip("instruction"), r"(?U)\s+", " ")
    right = joins.last_by_key(view(spark, sf_dir, "intermediates"), key, "seq").select("join_key", F.col("answer").alias("last_answer"))
    return view(spark, sf_dir, "sft_records").withColumn("join_key", key).join(right, "join_key").select("seq", "last_answer")


@query("random_prompts", f"WITH {ctes('sft_records')} SELECT seq FROM sft_records ORDER BY sha256('step3' || chr(10) || seq::VARCHAR) LIMIT 8")
def random_prompts(spark, sf_dir):
    return view(spark, sf_dir, "sft_records").orderBy(X.sha_key(F.lit("step3"), F.col("seq").cast("string"))).limit(8).select("seq")


@query("matched_control")
def matched_control(spark, sf_dir):
    """Controls for every fifth record among the others; sequential, so tests hold it against plain Python."""
    rows = _records(spark, sf_dir)
    return joins.match_controls(rows.filter("seq % 5 = 0"), rows.filter("seq % 5 <> 0"), "tokens", "seq").select("seq", "tokens")


@query("zip_rows", f"WITH {ctes('predictions')} SELECT a.seq, a.prediction AS first_prediction, b.prediction AS second_prediction FROM predictions a JOIN predictions b ON a.seq = b.seq WHERE a.model = 'm0' AND b.model = 'm1'")
def zip_rows(spark, sf_dir):
    p = view(spark, sf_dir, "predictions").select("seq", "instruction", "prediction", "model")
    out = joins.zip_rows(p.filter("model = 'm0'"), p.filter("model = 'm1'"), "instruction")
    return out.select("seq", F.col("prediction").alias("first_prediction"), F.col("b_prediction").alias("second_prediction"))


@query("last_by_question", rf"WITH {ctes('sft_records')}, t AS (SELECT seq, regexp_replace({d.strip('instruction')}, '\s+', ' ', 'g') AS q FROM sft_records) SELECT q AS join_key, max(seq) AS seq FROM t GROUP BY q")
def last_by_question(spark, sf_dir):
    key = F.regexp_replace(X.strip("instruction"), r"(?U)\s+", " ")
    return joins.last_by_key(view(spark, sf_dir, "sft_records"), key, "seq").select("join_key", "seq")


@query("ledger_sets", f"WITH {ctes('synthesis')}, a AS (SELECT candidate_id FROM synthesis WHERE k % 2 = 0), b AS (SELECT candidate_id FROM synthesis WHERE k % 3 = 0) SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) UNION ALL SELECT 'distinct', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def ledger_sets(spark, sf_dir):
    rows = view(spark, sf_dir, "synthesis")
    a, b = rows.filter("k % 2 = 0").select("candidate_id"), rows.filter("k % 3 = 0").select("candidate_id")
    out = None
    for name, df in (("union", a.unionByName(b)), ("distinct", a.unionByName(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b))):
        one = df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("scored_events", "SELECT event_id, user_id, event_type, CASE WHEN value < 10 THEN 'low' WHEN value < 100 THEN 'mid' ELSE 'high' END AS band, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def scored_events(spark, sf_dir):
    """The stateless stream's transformation, on the table at once."""
    return streams.scored_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("event_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def event_counts(spark, sf_dir):
    return stats.counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type")
