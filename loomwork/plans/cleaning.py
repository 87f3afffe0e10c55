"""Queries that extract, gate, repair and decontaminate."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.functions import tokens as K
from loomwork.operators import gates, joins, near, similar, stats
from loomwork.operators import select as sel
from loomwork.operators.store import spread, stored
from loomwork.plans import dialect as d
from loomwork.plans.fixtures import ctes, view
from loomwork.plans.registry import query
from loomwork.sources import records as io


@query("extract_boxed_all", f"WITH {ctes('boxed')} SELECT seq, {d.boxes('answer')} AS boxes FROM boxed")
def extract_boxed_all(spark, sf_dir):
    return view(spark, sf_dir, "boxed").select("seq", X.balanced_boxes("answer").alias("boxes"))


@query("extract_boxed_first", rf"WITH {ctes('boxed')}, t AS (SELECT seq, substr(answer, instr(answer, '\boxed{{')) AS t FROM boxed WHERE contains(answer, '\boxed{{')) SELECT seq, CASE WHEN regexp_matches(t, '^{d.BOX}') THEN {d.strip(f"regexp_extract(t, '^{d.BOX}', 1)")} END AS box FROM t")
def extract_boxed_first(spark, sf_dir):
    return view(spark, sf_dir, "boxed").filter(F.col("answer").contains(X.BOX)).select("seq", X.first_box("answer").alias("box"))


LEAD = r"(?i)^[因此所以故综上答案最终答案ThusThereforeHenceSoThe answer is]+[，,:.：\s]*"


@query("clean_answer_legacy", rf"""WITH {ctes('boxed')}, t AS (SELECT seq, {d.strip('answer')} AS x FROM boxed),
  u AS (SELECT seq, x, regexp_extract_all(x, '\\boxed\{{([^}}]+)\}}', 1) AS b, replace(replace(replace(replace({d.strip(f"regexp_replace(x, '{LEAD}', '')")}, '\(', ''), '\)', ''), '\[', ''), '\]', '') AS p FROM t)
  SELECT seq, CASE WHEN len(b) > 0 THEN {d.strip('list_last(b)')} ELSE {d.strip(r"CASE WHEN length(p) > 100 THEN coalesce(list_last(regexp_extract_all(p, '-?\d+\.?\d*')), p) ELSE p END")} END AS cleaned FROM u""")
def clean_answer_legacy(spark, sf_dir):
    return view(spark, sf_dir, "boxed").select("seq", X.clean_answer_legacy("answer").alias("cleaned"))


@query("required_text_gate", f"""WITH {ctes('sft_records')} SELECT seq, list_filter([CASE WHEN {d.strip('instruction')} = '' THEN 'instruction' END, CASE WHEN {d.strip('reasoning')} = '' THEN 'reasoning' END, CASE WHEN {d.strip('answer')} = '' THEN 'answer' END], lambda x: x IS NOT NULL) AS missing_fields,
  CASE WHEN {d.strip('instruction')} = '' OR {d.strip('reasoning')} = '' OR {d.strip('answer')} = '' THEN 'missing_required_text' END AS reject_reason FROM sft_records""")
def required_text_gate(spark, sf_dir):
    return gates.required_text(view(spark, sf_dir, "sft_records"), ["instruction", "reasoning", "answer"]).select("seq", "missing_fields", "reject_reason")


GATE_LIMIT = 150
GATED = f"""WITH {ctes('sft_records')}, g AS (SELECT *, len({d.toks(d.MATH)}) AS t, {d.strip('answer')} = '' AS blank FROM sft_records),
  r AS (SELECT *, CASE WHEN blank THEN 'missing_required_text' WHEN t > {GATE_LIMIT} THEN 'too_long' END AS reject_reason FROM g)"""


def _gated(spark, sf_dir):
    rows = gates.required_text(view(spark, sf_dir, "sft_records"), ["instruction", "reasoning", "answer"])
    return gates.max_length(rows, K.token_length(X.format_math_sft()), GATE_LIMIT)


@query("length_gate", GATED + " SELECT seq, t AS sft_token_length, reject_reason FROM r")
def length_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("seq", "sft_token_length", "reject_reason")


@query("clean_manifest", GATED + " SELECT count(*) AS input, count(*) FILTER (WHERE reject_reason IS NULL) AS clean, count(*) FILTER (WHERE reject_reason = 'too_long') AS too_long, count(*) FILTER (WHERE reject_reason = 'missing_required_text') AS missing_required_text FROM r")
def clean_manifest(spark, sf_dir):
    counts = {"input": F.count("*"), "clean": F.count_if(F.col("reject_reason").isNull()), **{r: F.count_if(F.coalesce(F.col("reject_reason") == r, F.lit(False))) for r in ("too_long", "missing_required_text")}}
    text = io.manifest(_gated(spark, sf_dir), **counts)
    return text.select(F.from_json("manifest", ", ".join(f"{n} long" for n in counts)).alias("m")).select("m.*")


@query("source_length_stats", GATED + f" SELECT source, count(*) AS seen, count(*) FILTER (WHERE reject_reason IS NULL) AS kept, min(t) AS min, {d.pct('t', 0.5)} AS p50, {d.pct('t', 0.95)} AS p95, max(t) AS max FROM r GROUP BY source")
def source_length_stats(spark, sf_dir):
    rows = _gated(spark, sf_dir)
    own = rows.groupBy("source").agg(F.count("*").alias("seen"), F.count_if(F.col("reject_reason").isNull()).alias("kept"), F.min("sft_token_length").alias("min"), F.max("sft_token_length").alias("max"))
    return own.join(stats.order_statistic(rows, "sft_token_length", {"p50": 0.5, "p95": 0.95}, ["source"]), "source")


@query("length_buckets", GATED + " SELECT CASE WHEN t <= 50 THEN '<=50' WHEN t <= 100 THEN '51-100' WHEN t <= 200 THEN '101-200' ELSE '>200' END AS closed, CASE WHEN t < 50 THEN '[0,50)' WHEN t < 100 THEN '[50,100)' WHEN t < 200 THEN '[100,200)' ELSE '[200,)' END AS half_open, count(*) AS n FROM r GROUP BY 1, 2")
def length_buckets(spark, sf_dir):
    t = F.col("sft_token_length")
    closed = F.when(t <= 50, "<=50").when(t <= 100, "51-100").when(t <= 200, "101-200").otherwise(">200")
    half = stats.bucket(t, (0, 50, 100, 200, 10**9), ["[0,50)", "[50,100)", "[100,200)", "[200,)"])
    return stats.counts(_gated(spark, sf_dir).withColumns({"closed": closed, "half_open": half}), "closed", "half_open")


@query("truncation_damage", f"""WITH {ctes('sft_records')}, g AS (SELECT source, {d.toks(d.MATH)} AS k FROM sft_records WHERE reasoning <> '' AND answer <> ''),
  c AS (SELECT source, len(k) AS t, len(k) > {GATE_LIMIT} AS over_limit, array_to_string(k[1:{GATE_LIMIT}], '') AS cut FROM g)
  SELECT source, count(*) AS n, {d.pct('t', 0.5)} AS p50, {d.pct('t', 0.95)} AS p95, max(t) AS max, round(avg(CASE WHEN over_limit THEN 1.0 ELSE 0 END), 6) AS over_share,
    round(avg(CASE WHEN over_limit AND NOT (contains(cut, '</think>') AND contains(cut, '</answer>')) THEN 1.0 ELSE 0 END), 6) AS broken_share FROM c GROUP BY source""")
def truncation_damage(spark, sf_dir):
    rows = view(spark, sf_dir, "sft_records").filter("reasoning <> '' AND answer <> ''").select("source", K.tokens(X.format_math_sft()).alias("k"))
    rows = rows.withColumns({"t": F.size("k"), "broken": K.breaks_tags(F.col("k"), GATE_LIMIT)})
    own = rows.groupBy("source").agg(F.count("*").alias("n"), F.max("t").alias("max"), stats.share(F.col("t") > GATE_LIMIT).alias("over_share"), stats.share(F.col("broken")).alias("broken_share"))
    return own.join(stats.order_statistic(rows, "t", {"p50": 0.5, "p95": 0.95}, ["source"]), "source")


@query("length_profile", f"""SELECT min(length(text)) AS min, max(length(text)) AS max, round(avg(length(text)), 6) AS mean, round(avg(CASE WHEN length(text) < 10 THEN 1.0 ELSE 0 END), 6) AS short_share, round(avg(CASE WHEN length(text) > 2000 THEN 1.0 ELSE 0 END), 6) AS long_share,
  {d.pct('length(text)', 0.1)} AS p10, {d.pct('length(text)', 0.25)} AS p25, {d.pct('length(text)', 0.5)} AS median, {d.pct('length(text)', 0.75)} AS p75, {d.pct('length(text)', 0.9)} AS p90 FROM documents""")
def length_profile(spark, sf_dir):
    return stats.length_profile(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.length("text").alias("n")), "n")


@query("corpus_profile", f"WITH {ctes('firefly')} SELECT kind, count(*) AS n, round(count(*) / (SELECT count(*) FROM firefly), 6) AS share, count(*) FILTER (WHERE input = '') AS empty_input, count(*) FILTER (WHERE target = '') AS empty_target FROM firefly GROUP BY kind ORDER BY n DESC, kind LIMIT 25")
def corpus_profile(spark, sf_dir):
    rows = view(spark, sf_dir, "firefly")
    total = rows.agg(F.count("*").alias("total"))
    kinds = rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("input") == "").alias("empty_input"), F.count_if(F.col("target") == "").alias("empty_target"))
    return kinds.orderBy(F.desc("n"), "kind").limit(25).crossJoin(F.broadcast(total)).select("kind", "n", (F.col("n") / F.col("total")).alias("share"), "empty_input", "empty_target")


@query("length_filter_clip", f"WITH {ctes('firefly')} SELECT seq, substr(target, 1, 2000) AS target FROM firefly WHERE length(target) >= 20 AND kind NOT IN ('src1', 'src2')")
def length_filter_clip(spark, sf_dir):
    return view(spark, sf_dir, "firefly").filter((F.length("target") >= 20) & ~F.col("kind").isin("src1", "src2")).select("seq", F.substring("target", 1, 2000).alias("target"))


REPAIR_LIMIT = 120


@query("answer_repair_join", f"""WITH {ctes('boxed', 'intermediates')}, l AS (SELECT *, row_number() OVER (PARTITION BY source, instruction, reasoning ORDER BY seq) AS rn FROM boxed),
  r AS (SELECT *, row_number() OVER (PARTITION BY source, instruction, reasoning ORDER BY len({d.full_boxes('answer')}) > 0 DESC, seq) AS rn FROM intermediates),
  j AS (SELECT l.seq, l.instruction, l.reasoning, r.seq IS NOT NULL AS matched, list_last({d.full_boxes('r.answer')}) AS box, l.answer AS old FROM l LEFT JOIN r USING (source, instruction, reasoning, rn)),
  k AS (SELECT seq, matched, box, instruction, reasoning, coalesce(box, old) AS answer FROM j), t AS (SELECT *, len({d.toks(d.MATH)}) AS n FROM k)
  SELECT seq, answer, n AS sft_token_length, CASE WHEN NOT matched THEN 'intermediate_join_missing' WHEN box IS NULL THEN 'no_balanced_box' WHEN n > {REPAIR_LIMIT} THEN 'too_long_after_repair' ELSE 'accepted' END AS repair_status FROM t""")
def answer_repair_join(spark, sf_dir):
    out = joins.repair_answers(view(spark, sf_dir, "boxed"), view(spark, sf_dir, "intermediates"), K.token_length(X.format_math_sft()), REPAIR_LIMIT)
    return out.select("seq", "answer", "sft_token_length", "repair_status")


@query("reliable_gold_gather", f"""WITH {ctes('sft_records', 'intermediates')}, b AS (SELECT source, instruction, reasoning, seq, unnest({d.full_boxes('answer')}) AS box, generate_subscripts({d.full_boxes('answer')}, 1) AS i FROM intermediates),
  g AS (SELECT source, instruction, reasoning, list_last(list(box ORDER BY seq, i)) AS reliable_answer FROM b GROUP BY 1, 2, 3) SELECT s.seq, g.reliable_answer FROM sft_records s LEFT JOIN g USING (source, instruction, reasoning)""")
def reliable_gold_gather(spark, sf_dir):
    out = joins.gather_last_box(view(spark, sf_dir, "sft_records"), view(spark, sf_dir, "intermediates"), ["source", "instruction", "reasoning"])
    return out.select("seq", "reliable_answer")


@query("consistency_gate", f"""WITH {ctes('boxed')}, t AS (SELECT seq, list_last({d.full_boxes('answer')}) AS box, plain FROM boxed) SELECT seq, box AS reasoning_last_box, CASE WHEN box <> {d.strip('plain')} THEN 'rejected' ELSE 'accepted' END AS finalize_status FROM t""")
def consistency_gate(spark, sf_dir):
    rows = view(spark, sf_dir, "boxed").select("seq", F.col("answer").alias("reasoning"), F.col("plain").alias("answer"))
    return gates.box_consistency(rows).select("seq", "reasoning_last_box", "finalize_status")


@query("control_char_audit", r"""WITH p AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN chr(8) || 'oxed{1}' WHEN 1 THEN chr(12) || 'rac{1}{2}' WHEN 2 THEN chr(7) ELSE '' END AS part FROM documents),
  t AS (SELECT doc_id, part || text || part AS t FROM p),
  u AS (SELECT doc_id, replace(replace(t, chr(8) || 'oxed', '\boxed'), chr(12) || 'rac', '\frac') AS repaired FROM t) SELECT doc_id, repaired, regexp_matches(repaired, '[\x00-\x08\x0b\x0c\x0e-\x1f]') AS unsupported FROM u""")
def control_char_audit(spark, sf_dir):
    part = F.when(F.col("doc_id") % 4 == 0, "\x08oxed{1}").when(F.col("doc_id") % 4 == 1, "\x0crac{1}{2}").when(F.col("doc_id") % 4 == 2, "\x07").otherwise("")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(part, "text", part).alias("t"))
    return rows.select("doc_id", X.repair_control_chars("t").alias("repaired")).withColumn("unsupported", X.has_control_char("repaired"))


# RE2 knows no escapes of non-ASCII characters; they mean the characters themselves
MATHS = " OR ".join(f"regexp_matches(input || ' ' || target, '(?i){p.replace(chr(92) + '×', '×').replace(chr(92) + '÷', '÷')}')" for p in X.MATH_PATTERNS)


@query("math_indicator_filter", f"WITH {ctes('firefly')} SELECT seq FROM firefly WHERE kind = 'Cot' AND ({MATHS})")
def math_indicator_filter(spark, sf_dir):
    return view(spark, sf_dir, "firefly").filter((F.col("kind") == "Cot") & X.is_math("input", "target")).select("seq")


@query("suffix_answer", rf"""WITH {ctes('firefly')}, t AS (SELECT seq, input, regexp_replace({d.strip(f"string_split({d.strip(r"regexp_extract(target, '(?s)答案是[：:]\s*(.+)', 1)")}, chr(10))[1]")}, '[.。]+$', '') AS raw FROM firefly WHERE kind = 'Cot' AND ({MATHS}) AND regexp_matches(target, '(?s)答案是[：:]\s*(.+)'))
  SELECT seq, input AS prompt, {d.strip('raw')} AS reference_answer, 'firefly' AS source FROM t WHERE length(raw) <= 50""")
def suffix_answer(spark, sf_dir):
    rows = view(spark, sf_dir, "firefly").filter((F.col("kind") == "Cot") & X.is_math("input", "target"))
    return rows.select("seq", F.col("input").alias("prompt"), X.suffix_answer("target").alias("reference_answer"), F.lit("firefly").alias("source")).filter("reference_answer IS NOT NULL")


@query("boxed_prompts", rf"WITH {ctes('boxed')}, t AS (SELECT seq, instruction, substr(answer, instr(answer, '\boxed{{')) AS t FROM boxed WHERE contains(answer, '\boxed{{')) SELECT seq, instruction AS prompt, {d.strip(f"regexp_extract(t, '^{d.BOX}', 1)")} AS reference_answer, 'math' AS source FROM t WHERE regexp_matches(t, '^{d.BOX}')")
def boxed_prompts(spark, sf_dir):
    rows = view(spark, sf_dir, "boxed").select("seq", F.col("instruction").alias("prompt"), X.first_box("answer").alias("reference_answer"), F.lit("math").alias("source"))
    return rows.filter("reference_answer IS NOT NULL")


@query("chat_records", """WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS instruction, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS reasoning FROM conversations GROUP BY conv_id)
  SELECT conv_id::VARCHAR AS source, instruction, reasoning FROM f WHERE instruction IS NOT NULL AND reasoning IS NOT NULL""")
def chat_records(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    chats = turns.groupBy("conv_id").agg(ordered.alias("m")).select(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), F.col("conv_id").cast("string").alias("source"))
    return io.from_chat(chats).select("source", "instruction", "reasoning")


NORM_DOCS = f"n AS (SELECT doc_id, {d.question('text')} AS t FROM documents), b AS (SELECT item_id, {d.question('text')} AS t FROM benchmark)"


def _normal(spark, sf_dir, table, key):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, X.normalize_question("text").alias("t"))


def _toxic(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").select("doc_id").distinct()


def _evaluation(spark, sf_dir):
    """Normal forms of the evaluation sets: the benchmark, and the documents that are labelled toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(_toxic(spark, sf_dir), "doc_id", "left_semi").select("text")
    texts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").unionByName(docs)
    return texts.select(X.normalize_question("text").alias("t"))


EVALUATION = f"{NORM_DOCS}, e AS (SELECT t FROM b UNION SELECT n.t FROM n JOIN labels l ON n.doc_id = l.doc_id WHERE l.toxic = 1)"


@query("evaluation_signatures", f"WITH {EVALUATION} SELECT sha256(t) AS signature, length(t) AS n_chars, CASE WHEN length(t) <= 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i::BIGINT, 5)))) END AS n_grams FROM e")
def evaluation_signatures(spark, sf_dir):
    return joins.evaluation_signatures([_evaluation(spark, sf_dir)], "t").select("signature", F.length("t").alias("n_chars"), F.size("grams").alias("n_grams"))


@query("decontam_exact", f"WITH {EVALUATION} SELECT doc_id, t IN (SELECT t FROM e) AS is_duplicate FROM n")
def decontam_exact(spark, sf_dir):
    """All documents against the evaluation sets, by digest: every text is normalised once, and only digests are joined."""
    toxic = _toxic(spark, sf_dir).withColumn("known", F.lit(True))
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit(True).alias("is_doc")))
    docs = docs.join(F.broadcast(toxic) if joins.small_enough(toxic) else toxic, "doc_id", "left")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(False).alias("is_doc"), F.lit(True).alias("known"))
    rows = stored(docs.unionByName(items).select("doc_id", "is_doc", "known", F.sha2(X.normalize_question("text"), 256).alias("signature")))
    known = rows.filter("known").select("signature").distinct().withColumn("is_duplicate", F.lit(True))
    out = rows.filter("is_doc").join(F.broadcast(known) if joins.small_enough(known) else known, "signature", "left")
    return out.select("doc_id", F.coalesce("is_duplicate", F.lit(False)).alias("is_duplicate"))


def _near_sql(condition: str) -> str:
    """CTE members: g (doc_id, t, g, c the least doc_id of its text) and p, the pairs of classes whose lengths meet the condition."""
    return f"""{NORM_DOCS}, g AS (SELECT min(doc_id) AS doc_id, t, CASE WHEN length(t) <= 5 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i::BIGINT, 5))) END AS g FROM n WHERE t IS NOT NULL GROUP BY t),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.g AS ga, b.g AS gb, len(a.g) AS na, len(b.g) AS nb FROM g a JOIN g b ON a.doc_id < b.doc_id AND least(len(a.g), len(b.g)) >= 0.85 * greatest(len(a.g), len(b.g)) AND ({condition})),
  q AS (SELECT a, b, na, nb, len(list_intersect(ga, gb)) AS c FROM p), links AS MATERIALIZED (SELECT a, b, c / (na + nb - c) AS jaccard FROM q WHERE c / (na + nb - c) >= 0.85)"""


WAY = "length(a.t) / greatest(1, length(b.t)) BETWEEN 0.75 AND 1.33"
BACK = "length(b.t) / greatest(1, length(a.t)) BETWEEN 0.75 AND 1.33"


def _stored_docs(spark, sf_dir):
    """Normal forms of the documents, worked out once."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return stored(docs.select("doc_id", X.normalize_question("text").alias("t")))


@query("decontam_near", f"""WITH RECURSIVE {_near_sql(f"{WAY} OR {BACK}")}, e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), least AS (SELECT a, min(b) AS group_id FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
  SELECT n.doc_id, coalesce(g.doc_id, n.doc_id) AS class_id, coalesce(least.group_id, n.doc_id) AS group_id, coalesce(degree.n_links, 0) AS n_links FROM n LEFT JOIN g ON n.t = g.t LEFT JOIN least ON g.doc_id = least.a LEFT JOIN degree ON g.doc_id = degree.a""")
def decontam_near(spark, sf_dir):
    """Class of equal normal forms, group of near-duplicates and number of links of each document."""
    return near.near_links(_stored_docs(spark, sf_dir), "doc_id", "t")


@query("decontam_near_pairs", f"WITH {_near_sql(WAY)} SELECT a AS doc_id_a, b AS doc_id_b, round(jaccard, 6) AS jaccard FROM links")
def decontam_near_pairs(spark, sf_dir):
    """Links between different normal forms, each by its least document."""
    return near.near_pairs(_stored_docs(spark, sf_dir), "doc_id", "t")


def _evaluation_texts(spark, sf_dir):
    """Evaluation texts near documents: items of the benchmark, and toxic documents without their last character."""
    docs = _toxic_docs(spark, sf_dir).select(F.expr("left(text, length(text) - 1)").alias("text"))
    texts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").unionByName(docs)
    return stored(texts.select(X.normalize_question("text").alias("t")))


def _toxic_docs(spark, sf_dir):
    """Documents labelled toxic: their ids go to the texts, no text is shuffled for them."""
    toxic = _toxic(spark, sf_dir)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").join(F.broadcast(toxic) if joins.small_enough(toxic, similar.KEYS) else toxic, "doc_id", "left_semi")


GRAMS = "CASE WHEN length(t) <= 5 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i::BIGINT, 5))) END"


@query("decontam_near_evaluation", f"""WITH n AS (SELECT doc_id, {d.question('text')} AS t FROM documents), x AS (SELECT {d.question('text')} AS t FROM benchmark UNION SELECT {d.question('left(text, length(text) - 1)')} FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
  a AS (SELECT doc_id, t, {GRAMS} AS g FROM n), b AS (SELECT t, {GRAMS} AS g FROM x WHERE t IS NOT NULL),
  p AS (SELECT DISTINCT doc_id FROM a JOIN b ON least(len(a.g), len(b.g)) >= 0.85 * greatest(len(a.g), len(b.g)) AND {WAY} WHERE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.85)
  SELECT doc_id, doc_id IN (SELECT doc_id FROM p) AS near_evaluation FROM n""")
def decontam_near_evaluation(spark, sf_dir):
    """Documents that are near some evaluation text."""
    return near.near_evaluation(_stored_docs(spark, sf_dir), _evaluation_texts(spark, sf_dir), "t").select("doc_id", "near_evaluation")


@query("decontam_contained", f"WITH {NORM_DOCS} SELECT doc_id, item_id FROM n, b WHERE b.t <> '' AND contains(n.t, b.t)")
def decontam_contained(spark, sf_dir):
    return joins.contained_items(_stored_docs(spark, sf_dir), _normal(spark, sf_dir, "benchmark", "item_id"), "doc_id", "item_id", "t")


@query("sft_format", f"WITH {ctes('sft_records')} SELECT seq, {d.MATH} AS text, {d.PREFIX} AS prefix FROM sft_records")
def sft_format(spark, sf_dir):
    return view(spark, sf_dir, "sft_records").select("seq", X.format_math_sft().alias("text"), X.instruction_prefix().alias("prefix"))


IDS = f"list_transform({d.toks(d.MATH)}, lambda x: length(x)::BIGINT)"
PRE = f"len({d.toks(d.PREFIX)})"


def _ids(c):
    return F.transform(K.tokens(c), F.length)


@query("label_mask", f"WITH {ctes('sft_records')}, t AS (SELECT seq, {IDS} AS ids, {PRE} AS p FROM sft_records) SELECT seq, ids AS input_ids, list_concat(list_transform(range(p), lambda i: -100::BIGINT), ids[p + 1:]) AS labels FROM t WHERE p < len(ids) AND len(ids) >= 10")
def label_mask(spark, sf_dir):
    return K.sft_labels(view(spark, sf_dir, "sft_records"), X.format_math_sft(), _ids).select("seq", "input_ids", "labels")


@query("pad_batches", f"""WITH {ctes('sft_records')}, t AS (SELECT seq, {IDS} AS ids, {PRE} AS p FROM sft_records), l AS (SELECT seq, seq % 16 AS b, ids, list_concat(list_transform(range(p), lambda i: -100::BIGINT), ids[p + 1:]) AS labels FROM t WHERE p < len(ids) AND len(ids) >= 10),
  w AS (SELECT *, least(max(len(ids)) OVER (PARTITION BY b), 200) AS w FROM l), c AS (SELECT *, least(len(ids), w) AS n FROM w)
  SELECT seq, b AS batch, list_concat(ids[1:n], list_transform(range(w - n), lambda i: 0::BIGINT)) AS input_ids, list_concat(labels[1:n], list_transform(range(w - n), lambda i: -100::BIGINT)) AS labels, list_concat(list_transform(range(n), lambda i: 1::BIGINT), list_transform(range(w - n), lambda i: 0::BIGINT)) AS attention_mask FROM c""")
def pad_batches(spark, sf_dir):
    rows = K.sft_labels(view(spark, sf_dir, "sft_records"), X.format_math_sft(), _ids).select("seq", "input_ids", "labels")
    return K.pad_batches(rows, F.col("seq") % 16, max_length=200)


@query("response_mask", f"WITH {ctes('sft_records')}, t AS (SELECT seq, {IDS} AS ids, {PRE} AS p FROM sft_records) SELECT seq, list_transform(range(len(ids)), lambda i: CASE WHEN i >= p THEN 1::BIGINT ELSE 0::BIGINT END) AS mask FROM t")
def response_mask(spark, sf_dir):
    rows = view(spark, sf_dir, "sft_records").select("seq", _ids(X.format_math_sft()).alias("ids"), F.size(K.tokens(X.instruction_prefix())).alias("p"))
    return rows.select("seq", K.response_mask(F.transform("ids", lambda x: F.lit(1)), F.col("p")).alias("mask"))


@query("token_counts", f"WITH {ctes('sft_records')} SELECT seq, len({d.toks(d.MATH)}) AS full_tokens, len({d.toks(d.MATH)}) - {PRE} AS supervised_tokens FROM sft_records")
def token_counts(spark, sf_dir):
    c = K.token_counts(X.format_math_sft(), X.instruction_prefix())
    return view(spark, sf_dir, "sft_records").select("seq", c["full"].alias("full_tokens"), c["supervised"].alias("supervised_tokens"))


@query("chat_render", """WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS q FROM conversations),
  t AS (SELECT conv_id, i, CASE WHEN role = 'assistant' AND turn > coalesce(q, -1) AND q IS NOT NULL AND i = n - 1 THEN '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || regexp_replace(text, '^\\n+', '') || '<|im_end|>' || chr(10)
    ELSE '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) END AS x FROM m) SELECT conv_id, string_agg(x, '' ORDER BY i) AS text FROM t GROUP BY conv_id""")
def chat_render(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(ordered.alias("m")).select("conv_id", X.render_chat(F.col("m")).alias("text"))


@query("generation_prompts", f"WITH {ctes('sft_records')} SELECT seq, {d.PREFIX} || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) AS prompt FROM sft_records")
def generation_prompts(spark, sf_dir):
    one = F.array(F.struct(F.lit("user").alias("role"), F.col("instruction").alias("content")))
    return view(spark, sf_dir, "sft_records").select("seq", X.render_chat(one, generation_prompt=True, thinking=False).alias("prompt"))


@query("generic_format", f"WITH {ctes('firefly')} SELECT seq, '<|im_start|>user' || chr(10) || input || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || target || chr(10) || '</think><|im_end|>' AS text FROM firefly")
def generic_format(spark, sf_dir):
    return view(spark, sf_dir, "firefly").select("seq", X.format_generic_sft("input", "target").alias("text"))


@query("repeat_prompts", f"WITH {ctes('sft_records')} SELECT seq, unnest([1, 2, 3, 4])::BIGINT AS replica FROM sft_records")
def repeat_prompts(spark, sf_dir):
    return view(spark, sf_dir, "sft_records").select("seq", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("replica"))


@query("row_slice", f"WITH {ctes('sft_records')} SELECT seq, source FROM sft_records ORDER BY seq LIMIT 20 OFFSET 5")
def row_slice(spark, sf_dir):
    return sel.slice_rows(view(spark, sf_dir, "sft_records"), "seq", 5, 20).select("seq", "source")
