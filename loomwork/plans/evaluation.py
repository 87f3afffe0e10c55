"""Queries that score predictions and compare models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import scoring as S
from loomwork.functions import text as X
from loomwork.functions.answers import check_correct, extract_number, normalize_answer
from loomwork.functions import tokens as K
from loomwork.operators import gates, joins, stats
from loomwork.operators import select as sel
from loomwork.plans import dialect as d
from loomwork.plans.fixtures import ctes, view
from loomwork.plans.registry import query


def _predictions(spark: SparkSession, sf_dir: str, model: str | None = "m0") -> DataFrame:
    df = view(spark, sf_dir, "predictions")
    return df if model is None else df.filter(F.col("model") == model)


ONE = "p AS (SELECT * FROM predictions WHERE model = 'm0')"


def _with(view_name: str = "predictions", form: str = "full", one: bool = True) -> str:
    return f"WITH {ctes(view_name)}{', ' + ONE if one else ''}, {d.scored('p' if one else view_name, form)}"


@query("eval_by_source", _with() + """
  SELECT source, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN completeness <> 'complete' THEN 1.0 ELSE 0.0 END), 6) AS truncation_rate,
    round(avg(length(prediction)), 6) AS avg_output_len FROM scored GROUP BY source""")
def eval_by_source(spark, sf_dir):
    rows = _predictions(spark, sf_dir).withColumns({"ok": S.tagged_correct(), "done": S.completeness()})
    return rows.groupBy("source").agg(F.count("*").alias("n"), stats.share(F.col("ok")).alias("accuracy"), stats.share(F.col("done") != "complete").alias("truncation_rate"), F.avg(F.length("prediction")).alias("avg_output_len"))


@query("prediction_lengths", _with() + f"""
  SELECT source, {d.pct('length(prediction)', 0.5)} AS p50, {d.pct('length(prediction)', 0.9)} AS p90, {d.pct('length(prediction)', 0.95)} AS p95, {d.pct('length(prediction)', 0.99)} AS p99 FROM scored GROUP BY source""")
def prediction_lengths(spark, sf_dir):
    rows = _predictions(spark, sf_dir).withColumn("n", F.length("prediction"))
    return stats.order_statistic(rows, "n", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, ["source"])


@query("completeness_reasons", _with() + " SELECT completeness AS reason, count(*) AS n FROM scored GROUP BY 1")
def completeness_reasons(spark, sf_dir):
    return stats.counts(_predictions(spark, sf_dir).withColumn("reason", S.completeness()), "reason")


@query("truncation_by_gold_length", _with() + """
  SELECT CASE WHEN length(reasoning) < 100 THEN '<100' WHEN length(reasoning) < 300 THEN '100-300' WHEN length(reasoning) < 600 THEN '300-600' ELSE '>600' END AS bucket,
    count(*) AS n, round(avg(CASE WHEN completeness <> 'complete' THEN 1.0 ELSE 0.0 END), 6) AS truncation_rate FROM scored GROUP BY 1""")
def truncation_by_gold_length(spark, sf_dir):
    rows = _predictions(spark, sf_dir).withColumn("bucket", stats.bucket(F.length("reasoning"), (0, 100, 300, 600, 10**9), ["<100", "100-300", "300-600", ">600"]))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), stats.share(S.completeness() != "complete").alias("truncation_rate"))


@query("answer_forms", _with(one=False) + f"""
  SELECT seq, model, a AS tagged, fb AS fallback, {d.norm("coalesce(a, '')")} AS n_full, {d.norm("coalesce(a, '')", 'reward')} AS n_reward, {d.norm("coalesce(a, '')", 'badcase')} AS n_badcase,
    {d.num('np')} AS number, same FROM scored""")
def answer_forms(spark, sf_dir):
    a = X.tag("prediction", "answer")
    e = F.coalesce(a, F.lit(""))
    rows = _predictions(spark, sf_dir, None)
    return rows.select("seq", "model", a.alias("tagged"), X.answer_or_last_line("prediction").alias("fallback"), normalize_answer(e).alias("n_full"), normalize_answer(e, "reward").alias("n_reward"), normalize_answer(e, "badcase").alias("n_badcase"), extract_number(normalize_answer(e)).alias("number"), check_correct(a, "answer").alias("same"))


SENTENCES = rf"len(list_filter(regexp_split_to_array(think, '[。！\.!\n]+'), lambda s: {d.strip('s')} <> ''))"
ERRORS = rf"""CASE WHEN fb_ok THEN '正确' WHEN NOT regexp_matches(prediction, '(?s)<think>(.*?)</think>') THEN '格式错误' WHEN {SENTENCES} < 3 THEN '跳步' WHEN regexp_matches(nf, '\d') THEN '计算错误' ELSE '语义误解' END"""


@query("eval_rows", _with(one=False) + rf"""
  SELECT seq, model, fb AS pred_answer, fb_ok AS is_correct, regexp_matches(prediction, '(?s)<think>(.*?)</think>') AS has_think,
    CASE WHEN regexp_matches(prediction, '(?s)<think>(.*?)</think>') THEN {SENTENCES} ELSE 0 END AS reasoning_steps, {ERRORS} AS error_type FROM scored""")
def eval_rows(spark, sf_dir):
    rows = _predictions(spark, sf_dir, None)
    fb = X.answer_or_last_line("prediction")
    think = F.col("prediction").rlike("(?s)<think>(.*?)</think>")
    return rows.select("seq", "model", fb.alias("pred_answer"), check_correct(fb, "answer").alias("is_correct"), think.alias("has_think"), F.when(think, X.sentence_count("prediction")).otherwise(0).alias("reasoning_steps"), S.error_class().alias("error_type"))


@query("error_taxonomy", _with() + f", t AS (SELECT {ERRORS} AS error_type FROM scored) SELECT error_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 6) AS share FROM t GROUP BY 1")
def error_taxonomy(spark, sf_dir):
    rows = _predictions(spark, sf_dir).withColumn("error_type", S.error_class())
    total = rows.agg(F.count("*").alias("total"))
    return stats.counts(rows, "error_type").crossJoin(F.broadcast(total)).select("error_type", "n", (F.col("n") / F.col("total")).alias("share"))


@query("eval_report", _with() + f"""
  SELECT count(*) AS n, round(avg(CASE WHEN fb_ok THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
    round(avg(CASE WHEN regexp_matches(prediction, '(?s)<think>(.*?)</think>') THEN {SENTENCES} ELSE 0 END), 6) AS avg_steps,
    round(avg(CASE WHEN NOT regexp_matches(prediction, '(?s)<think>(.*?)</think>') OR {SENTENCES} < 3 THEN 1.0 ELSE 0.0 END), 6) AS skip_rate FROM scored""")
def eval_report(spark, sf_dir):
    rows = _predictions(spark, sf_dir)
    think = F.col("prediction").rlike("(?s)<think>(.*?)</think>")
    steps = F.when(think, X.sentence_count("prediction")).otherwise(0)
    right = check_correct(X.answer_or_last_line("prediction"), "answer")
    return rows.agg(F.count("*").alias("n"), stats.share(right).alias("accuracy"), F.avg(steps).alias("avg_steps"), stats.share(steps < 3).alias("skip_rate"))


def _compared(spark, sf_dir):
    rows = _predictions(spark, sf_dir, None)
    p = F.col("prediction")
    return rows.select("seq", "model", S.comparison_class().alias("kind"), check_correct(X.tag(p, "answer"), "answer").alias("right"), (p.contains("</think>") & p.contains("</answer>")).alias("complete"), F.length(X.think_text(p)).alias("think_len"))


COMPARED = _with(one=False) + """, c AS (SELECT seq, model, same AS right_, contains(prediction, '</think>') AND contains(prediction, '</answer>') AS complete, length(think) AS think_len,
    CASE WHEN same THEN 'correct' WHEN NOT contains(prediction, '</think>') AND NOT contains(prediction, '</answer>') THEN 'truncated' WHEN NOT contains(prediction, '</answer>') THEN 'no_answer' ELSE 'wrong' END AS kind FROM scored),
  report AS (SELECT model, count(*) AS total, avg(CASE WHEN kind = 'correct' THEN 1.0 ELSE 0 END) AS accuracy, avg(CASE WHEN complete THEN 1.0 ELSE 0 END) AS completeness,
    avg(CASE WHEN kind = 'truncated' THEN 1.0 ELSE 0 END) AS truncated_rate, avg(CASE WHEN kind = 'wrong' THEN 1.0 ELSE 0 END) AS wrong_rate, avg(CASE WHEN kind = 'no_answer' THEN 1.0 ELSE 0 END) AS no_answer_rate,
    coalesce(avg(think_len) FILTER (WHERE think_len > 0), 0) AS avg_think_len,
    coalesce((list_sort(list(think_len) FILTER (WHERE think_len > 0)))[CAST(floor((count(*) FILTER (WHERE think_len > 0)) * 0.5) AS BIGINT) + 1], 0) AS median_think_len FROM c GROUP BY model)"""


@query("compare_models", COMPARED + """
  SELECT model, total, round(accuracy, 6) AS accuracy, round(completeness, 6) AS completeness, round(truncated_rate, 6) AS truncated_rate, round(wrong_rate, 6) AS wrong_rate,
    round(no_answer_rate, 6) AS no_answer_rate, round(avg_think_len, 6) AS avg_think_len, median_think_len FROM report""")
def compare_models(spark, sf_dir):
    return stats.model_report(_compared(spark, sf_dir))


@query("model_delta", COMPARED + """
  SELECT r.model, round(r.accuracy - b.accuracy, 6) AS accuracy_delta, round(r.completeness - b.completeness, 6) AS completeness_delta, round(r.truncated_rate - b.truncated_rate, 6) AS truncated_rate_delta
  FROM report r, report b WHERE b.model = 'm0' AND r.model <> 'm0'""")
def model_delta(spark, sf_dir):
    return stats.deltas(stats.model_report(_compared(spark, sf_dir)), "m0", ["accuracy", "completeness", "truncated_rate"])


@query("paired_flips", COMPARED + """, f AS (SELECT count(*) FILTER (WHERE NOT a.right_ AND b.right_) AS fixed, count(*) FILTER (WHERE a.right_ AND NOT b.right_) AS broken,
    count(*) FILTER (WHERE a.right_ AND b.right_) AS both_right, count(*) FILTER (WHERE NOT a.right_ AND NOT b.right_) AS both_wrong FROM c a JOIN c b ON a.seq = b.seq WHERE a.model = 'm0' AND b.model = 'm1')
  SELECT *, round(least(1.0, 2 * (SELECT sum(exp(lgamma(fixed + broken + 1) - lgamma(i + 1) - lgamma(fixed + broken - i + 1) - (fixed + broken) * ln(2.0))) FROM range(0, least(fixed, broken) + 1) t(i))), 6) AS p_value FROM f""")
def paired_flips(spark, sf_dir):
    rows = _compared(spark, sf_dir)
    return stats.paired_flips(rows.filter("model = 'm0'"), rows.filter("model = 'm1'"), "seq", "right")


BAD = """CASE WHEN NOT contains(prediction, '</think>') OR a IS NULL THEN 'truncated' WHEN same THEN 'correct' WHEN regexp_matches(np, '\\d') THEN 'calc' ELSE 'semantic' END"""


@query("badcase_classes", _with(form="badcase") + f" SELECT {BAD} AS kind, count(*) AS n FROM scored GROUP BY 1")
def badcase_classes(spark, sf_dir):
    return stats.counts(_predictions(spark, sf_dir).withColumn("kind", S.badcase_class()), "kind")


@query("badcase_samples", _with(form="badcase") + f", t AS (SELECT seq, {BAD} AS kind FROM scored) SELECT kind, seq FROM t QUALIFY row_number() OVER (PARTITION BY kind ORDER BY seq) <= 3")
def badcase_samples(spark, sf_dir):
    return sel.first_by(_predictions(spark, sf_dir).select("seq", S.badcase_class().alias("kind")), ["kind"], ["seq"], 3)


MINING = """CASE WHEN completeness <> 'complete' THEN 'truncated' WHEN ok THEN 'correct_complete' ELSE 'wrong_complete' END"""
LENGTH = "CASE WHEN t <= 4096 THEN '2049-4096' WHEN t <= 8192 THEN '4097-8192' ELSE '>8192' END"


@query("mining_report_grouping_sets", _with() + f""", t AS (SELECT source, 2000 + (k * 37) % 9000 AS t, {MINING} AS kind FROM scored), u AS (SELECT source, {LENGTH} AS length, kind FROM t)
  SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, CASE WHEN grouping(length) = 1 THEN 'all' ELSE length END AS length, count(*) AS n,
    count(*) FILTER (WHERE kind = 'truncated') AS truncated, count(*) FILTER (WHERE kind = 'wrong_complete') AS wrong_complete, count(*) FILTER (WHERE kind = 'correct_complete') AS correct_complete
  FROM u GROUP BY GROUPING SETS ((), (source), (length), (source, length))""")
def mining_report(spark, sf_dir):
    rows = _predictions(spark, sf_dir).select("source", S.length_bucket(2000 + (F.col("k") * 37) % 9000).alias("length"), S.mining_class().alias("kind"))
    return stats.grouping_report(rows, "source", "length", "kind", ["truncated", "wrong_complete", "correct_complete"])


def _reward(spark, sf_dir, f, **weights):
    rows = _predictions(spark, sf_dir, None)
    return rows.select("seq", "model", f(**weights).alias("r")).select("seq", "model", "r.*")


V1 = _with(form="reward", one=False) + """, r AS (SELECT seq, model, CASE WHEN ok THEN 1.0 ELSE 0.0 END AS accuracy,
    CASE WHEN NOT contains(prediction, '</think>') THEN 0.0 WHEN contains(prediction, '</answer>') THEN 1.0 ELSE 0.5 END AS completeness, length(think) AS think_len FROM scored),
  e AS (SELECT *, CASE WHEN think_len = 0 THEN 0.0 WHEN accuracy = 0 THEN 0.5 WHEN think_len < 200 THEN 0.5 WHEN think_len < 1500 THEN 1.0 WHEN think_len < 2500 THEN 0.7 ELSE 0.3 END AS efficiency FROM r)"""


@query("reward_v1", V1 + " SELECT seq, model, round(CAST(0.7 * accuracy + 0.2 * completeness + 0.1 * efficiency AS DOUBLE), 6) AS total, accuracy::DOUBLE AS accuracy, completeness::DOUBLE AS completeness, efficiency::DOUBLE AS efficiency, think_len FROM e")
def reward_v1(spark, sf_dir):
    return _reward(spark, sf_dir, S.reward_v1)


@query("reward_v2", _with(form="reward", one=False) + """, r AS (SELECT seq, model, NOT contains(prediction, '</answer>') AS cut, contains(prediction, '</think>') AS thinks, ok, length(think) AS n FROM scored),
  e AS (SELECT *, CASE WHEN ok AND NOT cut THEN 1.0 ELSE 0.0 END AS accuracy, CASE WHEN cut THEN CASE WHEN thinks THEN 0.3 ELSE 0.0 END WHEN thinks THEN 1.0 ELSE 0.0 END AS completeness,
    CASE WHEN cut OR n = 0 THEN 0.0 WHEN n < 200 THEN 0.3 WHEN n < 800 THEN 1.0 WHEN n < 1500 THEN 0.65 WHEN n < 2500 THEN 0.3 ELSE 0.05 END AS efficiency,
    CASE WHEN ok AND NOT cut AND n > 0 THEN CASE WHEN n < 500 THEN 0.15 WHEN n < 1000 THEN 0.08 ELSE 0.0 END ELSE 0.0 END AS bonus FROM r)
  SELECT seq, model, round(CAST(CASE WHEN cut THEN 0.0 ELSE least(1.0, greatest(0.0, 0.6 * accuracy + 0.15 * completeness + 0.25 * efficiency + bonus)) END AS DOUBLE), 6) AS total,
    accuracy::DOUBLE AS accuracy, completeness::DOUBLE AS completeness, efficiency::DOUBLE AS efficiency, bonus::DOUBLE AS bonus, n AS think_len, cut AS is_truncated FROM e""")
def reward_v2(spark, sf_dir):
    return _reward(spark, sf_dir, S.reward_v2)


#: Weights of the three arms.
ARMS = {"no_comp": (0.9, 0.0, 0.1), "no_eff": (0.8, 0.2, 0.0), "high_comp": (0.5, 0.4, 0.1)}


@query("reward_ablation", V1 + """, w(arm, a, c, f) AS (VALUES ('no_comp', 0.9, 0.0, 0.1), ('no_eff', 0.8, 0.2, 0.0), ('high_comp', 0.5, 0.4, 0.1))
  SELECT arm, model, count(*) AS n, round(sum(CAST(a * accuracy + c * completeness + f * efficiency AS DOUBLE)), 4) AS reward_sum FROM e, w GROUP BY arm, model""")
def reward_ablation(spark, sf_dir):
    rows = _predictions(spark, sf_dir, None)
    arms = F.array(*(F.struct(F.lit(n).alias("arm"), S.reward_v1(accuracy=a, completeness=c, efficiency=e)["total"].alias("total")) for n, (a, c, e) in ARMS.items()))
    return rows.select("model", F.inline(arms)).groupBy("arm", "model").agg(F.count("*").alias("n"), F.round(F.sum("total"), 4).alias("reward_sum"))


ROLLED = f"WITH {ctes('rollouts')}, {d.scored('rollouts', 'reward')}, w AS (SELECT *, CASE WHEN ok THEN 1.0 ELSE 0.0 END AS reward FROM scored), g AS (SELECT *, (reward - avg(reward) OVER q) / (stddev_samp(reward) OVER q + 1e-8) AS advantage FROM w WINDOW q AS (PARTITION BY prompt_id))"


def _advantages(spark, sf_dir):
    rows = view(spark, sf_dir, "rollouts").withColumn("reward", F.when(S.tagged_correct(form="reward"), 1.0).otherwise(0.0))
    return sel.advantages(rows, "prompt_id", "reward")


@query("group_advantage", ROLLED + " SELECT prompt_id, replica::BIGINT AS replica, reward::DOUBLE AS reward, round(advantage, 6) AS advantage FROM g")
def group_advantage(spark, sf_dir):
    return _advantages(spark, sf_dir).select("prompt_id", "replica", "reward", "advantage")


@query("ppo_objective", ROLLED + """ SELECT prompt_id, replica::BIGINT AS replica, round(-least(exp(logp_new::DOUBLE - logp_old::DOUBLE) * advantage, greatest(0.8, least(1.2, exp(logp_new::DOUBLE - logp_old::DOUBLE))) * advantage) + 0.04 * (logp_ref::DOUBLE - logp_new::DOUBLE), 6) AS loss FROM g""")
def ppo_objective(spark, sf_dir):
    lp = [F.col(f"logp_{n}").cast("double") for n in ("new", "old", "ref")]
    return _advantages(spark, sf_dir).select("prompt_id", "replica", S.ppo_loss(*lp, F.col("advantage")).alias("loss"))


@query("reward_means", ROLLED + " SELECT prompt_id // 8000 AS step, round(avg(reward)::DOUBLE, 6) AS mean_reward, count(*) AS n FROM g GROUP BY 1")
def reward_means(spark, sf_dir):
    """Mean reward of each step; a step takes the prompts of eight conversations."""
    return _advantages(spark, sf_dir).groupBy(F.expr("prompt_id div 8000").alias("step")).agg(F.avg("reward").alias("mean_reward"), F.count("*").alias("n"))


GENERATED = "CASE WHEN contains(prediction, '<think>') THEN substr(prediction, instr(prediction, '<think>')) ELSE prediction END"


@query("long_probe", f"""WITH {ctes('predictions', 'intermediates')}, {ONE}, {d.scored('p', 'full')}, b AS (SELECT source, instruction, reasoning, seq, unnest({d.full_boxes('answer')}) AS box, generate_subscripts({d.full_boxes('answer')}, 1) AS i FROM intermediates),
  g AS (SELECT source, instruction, reasoning, list_last(list(box ORDER BY seq, i)) AS reliable_answer FROM b GROUP BY 1, 2, 3)
  SELECT s.seq, s.source, length(s.reasoning) AS gold_reasoning_chars, len({d.toks(GENERATED)}) AS generated_tokens, s.completeness AS reason, g.reliable_answer FROM scored s JOIN g USING (source, instruction, reasoning)
  WHERE length(s.reasoning) >= 200 AND s.completeness <> 'complete' AND len({d.toks(GENERATED)}) >= 40""")
def long_probe(spark, sf_dir):
    """With limits that these short texts reach."""
    rows = joins.gather_last_box(_predictions(spark, sf_dir), view(spark, sf_dir, "intermediates"), ["source", "instruction", "reasoning"])
    rows = gates.long_probe(rows.withColumn("reason", S.completeness()), K.token_length, F.col("reason") != "complete", 200, 40)
    return rows.select("seq", "source", "gold_reasoning_chars", "generated_tokens", "reason", "reliable_answer")
