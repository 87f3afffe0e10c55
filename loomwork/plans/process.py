"""Queries on reasoning steps and process scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import scoring as S
from loomwork.functions import text as X
from loomwork.functions.answers import check_correct
from loomwork.operators import stats
from loomwork.plans import dialect as d
from loomwork.plans.fixtures import ctes, view
from loomwork.plans.registry import query

REAL = lambda a: f"list_filter(list_transform({a}, lambda s: {d.strip('s')}), lambda s: s <> '')"
RAW = d.strip("reasoning")
PARAGRAPHS = REAL(rf"regexp_split_to_array({RAW}, '\n\s*\n')")
LINES = REAL(f"string_split({RAW}, chr(10))")
SENTENCES = f"list_transform(list_filter(string_split({RAW}, '。'), lambda s: {d.strip('s')} <> ''), lambda s: {d.strip('s')} || '.')"
STEPS = f"WITH {ctes('step_texts')}, s AS (SELECT seq, k, source, instruction, answer, CASE WHEN {RAW} = '' THEN [] WHEN len({PARAGRAPHS}) > 1 THEN {PARAGRAPHS} WHEN len({LINES}) > 1 OR length({RAW}) <= 200 THEN {LINES} ELSE {SENTENCES} END AS steps FROM step_texts)"
SCORE = "CAST((seq * 17 + {i} * 13 + length({t}) * 7) % 101 AS DOUBLE) / 100.0"
SCORED = STEPS + f""", e AS (SELECT seq, k, source, instruction, answer, i - 1 AS step_idx, steps[i] AS step_text, {SCORE.format(i='(i - 1)', t='steps[i]')} AS score, CAST((seq * 5 + (i - 1) * 11) % 5 AS DOUBLE) / 4.0 AS mc FROM s, unnest(range(1, len(steps) + 1)) AS t(i))"""
RIGHT = "k % 3 <> 0"


def _steps(spark, sf_dir):
    return view(spark, sf_dir, "step_texts").withColumn("steps", X.split_steps("reasoning"))


def _scored(spark, sf_dir):
    """A row for each sample with arrays of step scores."""
    i = lambda j: j.cast("long")
    score = lambda t, j: ((F.col("seq") * 17 + i(j) * 13 + F.length(t) * 7) % 101).cast("double") / 100.0
    mc = lambda t, j: ((F.col("seq") * 5 + i(j) * 11) % 5).cast("double") / 4.0
    return _steps(spark, sf_dir).withColumns({"scores": F.transform("steps", score), "mc": F.transform("steps", mc), "right": F.col("k") % 3 != 0})


def _exploded(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    z = F.arrays_zip(F.col("steps").alias("step_text"), F.col("scores").alias("score"), F.col("mc").alias("mc_score"))
    return rows.select("seq", "k", "source", "instruction", "right", F.posexplode(z).alias("step_idx", "z")).select("seq", "k", "source", "instruction", "right", "step_idx", "z.*")


@query("split_steps", STEPS + " SELECT seq, steps FROM s")
def split_steps(spark, sf_dir):
    return _steps(spark, sf_dir).select("seq", "steps")


@query("extract_steps", f"WITH {ctes('step_texts')} SELECT seq, CASE WHEN {RAW} = '' THEN [] WHEN len({PARAGRAPHS}) > 1 THEN {PARAGRAPHS} ELSE {LINES} END AS steps FROM step_texts")
def extract_steps(spark, sf_dir):
    return view(spark, sf_dir, "step_texts").select("seq", X.split_steps("reasoning", by_sentence=False).alias("steps"))


@query("explode_steps", SCORED + " SELECT seq, step_idx, step_text, round(score, 6) AS score FROM e")
def explode_steps(spark, sf_dir):
    return _exploded(spark, sf_dir).select("seq", "step_idx", "step_text", "score")


@query("prefix_context", STEPS + """ SELECT seq, i - 1 AS step_idx, array_to_string(list_transform(range(1, i), lambda j: '步骤' || j::VARCHAR || ': ' || steps[j]), chr(10)) AS context FROM s, unnest(range(1, len(steps) + 1)) AS t(i)""")
def prefix_context(spark, sf_dir):
    rows = _steps(spark, sf_dir).select("seq", "steps", F.posexplode("steps").alias("step_idx", "step"))
    return rows.select("seq", "step_idx", X.prefix_context(F.col("steps"), F.col("step_idx")).alias("context"))


@query("step_prompts", SCORED + """ SELECT seq, step_idx, '<|im_start|>user' || chr(10) || '评估以下数学推理步骤的质量。' || chr(10) || chr(10) || '问题: ' || instruction || chr(10) || '步骤: ' || step_text || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM e""")
def step_prompts(spark, sf_dir):
    return _exploded(spark, sf_dir).select("seq", "step_idx", X.step_prompt("instruction", "step_text").alias("prompt"))


@query("annotation_eligible", STEPS + " SELECT seq, len(steps) AS n_steps FROM s WHERE len(steps) >= 2")
def annotation_eligible(spark, sf_dir):
    return _steps(spark, sf_dir).filter(F.size("steps") >= 2).select("seq", F.size("steps").alias("n_steps"))


SAMPLES = SCORED + f""", a AS (SELECT seq, k, count(*) AS n_steps, avg(score) AS score_avg, stddev_pop(score) AS score_std, min(score) AS score_min, avg(mc) AS mc_avg, ({RIGHT}) AS ok FROM e GROUP BY seq, k)"""


def _samples(spark, sf_dir):
    rows = _scored(spark, sf_dir).filter(F.size("steps") > 0)
    return rows.select("seq", "k", F.size("steps").alias("n_steps"), S.array_mean(F.col("scores")).alias("score_avg"), S.array_std(F.col("scores")).alias("score_std"), F.array_min("scores").alias("score_min"), S.array_mean(F.col("mc")).alias("mc_avg"), F.col("right").alias("ok"))


@query("step_score_stats", SAMPLES + " SELECT seq, n_steps, round(score_avg, 6) AS score_avg, round(score_std, 6) AS score_std, round(score_min, 6) AS score_min FROM a")
def step_score_stats(spark, sf_dir):
    return _samples(spark, sf_dir).select("seq", "n_steps", "score_avg", "score_std", "score_min")


@query("annotation_summary", SAMPLES + " SELECT (SELECT min(score) FROM e) AS step_min, (SELECT max(score) FROM e) AS step_max, round((SELECT avg(score) FROM e), 6) AS step_mean, round(min(score_avg), 6) AS sample_min, round(max(score_avg), 6) AS sample_max FROM a")
def annotation_summary(spark, sf_dir):
    steps = _exploded(spark, sf_dir).agg(F.min("score").alias("step_min"), F.max("score").alias("step_max"), F.avg("score").alias("step_mean"))
    samples = _samples(spark, sf_dir).agg(F.min("score_avg").alias("sample_min"), F.max("score_avg").alias("sample_max"))
    return steps.crossJoin(F.broadcast(samples))


@query("process_reward", SAMPLES + """, c AS (SELECT *, CASE WHEN ok THEN 1.0 ELSE 0.0 END AS acc, CASE WHEN n_steps <= 3 THEN 0.3 WHEN n_steps <= 8 THEN 1.0 - 0.5 * (n_steps - 3) / 5 ELSE 0.5 END AS eff FROM a)
  SELECT seq, round(CAST(0.7 * score_avg + 0.2 * acc + 0.1 * eff AS DOUBLE) + 1e-9, 6) AS total, acc::DOUBLE AS accuracy, CASE WHEN k % 4 <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS completeness, round(eff::DOUBLE, 6) AS efficiency, round(score_avg, 6) AS prm_score FROM c""")
def process_reward(spark, sf_dir):
    rows = _scored(spark, sf_dir).filter(F.size("steps") > 0)
    return rows.select("seq", S.process_reward(F.col("scores"), F.when(F.col("right"), 1.0).otherwise(0.0), F.col("k") % 4 != 0).alias("r")).select("seq", (F.col("r.total") + 1e-9).alias("total"), *(f"r.{c}" for c in ("accuracy", "completeness", "efficiency", "prm_score")))


@query("scorer_agreement", SAMPLES + " SELECT count(*) AS n, round(avg(score_avg), 6) AS score_avg_mean, round(stddev_pop(score_avg), 6) AS score_avg_std, round(avg(mc_avg), 6) AS mc_avg_mean, round(stddev_pop(mc_avg), 6) AS mc_avg_std, round(avg(score_avg - mc_avg), 6) AS mean_delta, round(corr(score_avg, mc_avg), 6) AS correlation FROM a")
def scorer_agreement(spark, sf_dir):
    return stats.agreement(_samples(spark, sf_dir), "score_avg", "mc_avg")


@query("agreement_extremes", SAMPLES + """, x AS (SELECT seq, score_avg - mc_avg AS delta FROM a) (SELECT 'low' AS side, seq, round(delta, 6) AS delta FROM x ORDER BY round(delta, 9), seq LIMIT 3) UNION ALL (SELECT 'high', seq, round(delta, 6) FROM x ORDER BY round(delta, 9) DESC, seq LIMIT 3)""")
def agreement_extremes(spark, sf_dir):
    rows = _samples(spark, sf_dir).select("seq", (F.col("score_avg") - F.col("mc_avg")).alias("delta"))
    at = F.round("delta", 9)
    low, high = rows.orderBy(at, "seq").limit(3), rows.orderBy(at.desc(), "seq").limit(3)
    return low.withColumn("side", F.lit("low")).unionByName(high.withColumn("side", F.lit("high")))


TRIPLE = SCORED + f", t AS (SELECT score AS api, mc, CASE WHEN {RIGHT} THEN 1.0 ELSE 0.0 END::DOUBLE AS outcome FROM e)"


@query("scorer_correlation", TRIPLE + """ SELECT round(corr(api, mc), 6) AS corr_api_mc, round(corr(api, outcome), 6) AS corr_api_outcome, round(corr(mc, outcome), 6) AS corr_mc_outcome,
  round(avg(api), 6) AS api_mean, round(stddev_pop(api), 6) AS api_std, round(avg(mc), 6) AS mc_mean, round(stddev_pop(mc), 6) AS mc_std, round(avg(outcome), 6) AS outcome_mean, round(stddev_pop(outcome), 6) AS outcome_std FROM t""")
def scorer_correlation(spark, sf_dir):
    rows = _exploded(spark, sf_dir).select(F.col("score").alias("api"), F.col("mc_score").alias("mc"), F.col("right").cast("int").cast("double").alias("outcome"))
    return stats.correlation_matrix(rows, ["api", "mc", "outcome"])


@query("scores_by_correctness", SAMPLES + " SELECT ok, count(*) AS n, round(avg(score_avg), 6) AS api_mean, round(avg(mc_avg), 6) AS mc_mean FROM a GROUP BY ok")
def scores_by_correctness(spark, sf_dir):
    return _samples(spark, sf_dir).groupBy("ok").agg(F.count("*").alias("n"), F.avg("score_avg").alias("api_mean"), F.avg("mc_avg").alias("mc_mean"))


@query("mc_step_scores", SCORED + " SELECT seq, step_idx, round(avg(CASE WHEN (seq + step_idx * 3 + r) % 4 <> 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS mc_score FROM e, unnest(range(8)) AS t(r) GROUP BY seq, step_idx")
def mc_step_scores(spark, sf_dir):
    """Rollout outcomes of each step to the share of right ones."""
    rollouts = _exploded(spark, sf_dir).select("seq", "step_idx", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("r"))
    return rollouts.groupBy("seq", "step_idx").agg(stats.share((F.col("seq") + F.col("step_idx") * 3 + F.col("r")) % 4 != 0).alias("mc_score"))


@query("quadrants", SAMPLES + """, m AS (SELECT quantile_cont(score_avg, 0.5) AS threshold FROM a), q AS (SELECT any_value(threshold) AS threshold, count(*) FILTER (WHERE score_avg >= threshold AND ok) AS tp, count(*) FILTER (WHERE score_avg >= threshold AND NOT ok) AS fp,
    count(*) FILTER (WHERE score_avg < threshold AND NOT ok) AS tn, count(*) FILTER (WHERE score_avg < threshold AND ok) AS fn FROM a, m)
  SELECT round(threshold, 6) AS threshold, tp, fp, tn, fn, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 6) AS fnr, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM q""")
def quadrants(spark, sf_dir):
    return stats.quadrants(_samples(spark, sf_dir), "score_avg", "ok")


@query("quadrant_subtypes", SAMPLES + """, m AS (SELECT quantile_cont(score_avg, 0.5) AS t FROM a) SELECT count(*) FILTER (WHERE score_avg >= t AND NOT ok AND score_std > 0.2) AS fp_high_std, count(*) FILTER (WHERE score_avg >= t AND NOT ok AND score_std <= 0.2) AS fp_low_std,
    count(*) FILTER (WHERE score_avg < t AND ok AND n_steps <= 3) AS fn_short, count(*) FILTER (WHERE score_avg < t AND ok AND score_min < 0.5) AS fn_low_step FROM a, m""")
def quadrant_subtypes(spark, sf_dir):
    return stats.quadrant_subtypes(_samples(spark, sf_dir), "score_avg", "ok")


@query("calibration", SAMPLES + """ SELECT CASE WHEN score_avg < 0.3 THEN '[0.0,0.3)' WHEN score_avg < 0.5 THEN '[0.3,0.5)' WHEN score_avg < 0.7 THEN '[0.5,0.7)' WHEN score_avg < 0.85 THEN '[0.7,0.85)' ELSE '[0.85,1.0)' END AS bucket,
  count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy FROM a WHERE score_avg < 1.0 GROUP BY 1""")
def calibration(spark, sf_dir):
    return stats.calibration(_samples(spark, sf_dir), "score_avg", "ok")


@query("high_variance_topk", SAMPLES + " SELECT seq, round(score_std, 6) AS score_std FROM a ORDER BY round(score_std, 9) DESC, seq LIMIT 10")
def high_variance_topk(spark, sf_dir):
    return _samples(spark, sf_dir).orderBy(F.round("score_std", 9).desc(), "seq").limit(10).select("seq", "score_std")


@query("largest_differences", SCORED + " SELECT seq, step_idx, round(abs(score - mc), 6) AS difference FROM e ORDER BY round(abs(score - mc), 9) DESC, seq, step_idx LIMIT 5")
def largest_differences(spark, sf_dir):
    gap = F.abs(F.col("score") - F.col("mc_score"))
    return _exploded(spark, sf_dir).orderBy(F.round(gap, 9).desc(), "seq", "step_idx").limit(5).select("seq", "step_idx", gap.alias("difference"))


@query("regression_errors", SCORED + " SELECT round(avg((score - mc) ** 2), 6) AS mse, round(avg(abs(score - mc)), 6) AS mae, count(*) AS n FROM e")
def regression_errors(spark, sf_dir):
    gap = F.col("score") - F.col("mc_score")
    return _exploded(spark, sf_dir).agg(F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"), F.count("*").alias("n"))


@query("outcome_score", f"WITH {ctes('predictions')}, {d.scored('predictions', 'reward')} SELECT seq, model, CASE WHEN same THEN 1.0 ELSE 0.0 END::DOUBLE AS outcome FROM scored")
def outcome_score(spark, sf_dir):
    return view(spark, sf_dir, "predictions").select("seq", "model", check_correct(X.tag("prediction", "answer"), "answer", "reward").cast("int").cast("double").alias("outcome"))


@query("think_answer_pairs", f"WITH {ctes('predictions')} SELECT seq, model, {d.tag('prediction', 'think')} AS think, {d.tag('prediction', 'answer')} AS answer FROM predictions")
def think_answer_pairs(spark, sf_dir):
    return view(spark, sf_dir, "predictions").select("seq", "model", X.tag("prediction", "think").alias("think"), X.tag("prediction", "answer").alias("answer"))
