"""Views of the tables in the shapes the operators work on. One text serves Spark and DuckDB, so it uses what both share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "conversations", "benchmark", "events", "labels")

#: seq orders records as (conv_id, turn) does; k varies over them.
VIEWS = {
    "sft_records": """
  SELECT conv_id * 1000 + turn AS seq, conv_id * 7 + turn AS k, text AS instruction, ntext AS reasoning,
    'src' || CAST(conv_id % 5 AS STRING) AS source,
    CASE WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE CAST((conv_id * 7 + turn) % 50 AS STRING) END AS answer
  FROM (SELECT conv_id, turn, role, text,
      lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ntext
    FROM {conversations}) AS t
  WHERE role = 'user' AND nrole = 'assistant'""",
    "boxed": """
  SELECT seq, k, source, instruction, reasoning, answer AS plain,
    CASE k % 6 WHEN 0 THEN 'so ' || chr(92) || 'boxed{' || answer || '}'
      WHEN 1 THEN chr(92) || 'boxed{' || chr(92) || 'frac{' || answer || '}{2}} done'
      WHEN 2 THEN chr(92) || 'boxed{1} then ' || chr(92) || 'boxed{ ' || answer || ' }'
      WHEN 3 THEN chr(92) || 'boxed{' || chr(92) || 'frac{1}{2}'
      WHEN 4 THEN 'The answer is ' || answer
      ELSE chr(92) || 'boxed{}' END AS answer
  FROM sft_records""",
    "intermediates": """
  SELECT seq, source, instruction, reasoning, answer FROM boxed WHERE k % 13 <> 0
  UNION ALL SELECT seq + 1000000, source, instruction, reasoning, answer FROM boxed WHERE k % 4 = 0""",
    "variants": """
  SELECT r.seq, r.k, r.source, r.instruction, r.reasoning, r.answer, m.m, (r.k + m.m) % 10 AS v
  FROM sft_records AS r CROSS JOIN (SELECT 0 AS m UNION ALL SELECT 1 AS m UNION ALL SELECT 2 AS m) AS m WHERE r.answer <> ''""",
    "predictions": """
  SELECT seq, k, source, instruction, reasoning, answer, 'm' || CAST(m AS STRING) AS model,
    CASE v WHEN 0 THEN '<think>' || chr(10) || substring(reasoning, 1, CAST((length(reasoning) - length(reasoning) % 2) / 2 AS INT))
      WHEN 1 THEN '<think>' || chr(10) || reasoning || chr(10) || '</think>' || chr(10) || answer
      WHEN 2 THEN '<think>' || chr(10) || reasoning || chr(10) || '</think>' || chr(10) || '<answer> ' || answer
      WHEN 3 THEN '<think>' || chr(10) || reasoning || chr(10) || '</think>' || chr(10) || '<answer>  </answer>'
      ELSE '<think>' || chr(10) || reasoning || chr(10) || '</think>' || chr(10) || '<answer> ' ||
        CASE v WHEN 4 THEN CAST(CAST(answer AS INT) + 1 AS STRING) WHEN 5 THEN 'no idea' WHEN 6 THEN answer || '.00'
          WHEN 7 THEN chr(92) || 'text{' || answer || '}' ELSE answer END || ' </answer>' END AS prediction
  FROM variants""",
    "rollouts": """
  SELECT p.seq AS prompt_id, r.r AS replica, p.answer, p.prediction,
    -0.5 - ((p.seq + r.r) % 7) / 8.0 AS logp_old, -0.5 - ((p.seq + 3 * r.r) % 5) / 8.0 AS logp_new, -0.5 - ((p.seq + 2 * r.r) % 3) / 8.0 AS logp_ref
  FROM (SELECT seq, answer, model, prediction FROM predictions) AS p
  JOIN (SELECT 0 AS r, 'm0' AS model UNION ALL SELECT 1 AS r, 'm1' AS model UNION ALL SELECT 2 AS r, 'm2' AS model) AS r ON p.model = r.model""",
    "firefly": """
  SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN 'Cot' ELSE source END AS kind, text AS input,
    text || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '答案是： ' || CAST(doc_id % 97 AS STRING) || '。' || chr(10) || 'end' ELSE '' END ||
      CASE WHEN doc_id % 6 = 0 THEN ' 3 + 4' ELSE '' END AS target, source
  FROM {documents}""",
    "step_texts": """
  SELECT seq, k, source, instruction, answer, replace(reasoning, '. ', '.' || chr(10) || chr(10)) AS reasoning FROM sft_records WHERE answer <> ''""",
    "synthesis": """
  SELECT seq, k, source, instruction, reasoning || CASE WHEN k % 9 = 0 THEN ' ' || chr(92) || 'boxed{' || CAST(k % 2 AS STRING) || '}' ELSE '' END AS reasoning,
    answer, substring(sha256(source || chr(10) || instruction), 1, 20) AS candidate_id,
    CASE WHEN k % 7 IN (0, 1, 2, 3) THEN 'accepted' WHEN k % 7 = 4 THEN 'rejected' WHEN k % 7 = 5 THEN 'transient' ELSE 'none' END AS state,
    CASE k % 3 WHEN 0 THEN 'teacher_rejected:bad' WHEN 1 THEN 'api_or_parse_error: x' ELSE 'too_short:12' END AS reject_reason,
    k % 5 <> 0 AS valid, k % 5 <> 1 AS supports_answer, k % 5 = 2 AS missing_key_step,
    1 + k % 3 AS calls, 2000 + (k * 37) % 9000 AS sft_token_length
  FROM sft_records""",
    "claims": """
  SELECT seq, source, instruction, reasoning, answer, valid, supports_answer, missing_key_step FROM synthesis WHERE state = 'accepted'
  UNION ALL SELECT seq + 1000000, source, upper(instruction) || ' !', reasoning, answer, valid, supports_answer, missing_key_step FROM synthesis WHERE state = 'accepted' AND k % 4 = 0""",
}
NEEDS = {"boxed": ["sft_records"], "intermediates": ["boxed"], "variants": ["sft_records"], "predictions": ["variants"], "rollouts": ["predictions"], "step_texts": ["sft_records"], "synthesis": ["sft_records"], "claims": ["synthesis"]}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in [*_closure(NEEDS.get(n, [])), n]:
            if m not in out:
                out.append(m)
    return out


def ctes(*names: str) -> str:
    """The WITH clause's members for DuckDB, without WITH."""
    text = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _closure(list(names)))
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


#: DuckDB's upper maps characters one to one. Spark's makes several of some, as SS of ß; those stay here, but for the ones
#: that have a capital of their own.
CAPITALS = {"ß": "ẞ"} | {c: c.title() for i in range(0x110000) if len((c := chr(i)).upper()) > 1 and len(c.title()) == 1 and c.title() != c}
UPPER = f"""CASE WHEN length(upper(instruction)) = length(instruction) THEN upper(instruction) ELSE
    array_join(transform(split(instruction, ''), c -> CASE WHEN length(upper(c)) = 1 THEN upper(c) ELSE translate(c, '{"".join(CAPITALS)}', '{"".join(CAPITALS.values())}') END), '') END"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    text = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _closure([name])).replace("sha256(source || chr(10) || instruction)", "sha2(source || chr(10) || instruction, 256)")
    text = text.replace("upper(instruction)", UPPER)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(_doubled(text, name), **used)


def _doubled(text: str, name: str) -> str:
    """Braces that aren't a table's are literal."""
    for t in TABLES:
        text = text.replace("{" + t + "}", f"\0{t}\1")
    return f"WITH {text.replace('{', '{{').replace('}', '}}').replace(chr(0), '{').replace(chr(1), '}')} SELECT * FROM {name}"
