"""The operators of this subpackage over whole tables, one query each, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, with the checksum of their ids."""
    from loomwork.llm.packing import pack_documents

    packed = pack_documents(spark, documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    from loomwork.llm.simhash import near_groups

    groups = near_groups(spark, documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz score and base score of each document."""
    from loomwork.llm.katz import score_documents

    return score_documents(spark, documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best overlap of each document with each benchmark item that it holds a passage of."""
    from loomwork.llm.decontam import find_overlaps

    return find_overlaps(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and dropped, and the checksum of the text that stays."""
    from loomwork.llm.linededup import drop_repeated_lines

    kept = drop_repeated_lines(spark, documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place in it of each document; shards are near equal in bytes."""
    from loomwork.llm.sharding import shard_documents

    placed = shard_documents(spark, documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics, base verdict and the cascade's verdict of each document."""
    from loomwork.llm.quality import apply_rules

    out = apply_rules(documents(spark, sf_dir), stats=True)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated 400-byte strings of each document, and the checksum of what is left."""
    from loomwork.llm.suffix import drop_repeats

    out = drop_repeats(spark, documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "spans")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of each document, and those that no template confirms."""
    from loomwork.llm.licenses import UNKNOWN, scan_licenses

    out = scan_licenses(spark, documents(spark, sf_dir))
    sure = F.filter("found", lambda x: x["family"] != UNKNOWN)
    families = F.array_sort(F.array_distinct(sure["family"]))
    n_sure = F.size(sure).cast("long")
    return out.select("doc_id", "n_paragraphs", n_sure.alias("n_license_paragraphs"), (F.size("found") - n_sure).alias("n_unknown_paragraphs"), families.alias("families"), "found")


def op10_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of each document's ids, as read back from the files."""
    from loomwork.llm.simple8b import tokens_round_trip

    back = tokens_round_trip(spark, documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and checksums of each document's fill-in-middle text, and of the text restored from it."""
    from loomwork.llm.fim import PLAIN, fill_in_middle, restored

    out = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"), "char")
    chars = lambda c: F.when(F.col("fim_form") != PLAIN, F.length(c).cast("long"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), chars("fim_prefix").alias("prefix_chars"), chars("fim_middle").alias("middle_chars"), sha(F.col("fim_output")).alias("output_sha256"), sha(restored("fim_output", "fim_form")).alias("restored_sha256"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector."""
    from loomwork.llm.spherical import near_vectors

    return near_vectors(spark, embeddings(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of each vector, and the checksum of the codebooks."""
    from loomwork.llm.pq import compress_vectors

    return compress_vectors(spark, embeddings(spark, sf_dir)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
held AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
flagged AS (
  SELECT k.doc_id, k.pos, k.line, h.first_doc IS NOT NULL AND k.doc_id > h.first_doc AS gone
  FROM keyed k LEFT JOIN held h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: {'i': i, 'w': words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]})) AS x FROM d),
twice AS (
  SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.w) AS n FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) AS t(j) WHERE n > 1 GROUP BY doc_id),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
real AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (WHERE regexp_matches(line, '^[\x20\x09-\x0D]*[-*]')) AS bullets,
    count(*) FILTER (WHERE regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS open_ends FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
top AS (
  SELECT doc_id, max(n) AS n FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM d) WHERE regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]') GROUP BY doc_id, w) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(real.dup, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(real.n, 0) AS n_lines, coalesce(real.bullets, 0) AS bullets, coalesce(real.open_ends, 0) AS open_ends, coalesce(top.n, 0) AS top,
    length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) + length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN real USING (doc_id) LEFT JOIN top USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 5 * n_words
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_dup_lines > n_lines
    OR 100 * top > 30 * n_words OR 2 * letters < word_chars OR 10 * bullets > 9 * n_lines OR 10 * open_ends > 3 * n_lines) AS kept
FROM s
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, substr(t, 1, least(x, y)) AS pre, substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS mid, substr(t, greatest(x, y) + 1) AS suf FROM r)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN least(x, y)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (greatest(x, y) - least(x, y))::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

OP12_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (
  SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (
  SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least.c AS component_id, e.vec_id = least.c AS kept
FROM embeddings e JOIN least ON e.vec_id = least.a LEFT JOIN n ON e.vec_id = n.a
"""


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after the other: x holds whole components, c0 to c6 the codebooks, a0 to a6 the nearest entries."""
    steps = [rf"""WITH x AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS x, len(embedding) // {parts} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, unnest(range({parts})) AS part, unnest(list_transform(range({parts}), lambda i: x[i * w + 1:(i + 1) * w])) AS x FROM x),
c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < {entries})"""]
    for k in range(rounds + 1):
        steps.append(rf"""a{k} AS MATERIALIZED (
  SELECT vec_id, label, part, x, min({{'d': d, 'entry': entry}}) AS best FROM (
    SELECT p.*, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{k} USING (part))
  GROUP BY ALL)""")
        if k < rounds:
            steps.append(rf"""c{k + 1} AS MATERIALIZED (
  SELECT o.part, o.entry, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN (
    SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (
      SELECT part, entry, i, sum(y)::DOUBLE AS s, count(*) AS n FROM (SELECT part, best.entry AS entry, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY ALL)
    GROUP BY part, entry) n ON o.part = n.part AND o.entry = n.entry)""")
    steps.append(rf"""r AS MATERIALIZED (
  SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM r""")
    return ",\n".join(steps)


QUERIES: dict[str, Query] = {"op1_packing": op1_packing, "op2_simhash": op2_simhash, "op3_katz": op3_katz, "op4_decontamination": op4_decontamination, "op5_line_dedup": op5_line_dedup, "op6_sharding": op6_sharding, "op7_quality": op7_quality, "op8_suffix_dedup": op8_suffix_dedup, "op9_licenses": op9_licenses, "op10_simple8b": op10_simple8b, "op11_fill_in_middle": op11_fill_in_middle, "op12_embedding_dedup": op12_embedding_dedup, "op13_vector_codes": op13_vector_codes}
SQL: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op7_quality": OP7_SQL, "op11_fill_in_middle": OP11_SQL, "op12_embedding_dedup": OP12_SQL, "op13_vector_codes": _op13_sql()}
