"""The operators as registered queries over whole tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, line_dedup, near_dedup, packing, quality, secrets, sharding, toxicity, url_filter
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.size("matches") > 0).alias("contaminated"),
        F.sort_array(F.array_distinct("matches.item_id")).alias("item_ids"),
        F.round(F.array_max("matches.coverage"), 6).alias("coverage"),
        F.exists("matches", lambda m: m["reparameterised"]).alias("reparameterised"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word", "part", F.char_length("token").alias("n_chars"), F.crc32("token").alias("token_crc32"), "p_secret", "is_secret")


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.strip_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality_rules, op3_decontamination, op4_toxicity, op5_url_filters, op6_minhash_near_dedup, op7_secret_scan, op8_harmonic_packing, op9_line_dedup, op10_sharding)}

ORACLE_SQL = {
    "op6_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n_shingles + q.n_shingles - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)""",
    "op9_line_dedup": r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, source, line, i, regexp_matches(line, '[^\x20\x09-\x0D]') AS w FROM l),
b AS (SELECT line FROM f WHERE w GROUP BY line HAVING count(DISTINCT source) >= 8),
h AS (SELECT doc_id, f.line, i, w, w AND b.line IS NOT NULL AS wide FROM f LEFT JOIN b ON f.line = b.line),
d AS (
  SELECT doc_id, count(*) FILTER (w) AS n_lines, count(*) FILTER (wide) AS n_wide,
    string_agg(line, chr(10) ORDER BY i) FILTER (NOT wide) AS rest FROM h GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
  CAST(CASE WHEN n_wide BETWEEN 1 AND n_lines - 1 THEN n_wide ELSE 0 END AS BIGINT) AS n_removed,
  md5(CASE WHEN n_wide BETWEEN 1 AND n_lines - 1 THEN coalesce(rest, '') ELSE t.text END) AS text_md5
FROM documents t LEFT JOIN d USING (doc_id)""",
}
