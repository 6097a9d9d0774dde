"""The queries of this folder by name, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import fingerprint, html_extract, license_scan, mixing, near_dup, pieces, pu_quality, quality_rules, secret_scan, url_filter
from docloom.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", mixing.word_count("text").alias("size"), F.array("source").alias("sources"))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digest(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(documents(spark, sf_dir))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(documents(spark, sf_dir))


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", *quality_rules.MEASURES, "base_failed", "kept", "host_rejected", "failed", "host_verdict")
    return quality_rules.judge(documents(spark, sf_dir)).select(*columns)


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


RULES_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT r, unnest(list_transform(range(1, len(ws) - 1), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]))) AS g, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
o AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM o WHERE n > 1) GROUP BY r),
m AS (SELECT r, doc_id, source, len(ws) AS n_words, coalesce(CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT), 0) AS word_chars, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM w),
b AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM m LEFT JOIN c USING (r)),
d AS (SELECT *, base_failed OR 10 * n_symbols > n_words AS failed, n_words < 100 OR 200 * n_repeat_words > 50 * n_words OR 20 * n_symbols > n_words AS near FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (failed)::DOUBLE AS f FROM d GROUP BY 1),
u AS (SELECT sum(n) AS t, sum(f) / sum(n) AS m, sum(f * f / n) AS ff, sum(n * n) AS nn, count(*) AS k FROM h),
v AS (SELECT m, (ff - t * m * m - m * (1 - m) * (k - 1)) / nullif(m * (1 - m) * (t - nn / t - (k - 1)), 0) AS rho, m > 0 AND m < 1 AND t - nn / t - (k - 1) > 0 AS fits FROM u),
s AS (SELECT m, CASE WHEN fits THEN 1 / greatest(1e-6, least(0.5, rho)) - 1 ELSE 1.0 END AS s FROM v),
q AS (SELECT source, (f + m * s) / (n + s) AS rate, greatest(0.3, m + 2 * sqrt(m * (1 - m) / (s + 1))) AS far FROM h, s),
x AS (SELECT source, CASE WHEN rate >= 0.9 THEN 'rejected' WHEN rate >= far THEN 'suspect' END AS host_verdict FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND coalesce(host_verdict, '') <> 'rejected' AND (coalesce(host_verdict, '') <> 'suspect' OR NOT near) AS kept, coalesce(host_verdict, '') = 'rejected' AS host_rejected, failed, host_verdict FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""

def license_sql() -> str:
    """The exact containment of every template in every window of its scale."""
    rows = ", ".join(f"('{name}', '{words}', {m}, {scale})" for name, words, m, scale in license_scan.template_shingles(license_scan.TEMPLATES))
    return rf"""
WITH t AS (SELECT * FROM (VALUES {rows}) AS v(license, shingle, m, scale)),
w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT r, doc_id, ws, unnest(range(0, len(ws) - 4)) AS p FROM w WHERE len(ws) >= 5),
g AS (SELECT r, doc_id, p, concat_ws(' ', ws[p + 1], ws[p + 2], ws[p + 3], ws[p + 4], ws[p + 5]) AS shingle FROM s),
x AS (SELECT r, doc_id, license, m, p, shingle, unnest([p // scale, greatest(p // scale - 1, 0)]) AS win FROM g JOIN t USING (shingle)),
c AS (SELECT r, doc_id, license, win, count(DISTINCT shingle) / m::DOUBLE AS containment, min(p) AS p FROM x GROUP BY r, doc_id, license, win, m),
b AS (SELECT *, row_number() OVER (PARTITION BY r, license ORDER BY containment DESC, win) AS k FROM c WHERE containment >= 0.8)
SELECT doc_id, license, containment, p AS "at" FROM b WHERE k = 1
"""


def oracle_sql() -> dict[str, str]:
    """The other queries have no SQL: iterative graphs, suffix arrays, learned models and Python's regular expressions."""
    return {"op6_license_scan": license_sql(), "op10_quality_rules": RULES_SQL}
