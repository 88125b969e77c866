"""Tables derived from the given ones for the crawl operators, once as DataFrame and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("HTML", "HUB", "BINARY", "DUPLICATE", "FRONTIER", "PROCESSING", "ERROR")
CATEGORIES = ("FETCH_TIMEOUT", "FETCH_HTTP_OVERLOAD", "FETCH_CAPACITY_EXHAUSTED", "DB_TRANSIENT", "ROBOTS_TRANSIENT", "PARSER_FAILURE", "INVALID_URL", "ROBOTS_DISALLOWED", "FETCH_HTTP_CLIENT", "DB_CONSTRAINT")
AS_OF = "2024-01-01 12:00:00"
START = "2024-01-01 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> F.Column:
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")


def crawl_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("doc_id") % 7 + 1).cast("int"))
    d = d.select(
        (F.col("doc_id") + 1).alias("id"),
        F.col("doc_id"),
        F.substring("source", 4, 10).cast("int").alias("site_id"),
        state.alias("page_type_code"),
        F.col("text").alias("html_content"),
        ((F.col("doc_id") * 37 % 101) / 100.0).alias("relevance_score"),
        F.expr(f"timestampadd(MINUTE, cast(doc_id * 61 % 1440 as int), TIMESTAMP_NTZ '{START}')").alias("next_attempt_at"),
        (F.col("doc_id") % 6).alias("attempt_count"),
        (F.col("doc_id") % 2).alias("parser_retry_count"),
        F.element_at(F.array(*map(F.lit, (200, 404, 503, 301))), (F.col("doc_id") % 4 + 1).cast("int")).alias("http_status_code"),
        (F.col("doc_id") % 11 == 0).alias("github_hub_page"),
    )
    leased = F.col("page_type_code") == "PROCESSING"
    error = F.get(F.array(*map(F.lit, (*CATEGORIES, ""))), F.expr("cast(doc_id div 7 % 12 as int)"))
    return d.select(
        "*",
        F.concat(F.lit("https://site"), F.col("site_id").cast("string"), F.lit(".example.com/p/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("doc_id") % 3 != 0, F.expr("timestampadd(MINUTE, -cast(doc_id % 500 as int), next_attempt_at)")).alias("accessed_time"),
        F.when(leased, F.concat(F.lit("w"), (F.col("doc_id") % 4).cast("string"))).alias("claimed_by"),
        F.when(leased, F.col("next_attempt_at")).alias("claimed_at"),
        F.when(leased, F.expr("timestampadd(MINUTE, cast(doc_id % 120 as int), next_attempt_at)")).alias("claim_expires_at"),
        F.when(F.col("page_type_code") == "ERROR", error).alias("last_error_category"),
    )


_states = ", ".join(f"'{s}'" for s in STATES)
_errors = ", ".join(f"'{c}'" for c in (*CATEGORIES, ""))
PAGE_SQL = f"""crawl_page0 AS (
  SELECT doc_id + 1 AS id, doc_id, CAST(substr(source, 4) AS INTEGER) AS site_id, (ARRAY[{_states}])[CAST(doc_id % 7 + 1 AS INTEGER)] AS page_type_code,
    text AS html_content, (doc_id * 37 % 101) / 100.0 AS relevance_score, TIMESTAMP '{START}' + to_minutes(CAST(doc_id * 61 % 1440 AS INTEGER)) AS next_attempt_at,
    doc_id % 6 AS attempt_count, doc_id % 2 AS parser_retry_count, (ARRAY[200, 404, 503, 301])[CAST(doc_id % 4 + 1 AS INTEGER)] AS http_status_code, doc_id % 11 = 0 AS github_hub_page
  FROM documents),
crawl_page AS (
  SELECT *, 'https://site' || site_id || '.example.com/p/' || doc_id AS url,
    CASE WHEN doc_id % 3 <> 0 THEN next_attempt_at - to_minutes(CAST(doc_id % 500 AS INTEGER)) END AS accessed_time,
    CASE WHEN page_type_code = 'PROCESSING' THEN 'w' || (doc_id % 4) END AS claimed_by,
    CASE WHEN page_type_code = 'PROCESSING' THEN next_attempt_at END AS claimed_at,
    CASE WHEN page_type_code = 'PROCESSING' THEN next_attempt_at + to_minutes(CAST(doc_id % 120 AS INTEGER)) END AS claim_expires_at,
    CASE WHEN page_type_code = 'ERROR' THEN (ARRAY[{_errors}, NULL])[CAST(doc_id // 7 % 12 + 1 AS INTEGER)] END AS last_error_category
  FROM crawl_page0)"""
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
