"""Counts, health and histograms over the page table and over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frontier import TERMINAL

BOUNDS = (100, 500, 2000, 5000, 10_000, 30_000, 60_000)


def run_summary(p: DataFrame) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    s = F.col("page_type_code")
    return p.agg(F.count("*").alias("total"), n(s == "HTML", "html"), n(s == "HUB", "hub"), n(s == "BINARY", "bin"), n(s == "DUPLICATE", "duplicate"), n(s == "FRONTIER", "frontier"), n(s == "PROCESSING", "processing"), n(s == "ERROR", "error"))


def heartbeat(p: DataFrame, as_of: str) -> DataFrame:
    """as_of: a timestamp in SQL."""
    s = F.col("page_type_code")
    age = F.expr(f"timestampdiff(MILLISECOND, claimed_at, {as_of})")
    return p.agg(F.count_if(s == "FRONTIER").alias("frontier"), F.count_if(s == "PROCESSING").alias("processing"), F.count_if(s.isin(*TERMINAL)).alias("terminal"), F.coalesce(F.max(F.when(s == "PROCESSING", age)), F.lit(0)).cast("bigint").alias("oldest_lease_ms"))


def overdue(p: DataFrame, as_of: str) -> DataFrame:
    late = p.where(f"page_type_code = 'FRONTIER' AND next_attempt_at <= {as_of}").select(F.expr(f"timestampdiff(MILLISECOND, next_attempt_at, {as_of})").alias("ms"))
    return late.agg(F.count("*").alias("overdue"), F.coalesce(F.round(F.avg("ms")), F.lit(0)).cast("bigint").alias("avg_ms"), F.coalesce(F.max("ms"), F.lit(0)).cast("bigint").alias("max_ms"))


def errors_by_category(p: DataFrame) -> DataFrame:
    c = F.coalesce(F.nullif(F.trim("last_error_category"), F.lit("")), F.lit("UNKNOWN"))
    return p.where("page_type_code = 'ERROR'").groupBy(c.alias("category")).agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "category")


def top_domains(p: DataFrame, site: DataFrame, limit: int) -> DataFrame:
    done = p.where(F.col("page_type_code").isin(*TERMINAL)).groupBy("site_id").agg(F.count("*").alias("pages"))
    return done.join(site, "site_id").select("domain", "pages").orderBy(F.desc("pages"), "domain").limit(min(100, max(1, limit)))


def histogram(rows: DataFrame, key: str, ms: str, most_keys: int = 256) -> DataFrame:
    """Latencies in half-open buckets by key; keys after the first most_keys, by first appearance, are _other_."""
    bucket = F.lit(len(BOUNDS))
    for i in reversed(range(len(BOUNDS))):
        bucket = F.when(F.col(ms) < BOUNDS[i], i).otherwise(bucket)
    first = rows.groupBy(key).agg(F.min("event_id").alias("seen")).orderBy("seen", key).limit(most_keys).select(F.col(key).alias("known"))
    r = rows.join(F.broadcast(first), F.col(key).eqNullSafe(F.col("known")), "left")
    return r.groupBy(F.when(F.col("known").isNull(), "_other_").otherwise(F.col(key).cast("string")).alias("key"), bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def utilization_permille(used: Column, cap: Column) -> Column:
    return F.when(cap <= 0, 0).otherwise(F.least(F.lit(1000), F.floor(used * 1000 / cap))).cast("bigint")


def joined_counts(rows: DataFrame, key: str) -> DataFrame:
    """One row: k=v pairs in the order of keys, joined by commas."""
    c = rows.groupBy(key).agg(F.count("*").alias("n")).select(F.struct(F.col(key), "n").alias("s"))
    return c.agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.concat(s[key], F.lit("="), s["n"].cast("string"))), ",").alias("summary"))


def violations(p: DataFrame, links: DataFrame) -> DataFrame:
    bad = p.agg(F.count_if((F.col("page_type_code") == "PROCESSING") & (F.col("claimed_by").isNull() | F.col("claimed_at").isNull() | F.col("claim_expires_at").isNull())).alias("n")).select(F.lit("lease_incomplete").alias("check"), "n")
    loops = links.agg(F.count_if(F.col("from_page") == F.col("to_page")).alias("n")).select(F.lit("self_loop").alias("check"), "n")
    urls = p.groupBy("url").count().agg(F.count_if(F.col("count") > 1).alias("n")).select(F.lit("duplicate_url").alias("check"), "n")
    return bad.unionByName(loops).unionByName(urls)


def parsed_log(lines: DataFrame, col: str = "line") -> DataFrame:
    """event=... key=value lines as a map."""
    return lines.withColumn("fields", F.str_to_map(F.col(col), F.lit(" "), F.lit("=")))


REMEDIES = {
    "FETCH_TIMEOUT": ("max_attempts_timeout", "raise the time-out or the number of attempts"),
    "FETCH_HTTP_OVERLOAD": ("politeness_floor_ms", "slow down: the host answers 429 or 503"),
    "FETCH_CAPACITY_EXHAUSTED": ("workers", "fewer workers, or more render slots"),
    "DB_TRANSIENT": ("max_attempts_db", "the store was not reachable for a while"),
    "ROBOTS_TRANSIENT": ("robots_retry_minutes", "robots.txt could not be read"),
    "PARSER_FAILURE": ("html_budget", "the page could not be parsed"),
    "INVALID_URL": ("max_url_length", "the URL is not one"),
    "ROBOTS_DISALLOWED": ("crawl_hosts", "the host does not allow it"),
    "FETCH_HTTP_CLIENT": ("crawl_hosts", "the page is gone or closed"),
    "DB_CONSTRAINT": ("frontier_cap", "the row breaks a rule of the store"),
}


def remedies(p: DataFrame) -> DataFrame:
    """Error categories with what setting to look at; the dimension has ten rows."""
    rows = [(k, *v) for k, v in REMEDIES.items()]
    d = p.sparkSession.createDataFrame(rows, "category string, setting string, hint string")
    return errors_by_category(p).join(F.broadcast(d), "category", "left").select("category", "pages", "setting", "hint")

