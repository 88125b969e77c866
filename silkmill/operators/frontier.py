"""Crawl frontier: claims, leases, retries, admission and persistence as transitions of a page table.

Claims take the place of row locks: rank within what is due is deterministic, and a transition rewrites state columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLAIM_FIELDS = ("id", "url", "site_id", "relevance_score", "attempt_count", "parser_retry_count", "next_attempt_at", "claimed_at", "claim_expires_at")
FATAL = ("INVALID_URL", "ROBOTS_DISALLOWED", "FETCH_HTTP_CLIENT", "DB_CONSTRAINT")
ATTEMPTS = {"FETCH_TIMEOUT": 3, "FETCH_HTTP_OVERLOAD": 5, "FETCH_CAPACITY_EXHAUSTED": 3, "DB_TRANSIENT": 5, "ROBOTS_TRANSIENT": 3}
TERMINAL = ("HTML", "HUB", "BINARY", "DUPLICATE", "ERROR")


def claim_order() -> list[Column]:
    return [F.desc("relevance_score"), F.asc_nulls_last("next_attempt_at"), F.asc_nulls_last("accessed_time"), F.asc("id")]


def due(pages: DataFrame, as_of: Column) -> DataFrame:
    return pages.where((F.col("page_type_code") == "FRONTIER") & (F.col("next_attempt_at") <= as_of))


def _leased(rows: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    return rows.withColumn("claimed_at", as_of).withColumn("claim_expires_at", as_of + F.make_dt_interval(secs=F.lit(max(1, seconds)))).select(*CLAIM_FIELDS)


def claim_next(pages: DataFrame, as_of: Column, n: int = 1, lease_seconds: int = 60) -> DataFrame:
    """The n best due rows, leased for at least a second."""
    return _leased(due(pages, as_of).orderBy(*claim_order()).limit(n), as_of, lease_seconds)


def claim_per_domain(pages: DataFrame, as_of: Column, lease_seconds: int = 60) -> DataFrame:
    """The best due row of each site."""
    w = Window.partitionBy("site_id").orderBy(*claim_order())
    return _leased(due(pages, as_of).withColumn("rn", F.row_number().over(w)).where("rn = 1"), as_of, lease_seconds)


def stale(pages: DataFrame, as_of: Column) -> Column:
    return (F.col("page_type_code") == "PROCESSING") & F.coalesce(F.col("claim_expires_at") < as_of, F.lit(False))


def stale_leases(pages: DataFrame, as_of: Column, batch: int) -> DataFrame:
    """Expired leases, those expired longest first."""
    return pages.where(stale(pages, as_of)).orderBy("claim_expires_at", "id").limit(batch)


def recover_leases(pages: DataFrame, as_of: Column, batch: int) -> DataFrame:
    """pages with a batch of expired leases put back: due now, a transient error, counters as they were. batch bounds the id list that is broadcast."""
    ids = stale_leases(pages, as_of, batch).select(F.col("id").alias("hit_id"))
    p = pages.join(F.broadcast(ids), pages["id"] == ids["hit_id"], "left")
    hit = F.col("hit_id").isNotNull()
    return p.select(*[
        {
            "page_type_code": F.when(hit, "FRONTIER").otherwise(F.col(c)),
            "next_attempt_at": F.when(hit, as_of).otherwise(F.col(c)),
            "last_error_category": F.when(hit, "DB_TRANSIENT").otherwise(F.col(c)),
        }.get(c, F.when(~hit, F.col(c)) if c in ("claimed_by", "claimed_at", "claim_expires_at") else F.col(c)).alias(c)
        for c in pages.columns
    ])


def attempts_allowed(category: Column, limits: dict[str, int] | None = None) -> Column:
    out = F.lit(None).cast("int")
    for k, v in (limits or ATTEMPTS).items():
        out = F.when(category == k, v).otherwise(out)
    return out


def retry_decision(category: Column, attempts: Column, parser_retries: Column) -> Column:
    """RESCHEDULE or TERMINAL; attempts and parser_retries are those counted before this failure."""
    again = F.when(category.isin(*FATAL), False).when(category == "PARSER_FAILURE", parser_retries < 1).otherwise(attempts < attempts_allowed(category))
    return F.when(F.coalesce(again, F.lit(False)), "RESCHEDULE").otherwise("TERMINAL")


def retry_delay_ms(category: Column, attempts: Column, base: int = 100, cap: int = 300_000, floor: int = 5000) -> Column:
    """Without jitter, 1 at least: exponential for time-outs and the database, and for overload from the politeness floor on; linear up to 30 s for capacity, minutes for robots, 2 s for the parser, the base for others."""
    power = F.pow(F.lit(2.0), F.least(attempts, F.lit(20))).cast("bigint")
    grown = lambda b: F.greatest(F.lit(1), F.least(F.lit(b) * power, F.lit(cap)))
    return (
        F.when(category.isin("FETCH_TIMEOUT", "DB_TRANSIENT"), grown(base))
        .when(category == "FETCH_HTTP_OVERLOAD", grown(max(floor, base)))
        .when(category == "FETCH_CAPACITY_EXHAUSTED", F.greatest(F.lit(1), F.least(F.lit(base) * (attempts + 1), F.lit(30_000))))
        .when(category == "ROBOTS_TRANSIENT", F.lit(120_000))
        .when(category == "PARSER_FAILURE", F.lit(2000))
        .otherwise(F.lit(max(1, base)))
        .cast("bigint")
    )


def reschedule(pages: DataFrame, as_of: Column) -> DataFrame:
    """Failed rows in work go back to the frontier or end: state, counters, due time (as it was for those that end), lease and error columns. A parser failure counts only as one."""
    work = pages.where("page_type_code = 'PROCESSING'")
    parser = F.col("category") == "PARSER_FAILURE"
    d = retry_decision(F.col("category"), F.col("attempt_count"), F.col("parser_retry_count"))
    out = work.withColumn("decision", d).withColumn("delay_ms", retry_delay_ms(F.col("category"), F.col("attempt_count")))
    again = F.col("decision") == "RESCHEDULE"
    return out.select(
        "id",
        "category",
        F.when(again, "FRONTIER").otherwise("ERROR").alias("page_type_code"),
        F.when(again & ~parser, F.col("attempt_count") + 1).otherwise(F.col("attempt_count")).alias("attempt_count"),
        F.when(again & parser, F.col("parser_retry_count") + 1).otherwise(F.col("parser_retry_count")).alias("parser_retry_count"),
        F.when(again, as_of + F.make_dt_interval(secs=(F.col("delay_ms") / 1000).cast("decimal(18,6)"))).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"),
        *[F.lit(None).cast(work.schema[c].dataType).alias(c) for c in ("claimed_by", "claimed_at", "claim_expires_at")],
        F.col("category").alias("last_error_category"),
        as_of.alias("last_error_at"),
    )


def victims(pages: DataFrame, n: int, hubs: bool = False) -> DataFrame:
    """Rows that would leave a full frontier first; with hubs those that would leave for a better hub."""
    rows = pages.where("page_type_code = 'FRONTIER'")
    return (rows.where("github_hub_page") if hubs else rows).orderBy("relevance_score", F.desc_nulls_last("next_attempt_at"), F.desc("id")).limit(n)


def admitted(frontier: DataFrame, offers: DataFrame, cap: int) -> DataFrame:
    """The frontier after offers (url, relevance_score, arrival) to a frontier of at most cap rows (url, relevance_score, arrival): each takes the place of the worst only if it is strictly better. With every incumbent due and distinct urls that equals the best cap rows, the earlier first on a tie."""
    known = offers.join(frontier.select("url"), "url", "left_anti")
    w = Window.partitionBy("url").orderBy("arrival")
    first = known.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    every = frontier.select("url", "relevance_score", "arrival", F.lit(False).alias("offered")).unionByName(first.select("url", "relevance_score", "arrival", F.lit(True).alias("offered")))
    return every.orderBy(F.desc("relevance_score"), "offered", "arrival", "url").limit(cap)


def admit_fold(frontier: DataFrame, offers: DataFrame, cap: int) -> DataFrame:
    """As admitted, one offer after the other, and so exact where an evicted url comes again or incumbents aren't due yet. One task: for audits of a batch, not for a corpus."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        have = {r.url: (r.relevance_score, r.arrival) for r in pdf[~pdf.offered].itertuples()}
        for r in pdf[pdf.offered].sort_values(["arrival", "url"]).itertuples():
            if r.url in have:
                continue
            if len(have) >= cap:
                worst = min(have, key=lambda u: (have[u][0], -have[u][1], u))
                if r.relevance_score <= have[worst][0]:
                    continue
                del have[worst]
            have[r.url] = (r.relevance_score, r.arrival)
        return pd.DataFrame([(u, s, a) for u, (s, a) in have.items()], columns=["url", "relevance_score", "arrival"])

    both = frontier.select("url", "relevance_score", "arrival", F.lit(False).alias("offered")).unionByName(offers.select("url", "relevance_score", "arrival", F.lit(True).alias("offered")))
    return both.groupBy(F.lit(1).alias("one")).applyInPandas(lambda pdf: fold(pdf), "url string, relevance_score double, arrival bigint")


def admission_reason(url_reason: Column, topics: Column, subpath: Column, hub: Column, hub_room: Column, html_room: Column, frontier_room: Column, better: Column, robots: Column, hub_better: Column | None = None) -> Column:
    """Why a discovered URL isn't admitted, null if it is; checks in order. hub_room is negative where hubs aren't wanted at all. better, and hub_better among hubs, say whether it outranks the worst queued row; null: none is queued that could leave."""
    hub_better = better if hub_better is None else hub_better
    full = (~hub & (html_room <= 0)) | (frontier_room <= 0)
    return (
        F.when(url_reason.isNotNull(), url_reason)
        .when(topics, "GITHUB_TOPICS_PATH_BLOCKED")
        .when(subpath, "GITHUB_REPO_SUBPATH_BLOCKED")
        .when(hub & (hub_room < 0), "HUB_BUDGET_ZERO")
        .when(hub & (hub_room == 0) & hub_better.isNull(), "HUB_BUDGET_DROPPED")
        .when(hub & (hub_room == 0) & ~hub_better, "HUB_BUDGET_LOW_SCORE")
        .when(full & better.isNull(), "BUDGET_DROPPED")
        .when(~hub & (html_room <= 0) & ~better, "BUDGET_DROPPED")
        .when((frontier_room <= 0) & ~better, "FRONTIER_FULL_LOW_SCORE")
        .when(robots == "DISALLOWED", "ROBOTS_DISALLOWED")
    )


def enqueue_decision(in_scope: Column, robots: Column, as_of: Column, deny_until: Column) -> tuple[Column, Column]:
    """ACCEPT, DEFER or REJECT, and when the row is due."""
    d = F.when(~in_scope, "REJECT_CRAWL_SCOPE").when(robots == "DISALLOWED", "REJECT_ROBOTS").when(robots == "TEMPORARY_DENY", "DEFER").otherwise("ACCEPT")
    return d, F.when(d == "DEFER", deny_until).when(d == "ACCEPT", as_of)


def fetch_category(status: Column) -> Column:
    return F.when(status.isin(429, 503), "FETCH_HTTP_OVERLOAD").when(status >= 500, "FETCH_TIMEOUT").when(status >= 400, "FETCH_HTTP_CLIENT")


def status_class(status: Column) -> Column:
    return F.when((status >= 200) & (status < 300), "2xx").when((status >= 400) & (status < 500), "4xx").when(((status >= 300) & (status < 400)) | ((status >= 500) & (status < 600)), "3xx_5xx").otherwise("other")


def lease_too_short(wait_ms: Column, lease_ms: Column, remaining_ms: Column) -> Column:
    return wait_ms + lease_ms / 4 > remaining_ms


def robots_window_ms(failures: Column, retry_min: int = 2, most_min: int = 10) -> Column:
    return F.least(F.lit(retry_min * 60_000) * F.pow(F.lit(2.0), F.greatest(failures - 1, F.lit(0))).cast("bigint"), F.lit(most_min * 60_000)).cast("bigint")


def overload_backoff_ms(failures: Column, most: int = 300_000) -> Column:
    """The pause after so many failures in a row, this one counted: 10 s after the first."""
    return F.least(F.lit(5000) * F.pow(F.lit(2.0), F.least(failures, F.lit(20))).cast("bigint"), F.lit(most)).cast("bigint")


def persisted(pages: DataFrame, body: str = "html_content") -> DataFrame:
    """Fetched pages after ownership is settled: the least id of equal bodies owns them, the others become duplicates without html and with an edge to the owner."""
    h = F.sha2(F.coalesce(F.col(body), F.lit("")), 256)
    w = Window.partitionBy("content_hash")
    p = pages.withColumn("content_hash", h).withColumn("owner", F.min("id").over(w))
    own = F.col("id") == F.col("owner")
    return p.select("id", "content_hash", F.when(own & F.col("github_hub_page"), "HUB").when(own, "HTML").otherwise("DUPLICATE").alias("page_type_code"), F.when(own, F.length(body)).cast("bigint").alias("html_length"), F.when(~own, F.col("owner")).alias("link_to"))
