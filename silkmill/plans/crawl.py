"""The crawl as micro-batches over tables: claim, fetch, parse, persist, admit, until the budget or the queue is used up.

Each round's page table is written to the shared folder, so that a round depends on the one before and on nothing earlier.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import scoring, urls
from ..operators import html as html_ops
from ..session import shared_dir
from ..sources.fetch import fetched


@dataclass
class Crawled:
    pages: DataFrame
    links: DataFrame
    rounds: int
    stopped: str


def _kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(spark)}/crawl-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crawl(web: DataFrame, seeds: DataFrame, keywords: dict[str, list[str]], cfg: EngineConfig = EngineConfig(), most_rounds: int = 50, on_round: Callable[[int, DataFrame], None] | None = None) -> Crawled:
    """web: page_id, url, html, the pages that can be fetched; seeds: url, relevance_score. One page of each host a round. on_round sees each round's table, as a heartbeat does."""
    cfg.validate()
    spark = web.sparkSession
    start = seeds.select("url", "relevance_score", F.lit("FRONTIER").alias("state"), F.lit(0).cast("bigint").alias("found"), F.lit(None).cast("string").alias("content_hash")).dropDuplicates(["url"])
    pages, links, stopped = _kept(spark, start, "pages"), None, "rounds"
    done = 0
    for done in range(1, most_rounds + 1):
        n = pages.agg(F.count_if(F.col("state") == "HTML").alias("html"), F.count_if(F.col("state") == "FRONTIER").alias("queue")).first()
        if n.html >= cfg.html_budget or not n.queue:
            stopped = "budget" if n.html >= cfg.html_budget else "empty"
            done -= 1
            break
        due = pages.where("state = 'FRONTIER'").withColumn("host", urls.host_key(F.col("url")))
        claims = due.groupBy("host").agg(F.max_by("url", F.struct("relevance_score", -F.col("found"), "url")).alias("url")).select("url")
        got = _kept(spark, fetched(claims, web.select("url", "html")).withColumn("content_hash", F.when(F.col("html").isNotNull(), F.sha2("html", 256))), "fetched")
        known = pages.where("content_hash is not null and state = 'HTML'").select("content_hash").distinct().withColumn("known", F.lit(True))
        first = got.groupBy("content_hash").agg(F.min("url").alias("first"))
        state = F.when(F.col("html").isNull(), "ERROR").when(F.col("known") | (F.col("url") != F.col("first")), "DUPLICATE").otherwise("HTML")
        new = got.join(known, "content_hash", "left").join(first, "content_hash", "left").select("url", state.alias("new_state"), F.col("content_hash").alias("new_hash"))
        out = html_ops.links(got.where("html is not null").select(F.xxhash64("url").alias("page_id"), "url", "html"), cfg.crawl_hosts or None)
        out = out.withColumn("relevance_score", scoring.relevance(F.col("url"), F.col("anchor"), F.col("context"), keywords["primary"], keywords["secondary"], (cfg.primary_weight, cfg.secondary_weight), cfg.occurrence_cap))
        edges = out.select(F.col("page_id").alias("from_page"), "url").distinct()
        links = edges if links is None else links.unionByName(edges).distinct()
        offered = out.where(urls.reject_reason(F.col("url"), cfg.max_url_length).isNull() & ~urls.topics_blocked(F.col("url"), cfg.crawl_hosts or ("github.com",)) & ~urls.subpath_blocked(F.col("url"), cfg.crawl_hosts or ("github.com",), cfg.deny_subpaths))
        offered = offered.groupBy("url").agg(F.max_by("relevance_score", -F.col("position")).alias("relevance_score")).join(pages.select("url"), "url", "left_anti")
        old = pages.join(new, "url", "left").select("url", "relevance_score", F.coalesce("new_state", "state").alias("state"), "found", F.coalesce("new_hash", "content_hash").alias("content_hash"))
        every = old.unionByName(offered.select("url", "relevance_score", F.lit("FRONTIER").alias("state"), F.lit(done).cast("bigint").alias("found"), F.lit(None).cast("string").alias("content_hash")))
        best = every.where("state = 'FRONTIER'").orderBy(F.desc("relevance_score"), "found", "url").limit(cfg.frontier_cap)
        pages = _kept(spark, every.where("state <> 'FRONTIER'").unionByName(best), "pages")
        links = _kept(spark, links, "links")
        if on_round:
            on_round(done, pages)
    return Crawled(pages, links if links is not None else spark.createDataFrame([], "from_page bigint, url string"), done, stopped)
