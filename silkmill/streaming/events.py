"""Structured Streaming: the frontier's time-driven rules as keyed state, and event-time windows.

Each query reads the events table as a stream, runs over what is there (availableNow), and returns what its sink holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.readStream.schema(SCHEMA).parquet(f"{sf_dir}/events.parquet*")
    return s.withColumn("at", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over what is there; complete results are rewritten by each batch, appended ones are kept."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


def tumbling(spark: SparkSession, sf_dir: str, size: str = "1 hour") -> DataFrame:
    s = source(spark, sf_dir).withWatermark("at", "10 minutes").groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return drained(s.select(F.col("window.start").alias("start"), "event_type", "n", "total"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(spark: SparkSession, sf_dir: str, size: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    s = source(spark, sf_dir).withWatermark("at", "10 minutes").groupBy(F.window("at", size, step)).agg(F.count("*").alias("n"))
    return drained(s.select(F.col("window.start").alias("start"), "n"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


def sessions(spark: SparkSession, sf_dir: str, gap: str = "30 minutes") -> DataFrame:
    s = source(spark, sf_dir).withWatermark("at", "10 minutes").groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return drained(s.select("user_id", F.col("session_window.start").alias("start"), "n"), "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def _stateful(spark: SparkSession, sf_dir: str, fold: Callable, out: str, state: str) -> DataFrame:
    s = source(spark, sf_dir).select("user_id", "event_id", F.unix_micros("at").alias("us"), "event_type")
    g = s.groupBy("user_id").applyInPandasWithState(fold, out, state, "append", GroupStateTimeout.NoTimeout)
    return drained(g, "append")


def _ordered(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(pdfs)).sort_values(["us", "event_id"])


def token_schedule(spark: SparkSession, sf_dir: str, gap_ms: int = 5000) -> DataFrame:
    """event_id, domain, wait_us: one request of a domain each gap_ms; the others wait for their turn."""

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else None
        p = _ordered(pdfs)
        waits = []
        for us in p.us:
            at = us if free is None else max(us, free)
            waits.append(at - us)
            free = at + gap_ms * 1000
        state.update((int(free),))
        yield pd.DataFrame({"event_id": p.event_id, "domain": key[0], "wait_us": waits})

    return _stateful(spark, sf_dir, fold, "event_id bigint, domain bigint, wait_us bigint", "free bigint")


def overload_backoff(spark: SparkSession, sf_dir: str, most_ms: int = 300_000, overload: tuple[str, ...] = ("error",), clears: tuple[str, ...] = ("click", "purchase", "view")) -> DataFrame:
    """event_id, domain, backoff_ms: the pause that the event sets. Each overload (429 or 503) doubles a domain's pause, 10 s for the first; answers that clear (2xx, 404, 410) end it; others leave it, and have null."""

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        p = _ordered(pdfs)
        out = []
        for kind in p.event_type:
            n = n + 1 if kind in overload else 0 if kind in clears else n
            out.append(min(5000 * 2 ** min(n, 20), most_ms) if kind in overload else 0 if kind in clears else None)
        state.update((n,))
        yield pd.DataFrame({"event_id": p.event_id, "domain": key[0], "backoff_ms": pd.array(out, "Int64")})

    return _stateful(spark, sf_dir, fold, "event_id bigint, domain bigint, backoff_ms bigint", "n bigint")


def leases(spark: SparkSession, sf_dir: str, lease_s: int = 600) -> DataFrame:
    """event_id, domain, granted: one claim of a domain at a time; a lease that isn't renewed runs out, and the next claim recovers it."""

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else -1
        p = _ordered(pdfs)
        out = []
        for us in p.us:
            ok = us >= until
            until = us + lease_s * 1_000_000 if ok else until
            out.append(ok)
        state.update((int(until),))
        yield pd.DataFrame({"event_id": p.event_id, "domain": key[0], "granted": out})

    return _stateful(spark, sf_dir, fold, "event_id bigint, domain bigint, granted boolean", "until bigint")
