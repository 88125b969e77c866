"""Exact duplicates: hashes, owners, edges and the canonical map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sha256(x: Column) -> Column:
    """Of null as of an empty text."""
    return F.sha2(F.coalesce(x, F.lit("")), 256)


def filled(x: str) -> Column:
    return F.col(x).isNotNull() & (F.length(F.trim(x)) > 0)


def owners(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """content_hash, owner, copies; only hashes are shuffled."""
    return rows.select(F.col(id_col), sha256(F.col(text_col)).alias("content_hash")).groupBy("content_hash").agg(F.min(id_col).alias("owner"), F.count("*").alias("copies"))


def duplicate_edges(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """from_page, to_page: each duplicate to its owner; no loops."""
    h = rows.select(F.col(id_col).alias("from_page"), sha256(F.col(text_col)).alias("h"))
    w = Window.partitionBy("h")
    return h.withColumn("to_page", F.min("from_page").over(w)).where("from_page <> to_page").select("from_page", "to_page").distinct()


def canonical(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """content_fingerprint, canonical_id, content_length, duplicate_count of texts that aren't blank."""
    r = rows.where(filled(text_col)).select(id_col, F.md5(text_col).alias("content_fingerprint"), F.length(text_col).cast("bigint").alias("content_length"))
    return r.groupBy("content_fingerprint").agg(F.min(id_col).alias("canonical_id"), F.max("content_length").alias("content_length"), F.count("*").alias("duplicate_count"))


def page_map(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, content_fingerprint, is_canonical."""
    r = rows.where(filled(text_col)).select(F.col(id_col), F.md5(text_col).alias("content_fingerprint"))
    w = Window.partitionBy("content_fingerprint").orderBy(id_col)
    return r.withColumn("rn", F.row_number().over(w)).select(id_col, "content_fingerprint", (F.col("rn") == 1).alias("is_canonical"))


def first_arrivals(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def upserted(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """target with new rows in the place of those of equal keys: the latest wins."""
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new)


def get_or_insert(known: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    """known and the first of each offered key that isn't there, with a flag: first values are never overwritten."""
    fresh = offered.join(known.select(key), key, "left_anti").dropDuplicates([key])
    return known.withColumn("inserted", F.lit(False)).unionByName(fresh.withColumn("inserted", F.lit(True)), allowMissingColumns=True)
