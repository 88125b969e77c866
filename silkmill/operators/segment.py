"""Segmentation operators: one Arrow pass over pages, strategies in functions.segment; reports on what comes out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import segment as seg
from .batches import table_of, text_parts

FIELDS = "heading_path string, merge_group_parent string, segment_type string, segment_text string, embedding_text string, token_estimate int, char_count int"
#: Python's \w and not \s, spelt so that Java and RE2 agree.
TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def token_estimate(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKENS)).cast("bigint")


def segments(pages: DataFrame, strategy: str = "v4", cfg: seg.Config = seg.Config(), id_col: str = "page_id", text_col: str = "cleaned_content") -> DataFrame:
    """page_id, strategy, chunk_index and the segment, for each segment of each page whose text isn't blank."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int32(), *(pa.int32() if f.endswith(" int") else pa.string() for f in FIELDS.split(", "))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_parts(batches, "t"):
            rows = [(i, strategy, k, *(s[n] for n in names)) for i, t in zip(b.column("page_id").to_pylist(), b.column("t").to_pylist(), strict=True) for k, s in enumerate(seg.segments(t, strategy, cfg))]
            yield table_of(rows, ["page_id", "strategy", "chunk_index", *names], types)

    p = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(text_col).alias("t")).where("t is not null and length(trim(t)) > 0")
    return p.mapInArrow(each, f"page_id bigint, strategy string, chunk_index int, {FIELDS}")


def fixed_chunks(rows: DataFrame, id_col: str, text_col: str, size: int = 50) -> DataFrame:
    """Windows of so many characters."""
    r = rows.where(F.length(text_col) > 0).select(id_col, text_col, F.explode(F.sequence(F.lit(0), F.floor((F.length(text_col) - 1) / size).cast("int"))).alias("chunk_index"))
    return r.select(id_col, F.col("chunk_index").cast("bigint").alias("chunk_index"), F.expr(f"substring({text_col}, chunk_index * {size} + 1, {size})").alias("chunk"))


def sentence_chunks(rows: DataFrame, id_col: str, text_col: str, most_words: int = 256, compat: bool = False) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_parts(batches, "t"):
            found = [seg.sentence_chunks(x, most_words, compat) if x else [] for x in b.column("t").to_pylist()]
            size = np.fromiter(map(len, found), np.int64, len(found))
            index = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(np.repeat(np.arange(len(found)), size))), pa.array(index, pa.int32()), pa.array([c for x in found for c in x], pa.string())], [id_col, "chunk_index", "chunk"])

    r = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return r.mapInArrow(each, StructType([StructField(id_col, r.schema["id"].dataType), StructField("chunk_index", IntegerType()), StructField("chunk", StringType())]))


def block_kinds(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks between blank lines, by kind: id, position, kind, level."""
    b = rows.select(id_col, F.posexplode(F.filter(F.transform(F.split(F.col(text_col), r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("position", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")
    b = b.withColumn("lines", lines).withColumn("n", F.size("lines"))
    count = lambda f: F.size(F.filter("lines", f))
    items, pipes = count(lambda x: x.rlike(r"^\s*([*+-]|\d+[).])\s")), count(lambda x: x.contains("|"))
    indented, marks = count(lambda x: x.rlike(r"^(    |\t)")), count(lambda x: x.rlike(r"[\[\]{}()<>;:=#]"))
    half = F.floor(F.col("n") / 2)
    kind = (
        F.when(F.col("block").rlike(r"^\[H[1-6]\]\s+.+$"), "heading")
        .when(items >= F.greatest(F.lit(1), F.floor(F.col("n") * 0.6)), "list_item")
        .when((F.col("n") >= 2) & (pipes >= F.greatest(F.lit(2), half)), "table_rows")
        .when(F.col("block").contains("```"), "code_block")
        .when((F.col("n") >= 2) & ((indented >= 1) | (marks >= half)), "code_block")
        .otherwise("prose")
    )
    return b.select(id_col, F.col("position").cast("bigint").alias("position"), kind.alias("kind"))


def quality(segs: DataFrame, cap: int = 240) -> DataFrame:
    """By strategy: pages, segments, tokens (least, median, nearest-rank 95th), small and over-long ones, heading coverage, warnings."""
    # one pass over the segments: token counts by page, then their histogram, which stays small; a page's own figures go with its first count
    t, c, first = F.col("token_estimate"), F.col("c"), F.col("at") == 0
    pages = segs.groupBy("strategy", "page_id").agg(F.collect_list(F.struct("token_estimate")).alias("ts"), F.count("heading_path").alias("headed"))
    rows = pages.select("strategy", "page_id", "headed", F.posexplode("ts").alias("at", "t")).select("*", F.col("t")["token_estimate"].alias("token_estimate"))
    h = rows.groupBy("strategy", "token_estimate").agg(F.count("*").alias("c"), F.count_if(first & F.col("page_id").isNotNull()).alias("pages"), F.sum(F.when(first, F.col("headed")).otherwise(0)).alias("headed"))
    # ranks over the histogram of token counts, and not over the segments
    w = Window.partitionBy("strategy").orderBy("token_estimate").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("strategy")))
    rank = F.greatest(F.lit(1), F.rint(F.lit(95 / 100.0) * F.col("n")))
    out = h.groupBy("strategy").agg(
        F.sum("pages").alias("pages"),
        F.sum(c).alias("segments"),
        F.min(t).alias("min_tokens"),
        F.expr("cast(percentile(token_estimate, 0.5, c) as int)").alias("median_tokens"),
        F.sum(F.when(t < 20, c).otherwise(0)).alias("under_20"),
        F.sum(F.when(t < 40, c).otherwise(0)).alias("under_40"),
        F.sum(F.when(t > cap, c).otherwise(0)).alias("over_cap"),
        F.round(100 * F.sum("headed") / F.sum(c), 2).alias("heading_percent"),
        F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - c < rank), t)).alias("p95_tokens"),
    )
    return out.withColumn("warn", (F.col("median_tokens") < 120) | (F.col("p95_tokens") > 450) | (F.col("over_cap") > 0))
