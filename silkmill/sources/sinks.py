"""Sinks: segment upserts and rebuilds, JSON traces, Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rag import markdown_cell

SEGMENT_KEY = ("page_id", "strategy", "chunk_index")


def merged_segments(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by page, strategy and chunk index: all other columns from the new row. Old rows of higher index stay, as without a rebuild."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*SEGMENT_KEY).orderBy(F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def rebuild_segments(segments: DataFrame, path: str) -> None:
    """Replaces the strategies that segments holds and leaves the others."""
    segments.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy").parquet(path)


def json_trace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, most: int = 120) -> DataFrame:
    """One line for each row of a Markdown table, in a column named line."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c).cast("string"), most) for c in rows.columns]), F.lit(" |")).alias("line"))


def markdown_head(rows: DataFrame) -> str:
    return "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
