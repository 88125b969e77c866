"""Retrieval contexts, prompts and evaluation. Models are protocols; what stands in for them here is deterministic and named so."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors


class EmbeddingBackend(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class Scorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


@lru_cache(100_000)
def hashed(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")


@dataclass(frozen=True)
class HashingBackend:
    """Stands in for a sentence encoder: hashed words, unit length."""

    dim: int = 64

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            h = np.fromiter(map(hashed, t.lower().split()), np.uint64)
            out[i] = np.bincount((h % np.uint64(self.dim)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0), self.dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class OverlapScorer:
    """Stands in for a cross-encoder: share of the question's words in the passage."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, p in pairs:
            a, b = set(q.lower().split()), set(p.lower().split())
            out.append(len(a & b) / len(a) if a else 0.0)
        return out


@dataclass(frozen=True)
class QuotingGenerator:
    """Stands in for a language model: gives the first line of the context back."""

    def generate(self, prompt: str) -> str:
        return next((x for x in prompt.splitlines()[1:] if x.strip()), "")[:200]


@dataclass(frozen=True)
class Retrieval:
    metric: str = "cosine"
    strategy: str | None = None
    rerank: bool = True
    top_k: int = 5
    candidate_k: int = 20
    max_context_chars: int = 7000

    def validate(self) -> Retrieval:
        if self.top_k <= 0 or self.candidate_k <= 0 or self.max_context_chars <= 0:
            raise ValueError("top_k, candidate_k and max_context_chars must be positive")
        if self.metric not in vectors.METRICS:
            raise ValueError(f"metric {self.metric}")
        return self

    @property
    def pool(self) -> int:
        return max(self.top_k, self.candidate_k if self.rerank else self.top_k)


def embed(rows: DataFrame, text_col: str, backend: EmbeddingBackend = HashingBackend(), out: str = "embedding") -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(t: pd.Series) -> pd.Series:
        v = backend.encode(["" if x is None else x for x in t])
        if v.shape[1] != backend.dim:
            raise ValueError(f"{v.shape[1]} dimensions, not {backend.dim}")
        return pd.Series(list(v), dtype=object)

    return rows.withColumn(out, run(text_col))


def trimmed(c: str) -> Column:
    """Without blanks at either end: those of Unicode's class Zs, as in SQL's trim, and so no line breaks or tabs."""
    return F.regexp_replace(c, r"^\p{Zs}+|\p{Zs}+\z", "")


def header(rank: Column, url: Column, segment: Column, page: Column, score: Column) -> Column:
    return F.format_string("[%d] URL: %s | segment_id: %d | page_id: %d | score: %.4f", rank, url, segment, page, score)


def contexts(hits: DataFrame, max_chars: int = 7000) -> DataFrame:
    """query_id, context: blocks of ranked hits (query_id, rank, head, body) joined by blank lines, as many from the first on as fit; if not even the first does, its beginning."""
    b = hits.withColumn("block", F.concat("head", F.lit("\n"), trimmed("body")))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("upto", F.sum(F.length("block")).over(w) + 2 * (F.col("rank") - 1))
    kept = b.where((F.col("upto") <= max_chars) | (F.col("rank") == 1))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda s: s["block"])
    return kept.groupBy("query_id").agg(F.substring(F.array_join(parts, "\n\n"), 1, max_chars).alias("context"))


def prompt(question: Column, context: Column | None) -> Column:
    if context is None:
        return F.concat(F.lit("Answer the question in a few sentences.\n\nQuestion: "), question, F.lit("\nAnswer:"))
    return F.concat(F.lit("Answer from the context alone and name the sources by their numbers. If it is not there, say so.\n\nContext:\n"), F.when(context == "", F.lit("(no results)")).otherwise(context), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def rerank(hits: DataFrame, top_k: int, scorer: Scorer | None = OverlapScorer()) -> DataFrame:
    """Hits (query_id, question, rank, body, ...) in the order of the scorer, ties by rank; as they are without a scorer. A query of which a hit has no score, as where the scorer fails on a batch, keeps its order whole, without scores."""
    if scorer is None:
        s = hits.withColumn("rerank_score", F.lit(None).cast("double"))
    else:

        @F.pandas_udf("double")
        def run(q: pd.Series, p: pd.Series) -> pd.Series:
            try:
                return pd.Series(scorer.score(list(zip(q, p, strict=True))), dtype=float)
            except Exception:  # noqa: BLE001  a scorer that fails leaves the order as it is
                return pd.Series([None] * len(q), dtype=float)

        each = Window.partitionBy("query_id")
        s = hits.withColumn("rerank_score", run("question", "body")).withColumn("rerank_score", F.when(F.count_if(F.col("rerank_score").isNull()).over(each) == 0, F.col("rerank_score")))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("rerank_score", F.lit(-1e9))), "rank")
    return s.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= top_k)


def search(segs: DataFrame, questions: DataFrame, cfg: Retrieval = Retrieval(), backend: EmbeddingBackend = HashingBackend(), id_col: str = "segment_id") -> DataFrame:
    """questions (query_id, question) against segs (segment_id, embedding, body, strategy): hits with rank and distance."""
    cfg.validate()
    s = segs.where(F.col("strategy") == cfg.strategy) if cfg.strategy else segs
    q = embed(questions, "question", backend, "query")
    near = vectors.nearest_batch(s, q.select("query_id", "query"), cfg.pool, cfg.metric, id_col, "embedding")
    return near.join(s.drop("embedding"), id_col).join(questions, "query_id")


@dataclass
class RunResult:
    question: str
    mode: str
    hits: list = field(default_factory=list)
    prompt: str = ""
    answer: str = ""
    config: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)


def answer(spark: SparkSession, segs: DataFrame, question: str, mode: str = "rag", cfg: Retrieval = Retrieval(), generator: Generator = QuotingGenerator(), backend: EmbeddingBackend = HashingBackend()) -> list[RunResult]:
    """One question, answered with retrieval, without, or both."""
    if mode not in ("rag", "llm_only", "both"):
        raise ValueError(f"mode {mode}")
    q = spark.createDataFrame([(0, question)], "query_id bigint, question string")
    out = []
    for m in ("rag", "llm_only") if mode == "both" else (mode,):
        hits = []
        if m == "rag":
            found = search(segs, q, cfg, backend)
            top = rerank(found, cfg.top_k) if cfg.rerank else found.withColumn("new_rank", F.col("rank")).where(F.col("rank") <= cfg.top_k)
            shown = top.select("query_id", F.col("new_rank").cast("bigint").alias("rank"), F.concat(F.lit("["), F.col("new_rank").cast("string"), F.lit("]")).alias("head"), "body")
            row = contexts(shown, cfg.max_context_chars).select(prompt(F.lit(question), F.col("context")).alias("p")).first()
            hits = [r.asDict() for r in top.select("segment_id", "new_rank", "distance").orderBy("new_rank").collect()]
            text = row["p"] if row else q.select(prompt(F.lit(question), F.lit("")).alias("p")).first()["p"]
        else:
            text = q.select(prompt(F.lit(question), None).alias("p")).first()["p"]
        out.append(RunResult(question, m, hits, text, generator.generate(text), asdict(cfg)))
    return out


def summaries(hits: DataFrame) -> DataFrame:
    """query_id, summary of the first three hits (query_id, rank, url, body): the start of each trimmed body."""
    s = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "url", F.lit(": "), F.substring(F.replace(trimmed("body"), F.lit("\n"), F.lit(" ")), 1, 120), F.lit("..."))
    top = hits.where("rank <= 3").select("query_id", F.struct("rank", s.alias("s")).alias("r"))
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["s"]), " | ").alias("summary"))


def markdown_cell(x: Column, most: int = 120) -> Column:
    flat = F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)
