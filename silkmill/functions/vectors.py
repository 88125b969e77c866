"""Vector distances as built-in expressions over arrays, and k nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """NaN, which sorts last, where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(1 - dot(a, b) / F.nullif(n, F.lit(0.0)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x - y))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


def hamming(a: Column, b: Column) -> Column:
    """Of vectors as bits: positive entries."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > 0) != (y > 0)), lambda x: x)).cast("bigint")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > 0) & (y > 0)), lambda x: x))
    some = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > 0) | (y > 0)), lambda x: x))
    return F.when(some > 0, 1 - both / some).otherwise(F.lit(0.0))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"cosine": cosine_distance, "l2": l2, "ip": negative_inner_product, "l1": l1, "hamming": hamming, "jaccard": jaccard}
COLUMNS = ("embedding", "embedding_labse")


def tidy(x: Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def nearest(rows: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows nearest to one query vector; ties by id."""
    if k <= 0:
        raise ValueError("k must be positive")
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.where(F.col(vec_col).isNotNull()).withColumn("distance", tidy(METRICS[metric](F.col(vec_col), q))).orderBy("distance", id_col).limit(k)


#: Queries of at most this many go to every executor; more are joined without a hint.
BROADCAST_QUERIES = 10_000
PAIRED = 16  # queries of at most so many go pair by pair, in one pass over the rows
BLOCK = 2048  # vectors, rows or queries, that are compared at once
BLOCKS = "id binary, vec binary, dim int"


def nearest_batch(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each query (query_id, query) the k nearest rows: query_id, id, distance, rank.

    Beyond PAIRED queries, cosine distances between whole-number ids and vectors without nulls are found by blocks of both, of which each gives the few
    that can be nearest; all else goes pair by pair. Which of both a vector goes by doesn't show in the result.
    """
    n = queries.limit(BROADCAST_QUERIES + 1).count()
    few = F.broadcast if n <= BROADCAST_QUERIES else (lambda df: df)
    r = rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    q = queries.select(F.col("query_id").alias("id"), F.col("query").alias("vec"))
    whole = all(df.schema["id"].dataType.typeName() in ("long", "integer", "short", "byte") for df in (r, q))
    if metric == "cosine" and k > 0 and n > PAIRED and whole:
        plain = F.coalesce(F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < 1e100)) & F.exists("vec", lambda x: F.abs(x.cast("double")) > 1e-100), F.lit(False))
        good = [df.where(plain).select(F.col("id").cast("bigint"), F.col("vec").cast("array<double>")).mapInArrow(_blocks, BLOCKS) for df in (r, q)]
        both = good[0].crossJoin(few(good[1].toDF("qid", "query", "qdim"))).where("dim = qdim")
        near = both.mapInArrow(_nearest_of(k), "query_id bigint, id bigint, distance double")
        near = near.select(F.col("query_id").cast(q.schema["id"].dataType).alias("query_id"), F.col("id").cast(r.schema["id"].dataType).alias("id"), tidy(F.col("distance")).alias("distance"))
        # vectors that aren't plain, and lengths that differ
        flagged, asked = (df.select("*", plain.alias("plain"), F.size("vec").alias("size")) for df in (r, q))
        asked = few(asked.select(F.col("id").alias("query_id"), F.col("vec").alias("query"), F.col("plain").alias("qplain"), F.col("size").alias("qsize")))
        rest = flagged.join(asked, ~F.col("plain") | ~F.col("qplain") | (F.col("size") != F.col("qsize")))
    else:
        near, rest = None, r.crossJoin(few(q.toDF("query_id", "query")))
    scored = rest.select("query_id", "id", tidy(METRICS[metric](F.col("vec"), F.col("query"))).alias("distance"))
    scored = scored if near is None else near.unionByName(scored)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "distance", F.col("rank").cast("bigint").alias("rank"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and vectors of one length as binary, BLOCK vectors a row."""
    held: dict[int, list] = {}

    def block(dim: int) -> pa.RecordBatch:
        ids, vecs = zip(*held.pop(dim), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.array(vecs, "<f8").tobytes()], pa.binary()), pa.array([dim], pa.int32())], ["id", "vec", "dim"])

    for b in batches:
        for s in range(0, len(b), BLOCK):
            part = b.slice(s, BLOCK)
            vecs = part.column(1)
            flat, ends = vecs.flatten().to_numpy(), np.cumsum(vecs.value_lengths().to_numpy())
            for i, v in zip(part.column(0).to_pylist(), np.split(flat, ends[:-1]), strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == BLOCK:
                    yield block(len(v))
    for dim in list(held):
        yield block(dim)


def _nearest_of(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each pair of blocks the rows that can be among the k nearest of a query by rounded distance and id, with the distance that cosine_distance gives, to the last bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, vec, dim, qids, query, _ in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                ids, qids = np.frombuffer(ids, "<i8"), np.frombuffer(qids, "<i8")
                x, y = np.frombuffer(vec, "<f8").reshape(-1, dim), np.frombuffer(query, "<f8").reshape(-1, dim)
                out = [_nearest_in(ids, x, lengths(x), qids[s : s + 256], y[s : s + 256], k) for s in range(0, len(y), 256)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "id", "distance"])

    return run


def summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products summed one after another, as Spark does."""
    s = np.zeros(len(x))
    for j in range(x.shape[1]):
        s += x[:, j] * y[:, j]
    return s


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(summed(x, x))


def _nearest_in(ids: np.ndarray, x: np.ndarray, nx: np.ndarray, qids: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ny = lengths(y)
    rough = 1 - (y @ x.T) / (ny[:, None] * nx)
    most = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1] + 2e-6  # what rounds to no more than the kth
    q, r = np.nonzero(rough <= most[:, None])
    d = 1 - summed(x[r], y[q]) / (nx[r] * ny[q])
    low, high = np.floor((d - 1e-12) * 1e6 + 0.5), np.floor((d + 1e-12) * 1e6 + 0.5)
    bucket = np.where(low == high, low, np.inf)  # distances at which rounding may go either way are each by themselves
    order = np.lexsort((ids[r], np.where(low == high, 0, d), bucket, low == high, q))
    q, r, d, sure = q[order], r[order], d[order], (low == high)[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (sure[1:] != sure[:-1]) | (~sure[1:] & (d[1:] != d[:-1]))
    start = np.flatnonzero(new)
    keep = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < k
    return qids[q[keep]], ids[r[keep]], d[keep]


def quality(rows: DataFrame, vec_col: str = "embedding", near_zero: float = 1e-6, sparse: float = 0.05) -> DataFrame:
    """Norms (least, median, nearest-rank 95th), near-zero and sparse vectors."""
    v = rows.where(F.col(vec_col).isNotNull()).select(F.round(norm(F.col(vec_col)), 6).alias("norm"), (F.size(F.filter(vec_col, lambda x: x != 0)) / F.size(vec_col)).alias("share"))
    return v.agg(F.count("*").alias("vectors"), F.min("norm").alias("min_norm"), F.round(F.expr("percentile(norm, 0.5)"), 6).alias("median_norm"), F.count_if(F.col("norm") <= near_zero).alias("near_zero"), F.count_if(F.col("share") <= sparse).alias("sparse"))


def percentile_nearest_rank(rows: DataFrame, value: str, p: int) -> DataFrame:
    """The value at rank max(1, p/100 * n rounded half to even)."""
    w = Window.orderBy(value)
    n = rows.where(F.col(value).isNotNull()).agg(F.count("*").alias("n"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    run = counts.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.greatest(F.lit(1), F.rint(F.lit(p / 100.0) * F.col("n")))
    return run.crossJoin(n).where((F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank)).select(F.col(value).alias("value"))
