"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have (names compare without case, as in Spark)."""
    have = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in have:
        k += 1
        name = f"{stem}{k}"
    return name


def named(*columns: str) -> list:
    """Columns by name, whatever signs the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def whole_id(c: str):
    """An id as a bigint; one that isn't a whole number is null."""
    return named(c)[0].try_cast("bigint")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows: what a worker makes of whole documents stays small, whatever the session's batch size."""
    for b in batches:
        for k in range(0, len(b), rows):
            yield b.slice(k, rows)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1_000_000, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many bytes of text and so many rows, or of one row: rows alone bound no worker's memory where texts are long."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        k = 0
        while k < len(b):
            stop = min(k + rows, max(k + 1, int(np.searchsorted(ends, ends[k] - size[k] + most, "right"))))
            yield b.slice(k, stop - k)
            k = stop


def in_parts(of: Callable[..., pd.DataFrame], *columns: pd.Series, rows: int = 1000) -> pd.DataFrame:
    """of the columns in parts of at most so many rows, as one frame: as slices, for pandas UDFs."""
    parts = [of(*(c.iloc[k : k + rows] for c in columns)) for k in range(0, max(1, len(columns[0])), rows)]
    return pd.concat(parts, ignore_index=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, which the cluster names. Only where driver and executors are one process, as in tests, and it is unset, a folder of our own is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="silkmill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, stem: str) -> DataFrame:
    """df as a table written to the shared folder: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash; x is uint64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BLOB_SCHEMA = "part int, blob binary"


def scattered(records: np.ndarray, part: np.ndarray, n: int) -> pa.RecordBatch:
    """Fixed-width records as one row for each part: Spark then shuffles few large binary rows and not one row for each record."""
    order = np.argsort(part, kind="stable")
    records, part = records[order], part[order]
    ids, starts = np.unique(part, return_index=True)
    ends = np.append(starts[1:], len(part))
    raw = records.view(np.uint8).reshape(len(records), -1) if len(records) else np.zeros((0, 1), np.uint8)
    blobs = [raw[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])


def gathered(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[np.ndarray]:
    """The records of each part; a Spark partition may hold several parts, and each part lies in one partition."""
    have: dict[int, list[bytes]] = {}
    for b in batches:
        for p, x in zip(b.column("part").to_pylist(), b.column("blob").to_pylist(), strict=True):
            have.setdefault(p, []).append(x)
    for p in sorted(have):
        yield np.frombuffer(b"".join(have.pop(p)), dtype)


def by_part(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "part")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of n nodes, under edges (a, b): hooking of roots and shortening of paths."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        ok = x != y
        a, b, x, y = a[ok], b[ok], x[ok], y[ok]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def spanned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(node, root) of every node of some edges that isn't the root, the least id, of its component: as many edges as connect the same."""
    if not len(a):
        return np.zeros((0, 2), np.int64)
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = forest(at[: len(a)], at[len(a) :], len(ids))
    own = root != np.arange(len(ids))
    return np.stack([ids[own], ids[root[own]]], 1)


def pairs_of(own: np.ndarray, first: np.ndarray, count: np.ndarray, most: int = 250_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): each of own with the count places from first on, in blocks of about so many pairs."""
    ends = np.cumsum(count)
    at = 0
    while at < len(own):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        c = count[at:stop]
        i = np.repeat(own[at:stop], c)
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[at:stop], c)
        if len(i):
            yield i, j
        at = stop


def pairs_within(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of places within each run, in blocks."""
    own = np.repeat(start, size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
    yield from pairs_of(own, own + 1, np.repeat(start + size, size) - own - 1)


def runs_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, n))


BLOCK = 4096  # members of a group that are compared with as many at once


def blocks_of_groups(members: DataFrame, size: int = BLOCK) -> DataFrame:
    """members (root, id, ...) with root, lo, hi, mine in front: each group in blocks of about size members, and each member once for each block that its own meets. A group of any size is many small tasks."""
    counts = members.groupBy("root").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    m = members.join(counts, "root").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = [c for c in members.columns if c != "root"]
    return m.select("root", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", *rest)


def met(root: np.ndarray, lo: np.ndarray, hi: np.ndarray, mine: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places, sorted by (root, lo, hi, mine), that meet in a pair of blocks: within one block all, between two the first's with the second's."""
    start, size = runs_of(root, lo, hi)
    one = lo[start] == hi[start] if len(start) else np.zeros(0, bool)
    yield from pairs_within(start[one], size[one])
    start, size = start[~one], size[~one]
    if len(start):
        own = np.repeat(start, size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
        left = mine[own] == lo[own]
        lefts = np.add.reduceat(left.astype(np.int64), np.cumsum(size) - size)
        first, count = np.repeat(start + lefts, size), np.repeat(size - lefts, size)
        yield from pairs_of(own[left], first[left], count[left])


EDGES = "a bigint, b bigint"
SETTLED_AT_ONCE = 2_000_000  # edges, 16 bytes each, that one task connects; more go through rounds of joins


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as a spanning forest of them, in runs."""
    held: list[np.ndarray] = []
    count = 0
    for b in batches:
        held.append(np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1))
        count += len(b)
        if count > 4_000_000:
            x = np.concatenate(held)
            held = [spanned(x[:, 0], x[:, 1])]
            count = len(held[0])
    x = np.concatenate(held) if held else np.zeros((0, 2), np.int64)
    x = spanned(x[:, 0], x[:, 1])
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in (0, 1)], ["a", "b"])


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: bigint): (node, root), root the least id of the component. Without edges the result is empty.

    Each partition's edges shrink to a spanning forest. What is left is connected in one task where it is few edges, by their
    count; more go through alternating large-star and small-star rounds, each round's edges a written table, until they are few
    or settled. Rounds end: each but the last takes edges away or lowers an end of one.
    """
    e = written(edges.where("a <> b").mapInArrow(_spanning, EDGES), "edges")
    while (few := e.count()) > SETTLED_AT_ONCE:
        both = e.union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select("b", F.least("m", "a").alias("m")).where("b <> m").distinct().toDF("a", "b")
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a")
        new = written(small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b"), F.col("m"))).distinct(), "edges")
        done = new.count() == few and not new.exceptAll(e).take(1)
        e = new
        if done:
            break
    else:
        if few:
            e = written(e.coalesce(1).mapInArrow(_spanning, EDGES), "edges")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots).distinct()


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Coefficients (the last one the constant) of an L2 logistic regression by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    s = np.ones(len(y)) if weight is None else weight
    reg = np.full(a.shape[1], l2)
    reg[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (s * (p - y)) + reg * w
        h = (a * (s * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(reg)
        step = np.linalg.solve(h, g)
        norm = np.abs(step).max()
        w = w - step * min(1.0, 4.0 / max(norm, 1e-9))
        if norm < 1e-6:
            break
    return w


def linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


Query = Callable[[SparkSession, str], DataFrame]
