"""Embedding near-duplicates by NN-descent.

Vectors are scaled to unit length and equal ones collapsed. A neighbour graph starts from random projections and is refined in
rounds: around every vector its neighbours, and those it is a neighbour of, are compared with each other, and each keeps its
nearest. Rounds go on until few lists change. A vector whose whole list is within the threshold is saturated, and more may be near
than its list holds: the lists of saturated vectors are made four times as long and refined in the same way, again and again
until none is saturated or longer lists no longer join groups. Edges of at least the threshold's cosine, by the vectors in full
precision, are kept, and connect vectors to groups. Recall is then audited against exact search for a sample of vectors; where it
is too low, all lists are doubled and refined again, and what is reached in the end is logged with its recall. The links of a
vector are counted over all pairs of its group, in blocks, so that no list has to hold them.

Rounds compare half-precision copies, which is what is shuffled; every round's graph is a written table. Each round raises the sum
of similarities, so that rounds end.

Defined results: null vectors, vectors with a null, NaN or infinite entry, of zero length or of another dimension than most (the
lesser of two as common), and rows whose id isn't a whole number are left out. Rows that repeat an id and a vector are one; an id
with several vectors has a row for each. Vectors of any length are read whole. Ties in a list go to the lesser id. An empty table
gives an empty result. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOB_SCHEMA, blocks_of_groups, by_part, connected, gathered, mix, pairs_within, partitions, runs_of, scattered, whole_id, written

SEED = 20240101
ERROR = 0.005  # by which a cosine of half-precision vectors may be off


@dataclass(frozen=True)
class Params:
    threshold: float = 0.95  # cosine from which vectors are near-duplicates
    neighbours: int = 8
    trees: int = 6  # random cells and orders in which neighbours start
    settled: float = 0.1  # share of list entries that change in the last round
    audit: int = 200  # vectors for which recall is measured
    least_recall: float = 0.9
    attempts: int = 4  # how often lists are doubled after an audit
    block: int = 8192  # vectors of a group that are compared with as many at once


EDGE = np.dtype([("a", "<i8"), ("b", "<i8"), ("sim", "<f4")])
SIMS = "a bigint, b bigint, sim float"


def _edges(o: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(o[c])) for c in EDGE.names], list(EDGE.names))


def _parts(x: np.ndarray, n: int) -> np.ndarray:
    return (mix(x.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _nearest(o: np.ndarray, k: int) -> np.ndarray:
    """Of each a, the k best of distinct b: what falls out here would fall out of its list."""
    if not len(o):
        return o
    o = o[np.lexsort((-o["sim"], o["b"], o["a"]))]
    o = o[np.append(True, (o["a"][1:] != o["a"][:-1]) | (o["b"][1:] != o["b"][:-1]))]
    o = o[np.lexsort((o["b"], -o["sim"], o["a"]))]
    new = np.append(True, o["a"][1:] != o["a"][:-1])
    return o[np.arange(len(o)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k]


def unit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, v and h (unit vectors as bytes, in full and in half precision) of the usable rows."""
    v = vectors.select(whole_id(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").take(1)
    dim = dims[0]["d"] if dims else 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([[np.nan if e is None else e for e in row] for row in b.column(1).to_pylist()], np.float64).reshape(-1, dim) if b.column(1).null_count or b.column(1).flatten().null_count else b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.sqrt((x * x).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            u = (x[ok] / norm[ok, None]).astype("<f4")
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array([r.tobytes() for r in u], pa.binary()), pa.array([r.tobytes() for r in u.astype("<f2")], pa.binary())], ["id", "v", "h"])

    return v.where(F.size("v") == dim).mapInArrow(each, "id bigint, v binary, h binary")


def starts(vectors: DataFrame, params: Params, dim: int) -> DataFrame:
    """First lists: along random projections, each vector's neighbours in a window of the sorted order of its cell."""
    n, k = partitions(vectors.sparkSession), params.neighbours
    axes = np.random.default_rng(SEED).normal(size=(params.trees * 9, dim)).astype(np.float32)
    rec = np.dtype([("at", "<i8"), ("id", "<i8"), ("o", "<f4"), ("h", "<f2", dim)])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            ids, h = b.column(0).to_numpy(), np.frombuffer(b"".join(b.column(1).to_pylist()), "<f2").reshape(len(b), dim)
            p = h.astype(np.float32) @ axes.T
            for t in range(params.trees):  # the signs along eight axes name a cell, the ninth orders within it
                r = np.empty(len(ids), rec)
                r["at"] = (p[:, 9 * t : 9 * t + 8] > 0) @ (1 << np.arange(8)) + 256 * t
                r["id"], r["o"], r["h"] = ids, p[:, 9 * t + 8], h
                yield scattered(r, _parts(r["at"], n), n)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in gathered(batches, rec):
            r = r[np.lexsort((r["id"], r["o"], r["at"]))]
            v = r["h"].astype(np.float32)
            out = []
            for s in range(1, k + 1):
                i = np.flatnonzero(r["at"][:-s] == r["at"][s:])
                sim = np.einsum("ij,ij->i", v[i], v[i + s])
                for x, y in ((i, i + s), (i + s, i)):
                    o = np.empty(len(i), EDGE)
                    o["a"], o["b"], o["sim"] = r["id"][x], r["id"][y], sim
                    out.append(o)
            yield _edges(_nearest(np.concatenate(out), k))

    return by_part(vectors.select("id", "h").mapInArrow(keyed, BLOB_SCHEMA), n).mapInArrow(joined, SIMS)


def best(edges: DataFrame, k: int) -> DataFrame:
    """Each a's nearest: a, b, sim, worst (-2 while the list isn't full)."""
    n = partitions(edges.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = np.empty(len(b), EDGE)
            for i, c in enumerate(EDGE.names):
                r[c] = b.column(i).to_numpy(zero_copy_only=False)
            r = _nearest(r, k)
            yield scattered(r, _parts(r["a"], n), n)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in gathered(batches, EDGE):
            r = _nearest(r, k)
            if len(r):
                at = np.flatnonzero(np.append(True, r["a"][1:] != r["a"][:-1]))
                size = np.diff(np.append(at, len(r)))
                worst = np.where(size == k, r["sim"][at + size - 1], np.float32(-2)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*_edges(r).columns, pa.array(np.repeat(worst, size))], ["a", "b", "sim", "worst"])

    return by_part(edges.select("a", "b", "sim").mapInArrow(keyed, BLOB_SCHEMA), n).mapInArrow(joined, SIMS + ", worst float")


def around(graph: DataFrame, vectors: DataFrame, k: int, dim: int, others: float = -2.0) -> DataFrame:
    """Pairs among each vector's neighbours and those it is a neighbour of, where either gains. others: what vectors without a list have for its last similarity; 2 if they are to gain nothing."""
    n = partitions(graph.sparkSession)
    rec = np.dtype([("at", "<i8"), ("id", "<i8"), ("worst", "<f4"), ("h", "<f2", dim)])
    lists = graph.groupBy("a").agg(F.first("worst").alias("worst"))
    own = vectors.select("id", "h").join(lists, vectors["id"] == lists["a"], "left").select("id", "h", F.coalesce("worst", F.lit(others)).cast("float").alias("worst"))
    member = graph.select(F.col("a").alias("at"), F.col("b").alias("id")).union(graph.select(F.col("b").alias("at"), F.col("a").alias("id"))).distinct()
    rows = member.join(own, "id").select("at", "id", "worst", "h")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            r = np.empty(len(b), rec)
            for i, c in enumerate(("at", "id", "worst")):
                r[c] = b.column(i).to_numpy(zero_copy_only=False)
            r["h"] = np.frombuffer(b"".join(b.column(3).to_pylist()), "<f2").reshape(len(b), dim)
            yield scattered(r, _parts(r["at"], n), n)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in gathered(batches, rec):
            if not len(r):
                continue
            r = r[np.argsort(r["at"], kind="stable")]
            v = r["h"].astype(np.float32)
            at = np.flatnonzero(np.append(True, r["at"][1:] != r["at"][:-1]))
            out: list[np.ndarray] = []
            held = 0
            for s, e in zip(at, np.append(at[1:], len(r)), strict=True):
                ids, worst = r["id"][s:e], r["worst"][s:e]
                for t in range(0, e - s, 1024):  # a hub has many; in blocks
                    sim = v[s + t : min(e, s + t + 1024)] @ v[s:e].T
                    i, j = np.nonzero(sim > worst[t : t + 1024, None] + 1e-6)
                    i, j, q = i[i + t != j] + t, j[i + t != j], sim[i, j][i + t != j]
                    o = np.empty(len(i), EDGE)
                    o["a"], o["b"], o["sim"] = ids[i], ids[j], q
                    out.append(o)
                    held += len(o)
                    if held > 200_000:
                        yield _edges(_nearest(np.concatenate(out), k))
                        out, held = [], 0
            if out:
                yield _edges(_nearest(np.concatenate(out), k))

    return by_part(rows.mapInArrow(keyed, BLOB_SCHEMA), n).mapInArrow(joined, SIMS)


def refined(g: DataFrame, vectors: DataFrame, k: int, params: Params, dim: int, others: float = -2.0) -> DataFrame:
    """Rounds on a graph (a, b, sim, worst) until few list entries change."""
    while True:
        new = written(best(g.select("a", "b", "sim").union(around(g, vectors, k, dim, others)), k), "graph")
        total = new.count()
        changed = new.select("a", "b").join(g.select("a", "b"), ["a", "b"], "left_anti").count()
        g = new
        if changed <= params.settled * total:
            return g


def near_of(g: DataFrame, params: Params) -> DataFrame:
    return g.where(F.col("sim") >= params.threshold - ERROR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grouped(vectors: DataFrame, params: Params, dim: int) -> DataFrame:
    """(node, root) of the distinct unit vectors (id, v, h) that have a near-duplicate."""
    k = params.neighbours
    g = written(best(starts(vectors, params, dim), k), "graph")
    g = refined(g, vectors, k, params, dim)
    edges = written(verified(near_of(g, params), vectors, params, dim), "near")
    roots = written(connected(edges.select("a", "b")), "roots")
    while True:
        full = g.where(F.col("worst") >= params.threshold - ERROR)
        if not full.take(1):
            return roots
        k *= 4  # longer lists for the saturated vectors alone
        g = written(best(full.select("a", "b", "sim"), k), "graph")
        g = refined(g, vectors, k, params, dim, others=2.0)
        more = verified(near_of(g, params), vectors, params, dim)
        before = roots.agg(F.count("*"), F.count_distinct("root")).first()
        roots = written(connected(roots.toDF("a", "b").union(more.select("a", "b"))), "roots")
        if roots.agg(F.count("*"), F.count_distinct("root")).first() == before:
            return roots


def verified(near: DataFrame, vectors: DataFrame, params: Params, dim: int) -> DataFrame:
    """near with cosines of the vectors in full precision, those of at least the threshold."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<f4").reshape(len(b), dim) for i in (2, 3))
                o = np.empty(len(b), EDGE)
                o["a"], o["b"], o["sim"] = b.column(0).to_numpy(), b.column(1).to_numpy(), np.einsum("ij,ij->i", x, y)
                yield _edges(o[o["sim"] >= params.threshold])

    v = vectors.select("id", "v")
    j = near.select("a", "b").join(v.toDF("a", "x"), "a").join(v.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return j.mapInArrow(each, SIMS)


def audit(roots: DataFrame, vectors: DataFrame, params: Params) -> float:
    """The share of pairs of at least the threshold, by exact search for a sample of vectors, that are in one group; 1 where there are none."""
    head = vectors.take(1)
    if not head:
        return 1.0
    dim = len(head[0]["v"]) // 4
    some = vectors.join(roots, vectors["id"] == roots["node"], "left_semi").orderBy(F.xxhash64("id"), "id").limit(params.audit // 2)
    some = some.union(vectors.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(params.audit // 2)).dropDuplicates(["id"]).collect()
    ids, q = np.array([r["id"] for r in some]), np.frombuffer(b"".join(r["v"] for r in some), "<f4").reshape(-1, dim)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), "<f4").reshape(-1, dim)
                i, j = np.nonzero(q @ x.T >= params.threshold)
                other = b.column(0).to_numpy()[j]
                ok = ids[i] != other
                yield pa.RecordBatch.from_arrays([pa.array(ids[i][ok]), pa.array(other[ok])], ["a", "b"])

    true = vectors.select("id", "v").mapInArrow(each, "a bigint, b bigint")
    r = true.join(roots.toDF("a", "x"), "a", "left").join(roots.toDF("b", "y"), "b", "left").agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("k")).first()
    return r["k"] / r["n"] if r["n"] else 1.0


def link_counts(members: DataFrame, params: Params, dim: int) -> DataFrame:
    """id, links: of each vector (root, id, v) of a group the number of the group's others at the threshold's cosine or more, over all pairs."""
    n = partitions(members.sparkSession)
    rec = np.dtype([("root", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("mine", "<i4"), ("id", "<i8"), ("v", "<f4", dim)])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            r = np.empty(len(b), rec)
            for i, c in enumerate(("root", "lo", "hi", "mine", "id")):
                r[c] = b.column(i).to_numpy()
            r["v"] = np.frombuffer(b"".join(b.column(5).to_pylist()), "<f4").reshape(len(b), dim)
            with np.errstate(over="ignore"):
                h = r["root"].astype(np.uint64) + mix(r["lo"].astype(np.uint64) * np.uint64(1_000_003) + r["hi"].astype(np.uint64))
            yield scattered(r, _parts(h, n), n)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in gathered(batches, rec):
            r = r[np.lexsort((r["id"], r["mine"], r["hi"], r["lo"], r["root"]))]
            v, mine = np.ascontiguousarray(r["v"]), r["mine"]
            count = np.zeros(len(r), np.int64)
            start, size = runs_of(r["root"], r["lo"], r["hi"])
            one = r["lo"][start] == r["hi"][start] if len(start) else np.zeros(0, bool)
            small = one & (size <= 32)
            for i, j in pairs_within(start[small], size[small]):
                ok = np.einsum("ij,ij->i", v[i], v[j]) >= params.threshold
                count += np.bincount(i[ok], minlength=len(r)) + np.bincount(j[ok], minlength=len(r))
            for s, m, same in zip(start[~small], size[~small], one[~small], strict=True):
                cut = s + m if same else s + int((mine[s : s + m] == r["lo"][s]).sum())
                for t in range(s, cut, 1024):
                    rows = slice(t, min(cut, t + 1024))
                    near = v[rows] @ v[s if same else cut : s + m].T >= params.threshold
                    count[rows] += near.sum(1)
                    if not same:
                        count[cut : s + m] += near.sum(0)
                if same:  # each with itself
                    count[s : s + m] -= np.einsum("ij,ij->i", v[s : s + m], v[s : s + m]) >= params.threshold
            some = count > 0
            yield pa.RecordBatch.from_arrays([pa.array(r["id"][some]), pa.array(count[some])], ["id", "links"])

    m = blocks_of_groups(members.select("root", "id", "v"), params.block)
    return by_part(m.mapInArrow(keyed, BLOB_SCHEMA), n).mapInArrow(joined, "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, params: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, group_id, links, copies for each usable vector: the least id of its group, the number of other vectors that are near-duplicates of its own, and of ids that share its own."""
    u = written(unit(vectors, id_col, vec_col).distinct(), "unit")
    one = written(u.groupBy("v").agg(F.min("id").alias("first"), F.first("h").alias("h"), F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()), "distinct")
    head = one.take(1)
    dim = len(head[0]["v"]) // 4 if head else 1
    for attempt in range(params.attempts):
        roots = grouped(one, params, dim)
        recall = audit(roots, one, params)
        if recall >= params.least_recall:
            break
        logging.getLogger(__name__).warning("attempt %d: audited recall %.3f", attempt + 1, recall)
        params = replace(params, neighbours=2 * params.neighbours, trees=2 * params.trees)
    near = one.join(roots.withColumnRenamed("node", "id"), "id")
    least = near.groupBy("root").agg(F.min("first").alias("group_id"))
    near = near.join(least, "root").join(link_counts(near, params, dim), "id", "left").select("id", "group_id", "links")
    c = one.join(near, "id", "left").select("v", F.coalesce("group_id", "first").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), "copies")
    return u.select(F.col("id").alias("vec_id"), "v").join(c, "v").drop("v")
