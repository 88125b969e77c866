"""SimHash near-duplicates: every pair of fingerprints within the distance.

A document's fingerprint has 184 bits, signs of random projections of its distinct words, each weighted by the logarithm of its
count. The bits are dealt into parts whose radii, one more each, sum to more than the distance, so that two fingerprints within
the distance are within the radius in one part. A part of radius r has 2^(r+1) - 1 masks (covering LSH, Pagh): each bit has a vector
of r + 1 bits, and a mask keeps the bits whose vector has an odd product with the mask's own. Any r vectors leave one that is
orthogonal to all, so some mask keeps none of up to r bits that differ: under it both have one key, and no pair is missed.

Distinct fingerprints go to tasks in pairs of blocks, and a task takes a share of the masks over its two blocks. Those under one key
are compared unless they are connected by then, so that a crowd of near copies costs little. Candidates are verified by the
distance of whole fingerprints, groups are connected components of all pairs within it. A group's links are then counted over all
pairs of its different fingerprints, in blocks. Nothing is capped; neither parts, blocks nor shares change a result.

Defined results: rows whose doc_id isn't a whole number or whose text is null, and texts without a word (empty ones too), are left
alone. Texts are read whole, whatever their length; one without white space is one word. Rows that repeat a doc_id and a text are
one document; rows of one doc_id and different texts are documents of their own. A group keeps the document of least doc_id and,
where that has several texts in the group, of least text hash. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOB_SCHEMA, blocks_of_groups, by_part, connected, forest, fresh, gathered, met, mix, named, pairs_of, pairs_within, partitions, runs_of, scattered, spanned, text_slices, whole_id, written

SEGMENTS, BITS = 8, 23
FINGERPRINT = SEGMENTS * BITS
_TABLE: list[np.ndarray] = []
RECORD = np.dtype([("key", "<u4"), ("id", "<i8"), ("a", "<u8"), ("b", "<u8"), ("c", "<u8")])


@dataclass(frozen=True)
class Params:
    distance: int = 28  # of the 184 bits, that near-duplicates have at most


# golay and near_codewords, and tied and edges_of below, are what keys were made of before; only tests use them.
def golay() -> np.ndarray:
    """Index of the codeword to which each 23-bit word decodes."""
    if not _TABLE:
        words = np.arange(4096, dtype=np.uint32)
        code = words << 11
        rest = code.copy()
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ np.uint32(0xC75 << (bit - 11)), rest)
        code |= rest
        one = np.uint32(1) << np.arange(23, dtype=np.uint32)
        errors = [0, *one, *(one[i] | one[j] for i in range(23) for j in range(i)), *(one[i] | one[j] | one[k] for i in range(23) for j in range(i) for k in range(j))]
        table = np.empty(1 << 23, np.uint16)
        for e in np.array(errors, np.uint32):
            table[code ^ e] = words
        _TABLE.append(table)
    return _TABLE[0]


def near_codewords(segments: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices near each 23-bit segment; where there is only one, the rest are -1."""
    t = golay()
    around = np.concatenate([[0], 1 << np.arange(23)]).astype(np.uint32)
    got = np.sort(t[segments[:, None] ^ around].astype(np.int32), axis=1)
    new = np.ones(got.shape, bool)
    new[:, 1:] = got[:, 1:] != got[:, :-1]
    out = np.full((len(got), 6), -1, np.int32)
    row, col = np.nonzero(new)
    out[row, (np.cumsum(new, 1) - 1)[row, col]] = got[row, col]
    return out


def fingerprints(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3) words of 64 bits that hold the fingerprint, and whether there is one."""
    vocabulary: dict[str, int] = {}
    docs = []
    for t in texts:
        c = Counter(re.findall(r"\w+", t.lower())) if isinstance(t, str) else {}
        docs.append((np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in c), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))))
    digest = b"".join(xxhash.xxh3_128_digest(w.encode("utf-8", "replace")) + xxhash.xxh64_digest(w.encode("utf-8", "replace"), 7) for w in vocabulary)
    signs = np.unpackbits(np.frombuffer(digest, np.uint8).reshape(-1, 24), axis=1).astype(np.int8) if vocabulary else np.zeros((0, 192), np.int8)
    bits = np.zeros((len(texts), 192), np.uint8)
    for i, (ids, n) in enumerate(docs):
        if len(ids):
            w = np.round(16 * np.log2(1 + n)).astype(np.float32)
            bits[i, :FINGERPRINT] = (2 * (w @ signs[ids].astype(np.float32)) > w.sum())[:FINGERPRINT]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8"), np.array([len(i) > 0 for i, _ in docs], bool)


def apart(r: dict[str, np.ndarray], i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(r[c][i] ^ r[c][j]).astype(np.int16) for c in "abc")


def tied(r: dict[str, np.ndarray], most: int) -> np.ndarray | None:
    """Edges that connect what is connected among the records of one large key, if a crowd of near copies is in it; otherwise None."""
    n = len(r["a"])
    every, root, free = np.arange(n), np.arange(n), np.ones(n, bool)
    edges: list[np.ndarray] = []

    def join(i: int, near: np.ndarray) -> None:
        old = np.unique(root[near])
        old = old[old != root[i]]
        if len(old):
            _, at = np.unique(root[near], return_index=True)
            to = near[at][root[near[at]] != root[i]]
            edges.append(np.stack([np.full(len(to), i), to], 1))
            root[np.isin(root, old)] = root[i]

    leaders = 0
    for i in range(n):
        if free[i]:
            near = every[apart(r, i, every) <= most]
            join(i, near)
            free[near] = False
            leaders += 1
            if leaders == 8 and free.sum() > 0.9 * n:
                return None
    size = np.bincount(root, minlength=n)
    if (size > 1).sum() > 1:  # a tie between members that aren't first in their clusters
        for i in np.flatnonzero(size[root] > 1):
            other = np.flatnonzero((root != root[i]) & (size[root] > 1))
            if len(other):
                near = other[apart(r, i, other) <= most]
                if len(near):
                    join(int(i), near)
            size = np.bincount(root, minlength=n)
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


CROWD = 512  # records under a key from which a crowd of near copies is looked for first


def edges_of(r: np.ndarray, most: int) -> np.ndarray:
    """Edges (a, b) that connect, key by key, the records of one part that are near."""
    r = r[np.lexsort((r["id"], r["key"]))]
    words = {c: np.ascontiguousarray(r[c]) for c in "abc"}
    ids = np.ascontiguousarray(r["id"])
    start, size = runs_of(r["key"])
    out, held = [np.zeros((0, 2), np.int64)], 0
    plain = size < CROWD
    for k in np.flatnonzero(~plain):
        part = slice(start[k], start[k] + size[k])
        e = tied({c: w[part] for c, w in words.items()}, most)
        if e is None:
            plain[k] = True
        elif len(e):
            out.append(ids[part][e])
    for i, j in pairs_within(start[plain], size[plain]):
        ok = apart(words, i, j) <= most
        if ok.any():
            out.append(np.stack([ids[i[ok]], ids[j[ok]]], 1))
            held += int(ok.sum())
            if held > 2_000_000:  # as a forest: copies meet under many keys
                e = np.concatenate(out)
                out, held = [spanned(e[:, 0], e[:, 1])], 0
    e = np.concatenate(out)
    return spanned(e[:, 0], e[:, 1])


def print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_hash and a, b, c of batches of doc_id, text_hash and text; those without words are left out. Text is bounded, as its words and their signs take more than it."""
    for b in text_slices(batches, 2, rows=2000):
        fp, ok = fingerprints(b.column(2).to_pylist())
        keep = pa.array(ok)
        f = fp[ok].view("<i8")
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(3))], ["doc_id", "text_hash", "a", "b", "c"])


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and a, b, c for each document that has words."""

    d = docs.select(whole_id("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("text")).where("doc_id is not null and text is not null")
    return d.mapInArrow(print_batches, "doc_id bigint, text_hash bigint, a bigint, b bigint, c bigint")


BLOCK = 1_000_000  # fingerprints; a task holds two blocks of 32 bytes each, and its keys
SHARES = 12  # of the masks, where there are no more than so many pairs of blocks
PARTS = 3  # four have a quarter of the masks, but keys of 23 bits in place of 31, which more strangers share


def covers(most: int, parts: int) -> list[tuple[np.ndarray, list[int]]]:
    """(bits, masks) of each part: two fingerprints that differ in at most so many bits agree under a mask of one part."""
    g = np.random.default_rng(184)
    dealt = np.array_split(g.permutation(FINGERPRINT), parts)
    out = []
    for k, at in enumerate(dealt):
        r = (most + 1 + k) // parts - 1
        if r >= 0:
            vectors = g.integers(0, 1 << (r + 1), len(at))
            odd = np.bitwise_count(np.arange(1, 1 << (r + 1))[:, None] & vectors) & 1
            out.append((at, [sum(1 << int(i) for i in np.flatnonzero(row)) for row in odd]))
    return out


def merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root, the least place of each place's component, after edges (i, j)."""
    ids, at = np.unique(np.concatenate([root[i], root[j]]), return_inverse=True)
    to = np.arange(len(root))
    to[ids] = ids[forest(at[: len(i)], at[len(i) :], len(ids))]
    return to[root]


def roots_of(words: dict[str, np.ndarray], most: int, parts: int, share: int = 0, shares: int = 1) -> np.ndarray:
    """The least place of the component of each fingerprint, under the pairs within the distance that a share of the masks finds; all shares find all."""
    n = len(words["a"])
    root, low = np.arange(n), np.uint64(max(1, n.bit_length()))
    number = 0
    for at, masks in covers(most, parts):
        value = np.zeros(n, np.uint64)
        for k, bit in enumerate(at.tolist()):
            value |= (words["abc"[bit >> 6]] >> np.uint64(bit & 63) & np.uint64(1)) << np.uint64(k)
        for mask in masks:
            number += 1
            if number % shares != share:
                continue
            key = (value & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15) >> low << low | np.arange(n, dtype=np.uint64)
            key.sort()
            place = (key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
            start, size = runs_of(key >> low)
            start, size = start[size > 1], size[size > 1]
            place = place[np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]
            run = np.repeat(np.arange(len(size)), size)
            big = (size >= CROWD)[run]
            for some, of, steps in ((place, run, 1), (place[big], run[big], 32)):  # neighbours first: a crowd is then one component or few, before components are compared
                for step in range(1, steps + 1):
                    i, j = some[:-step], some[step:]
                    new = (of[:-step] == of[step:]) & (root[i] != root[j])
                    i, j = i[new], j[new]
                    ok = apart(words, i, j) <= most
                    if ok.any():
                        root = merged(root, i[ok], j[ok])
            order = np.lexsort((root[place], run))
            place, run = place[order], run[order]
            start, size = runs_of(run, root[place])
            ends = np.append(np.flatnonzero(run[1:] != run[:-1]) + 1, len(run)) if len(run) else np.zeros(0, np.int64)
            end = np.repeat(start + size, size)  # of the own component, and of the run
            last = np.repeat(ends, np.diff(np.append(0, ends)))
            mine = np.flatnonzero(last > end)
            for p, q in pairs_of(mine, end[mine], (last - end)[mine]):
                i, j = place[p], place[q]
                ok = apart(words, i, j) <= most
                if ok.any():
                    root = merged(root, i[ok], j[ok])
    return root


def near_edges(prints: DataFrame, params: Params = Params()) -> DataFrame:
    """Edges (a, b) that connect the fingerprints of each group; prints: distinct ones, as id, a, b, c."""
    blocks = max(1, -(-prints.count() // BLOCK))
    pairs = [(i, j) for i in range(blocks) for j in range(i + 1, blocks)] or [(0, 0)]  # a block's own pairs are found where it meets another
    shares = max(1, -(-SHARES // len(pairs)))
    rec = np.dtype([("id", "<i8"), ("a", "<u8"), ("b", "<u8"), ("c", "<u8")])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = np.empty(len(b), rec)
            for k, c in enumerate(rec.names):
                r[c] = b.column(k).to_numpy().view("<i8" if c == "id" else "<u8")
            mine = mix(r["id"].astype(np.uint64)) % np.uint64(blocks)
            for k, (i, j) in enumerate(pairs):
                blob = r[(mine == i) | (mine == j)].tobytes()
                if blob:
                    yield pa.RecordBatch.from_arrays([pa.array(range(k * shares, (k + 1) * shares), pa.int32()), pa.array([blob] * shares, pa.binary())], ["part", "blob"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        share = 0
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist(), strict=True):
                share = part % shares
                blobs.append(blob)
        if blobs:
            r = np.frombuffer(b"".join(blobs), rec)
            blobs.clear()
            root = roots_of({c: np.ascontiguousarray(r[c]) for c in "abc"}, params.distance, PARTS, share, shares)
            own = root != np.arange(len(r))
            yield pa.RecordBatch.from_arrays([pa.array(r["id"][own]), pa.array(r["id"][root[own]])], ["a", "b"])

    blobs = prints.select("id", "a", "b", "c").mapInArrow(keyed, BLOB_SCHEMA)
    return blobs.repartitionById(len(pairs) * shares, "part").mapInArrow(joined, "a bigint, b bigint")


def link_counts(members: DataFrame, params: Params = Params()) -> DataFrame:
    """id, links: of each fingerprint (root, id, a, b, c) of a group the number of the group's others within the distance, over all pairs."""
    n = partitions(members.sparkSession)
    rec = np.dtype([("root", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("mine", "<i4"), ("id", "<i8"), ("a", "<u8"), ("b", "<u8"), ("c", "<u8")])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = np.empty(len(b), rec)
            for i, c in enumerate(rec.names):
                r[c] = b.column(i).to_numpy().view("<u8") if c in "abc" else b.column(i).to_numpy()
            with np.errstate(over="ignore"):
                h = mix(r["root"].astype(np.uint64) + mix(r["lo"].astype(np.uint64) * np.uint64(1_000_003) + r["hi"].astype(np.uint64)))
            yield scattered(r, (h % np.uint64(n)).astype(np.int64), n)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in gathered(batches, rec):
            r = r[np.lexsort((r["id"], r["mine"], r["hi"], r["lo"], r["root"]))]
            words = {c: np.ascontiguousarray(r[c]) for c in "abc"}
            count = np.zeros(len(r), np.int64)
            for i, j in met(r["root"], r["lo"], r["hi"], r["mine"]):
                ok = apart(words, i, j) <= params.distance
                count += np.bincount(i[ok], minlength=len(r)) + np.bincount(j[ok], minlength=len(r))
            some = count > 0
            yield pa.RecordBatch.from_arrays([pa.array(r["id"][some]), pa.array(count[some])], ["id", "links"])

    return by_part(blocks_of_groups(members).mapInArrow(keyed, BLOB_SCHEMA), n).mapInArrow(joined, "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("links"))


def classes(docs: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(prints, distinct): the documents' fingerprints, and each distinct one with its id, least document, number of documents, and the root of its group where it has one."""
    prints = written(fingerprint_table(docs), "prints")
    one = prints.groupBy("a", "b", "c").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count_distinct("doc_id", "text_hash").alias("copies"))
    one = written(one.withColumn("id", F.monotonically_increasing_id()), "distinct")
    roots = connected(near_edges(one, params))
    return prints, written(one.join(roots.withColumnRenamed("node", "id"), "id", "left"), "classes")


def groups(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, group_id, links, copies for each document that has words: the least doc_id of its group, the number of the group's other fingerprints within the distance of its own, and of documents that share its own."""
    prints, one = classes(docs, params)
    grouped = one.where("root is not null")
    least = grouped.groupBy("root").agg(F.min("first.doc_id").alias("group_id"))
    one = one.join(least, "root", "left").join(link_counts(grouped.select("root", "id", "a", "b", "c"), params), "id", "left")
    one = one.select("a", "b", "c", F.coalesce("group_id", "first.doc_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), "copies")
    return prints.select("doc_id", "text_hash", "a", "b", "c").distinct().join(one, ["a", "b", "c"]).select("doc_id", "group_id", "links", "copies")


def one_of_each(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """docs with one document of each group, the one of least doc_id; all columns stay as they are."""
    prints, one = classes(docs, params)
    best = one.where("root is not null").groupBy("root").agg(F.min("first").alias("best"))
    kept = one.join(best, "root", "left").select("a", "b", "c", F.coalesce("best", "first").alias("kept"))
    gone, text = fresh(docs, "__gone"), fresh(docs, "__hash")
    key = prints.select("doc_id", "text_hash", "a", "b", "c")
    lost = key.join(kept, ["a", "b", "c"]).where("struct(doc_id, text_hash) <> kept").select(F.col("doc_id").alias(gone), F.col("text_hash").alias(text)).distinct()
    same = (whole_id("doc_id") == F.col(gone)) & (F.xxhash64("text") == F.col(text))
    left = docs.join(lost, same, "left_anti")
    again = written(prints.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias(gone), F.col("text_hash").alias(text)), "again")
    if not again.take(1):
        return left
    once = left.join(again, same).dropDuplicates([gone, text]).select(*named(*docs.columns))  # rows that repeat a document
    return left.join(again, same, "left_anti").unionByName(once)
