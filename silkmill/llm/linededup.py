"""Line dedup: exact copies by hash, and near copies by a segment-partition edit join.

Every line that isn't blank is split into threshold + 1 segments, each a key together with its number and the line's length.
A line looks up, for its own and each smaller length within the threshold, the substrings that such a line's segments can
equal within the threshold (the multi-match-aware windows), so that no pair within the threshold is missed. Of lines of one
length each pair is looked up one way round only: equal segments at one place are one key, and shifts go forward. Pairs under one
key whose character-parity sketches differ in more bits than the edits allow are left out; the rest are verified by a
banded bit-parallel edit distance. A line goes if an earlier line, by (doc_id, line number), is equal to it or within
the threshold. One pass over the documents makes the keys and the lines' places, which are sorted by hash for exact copies; a
second reads only documents that hold the first of a candidate line. The threshold grows with length: 0 under 12 characters, 1 under 24, then 2; a pair has that of its shorter line.

Defined results: null texts, blank lines (of white space of any kind: a CRLF text's empty lines too) and rows whose doc_id isn't a
whole number are left as they are. A carriage return at a line's end belongs to the break and is not compared. Rows that repeat a
doc_id and a text are one document and treated alike; rows of one doc_id and different texts are documents of their own, in the
order of a hash of the text where doc_id and line number are equal. Lines of any length are compared whole. A document whose lines
that aren't blank all go goes as a whole. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOB_SCHEMA, fresh, mix, named, pairs_of, partitions, runs_of, scattered, text_slices, whole_id, written

RECORD = np.dtype([("key", "<u4"), ("sketch", "<u4"), ("hash", "<i8")])
PLACE = np.dtype([("h", "<i8"), ("g", "<i8"), ("doc", "<i8"), ("text", "<i8"), ("line", "<i4")])
PROBE = np.uint32(1)  # lowest bit of the key: a probe, and not an index row
MET = "what int, a bigint, b bigint, doc_id bigint, text_hash bigint, line_no int, kept_doc_id bigint, kept_line_no int"
PAIR, FIRST, EXACT = range(3)  # what: a and b may be near copies; the first place of a line of hash a; a place that isn't the first of its line
BROADCAST_ROWS = 1_000_000  # hashes, 8 bytes each; more are joined by a shuffle
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    one_from: int = 12
    two_from: int = 24


def threshold(length: np.ndarray, params: Params) -> np.ndarray:
    return (length >= params.one_from).astype(np.int64) + (length >= params.two_from)


def windows(tau: int) -> list[tuple[int, int, int]]:
    """(delta, segment, shift): the substring at a segment's place plus shift is looked up among lines shorter by delta.

    Of two lines of one length, the one's segment that lies further on in the other lies further back the other way round: one way
    is enough. Segments at the same place need no probe, as their index rows have one key.
    """
    out = []
    for delta in range(tau + 1):
        for i in range(tau + 1):
            low, high = max(-i, delta - (tau - i)), min(i, delta + (tau - i))
            out += [(delta, i, s) for s in range(low if delta else 1, high + 1)]
    return out


def code_points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    cp = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.fromiter(map(len, lines), np.int64, len(lines))


def powers(n: int, _have: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of the base and of its inverse."""
    if len(_have.get("p", ())) < n:
        m = max(n, 1 << 16)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        one = np.ones(1, np.uint64)
        _have["p"] = np.concatenate([one, np.cumprod(np.full(m, BASE))])
        _have["q"] = np.concatenate([one, np.cumprod(np.full(m, inverse))])
    return _have["p"], _have["q"]


def keyed(lines: list[str], hashes: np.ndarray, params: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """Index and probe records of lines, and the whole 64-bit keys."""
    cp, n = code_points(lines)
    start = np.cumsum(n) - n
    total = len(cp)
    p, q = powers(total + 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(mix(cp.astype(np.uint64) + np.uint64(1)) * p[:total])])
    bits = np.uint32(1) << (cp % 31).astype(np.uint32)
    sketch = np.bitwise_xor.reduceat(np.append(bits, np.uint32(0)), start) if len(n) else np.zeros(0, np.uint32)
    tau_of = threshold(n, params)
    out, keys = [], []

    def add(rows: np.ndarray, at: np.ndarray, size: np.ndarray, seg: int, length: np.ndarray, tau: int, index: bool) -> None:
        s = start[rows] + at
        with np.errstate(over="ignore"):
            h = (prefix[s + size] - prefix[s]) * q[s]
            h = mix(h ^ mix(length.astype(np.uint64) * np.uint64(64) + np.uint64(seg * 4 + tau)))
        r = np.empty(len(rows), RECORD)
        r["key"] = (h.astype(np.uint32) & ~PROBE) | (np.uint32(0) if index else PROBE)
        r["sketch"], r["hash"] = sketch[rows], hashes[rows]
        out.append(r)
        keys.append(h >> np.uint64(32))

    def place(length: np.ndarray, i: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
        """Where segment i of lines of such lengths lies: the last ones take what is left over."""
        short, longer = length // (tau + 1), length % (tau + 1)
        at = i * short + np.maximum(0, i - (tau + 1 - longer))
        return at, short + (i >= tau + 1 - longer)

    for tau in (1, 2):
        rows = np.flatnonzero(tau_of == tau)
        for i in range(tau + 1):
            at, size = place(n[rows], i, tau)
            add(rows, at, size, i, n[rows], tau, True)
        near = np.flatnonzero(tau_of >= tau)
        for delta, i, shift in windows(tau):
            rows = near[(n[near] - delta >= 0)]
            rows = rows[tau_of[rows] if delta == 0 else threshold(n[rows] - delta, params) == tau] if delta else rows[tau_of[rows] == tau]
            at, size = place(n[rows] - delta, i, tau)
            at = at + shift
            ok = (at >= 0) & (at + size <= n[rows])
            add(rows[ok], at[ok], size[ok], i, n[rows[ok]] - delta, tau, False)
    return np.concatenate(out), np.concatenate(keys)


def candidates(r: np.ndarray, most_bits: int = 4) -> np.ndarray:
    """Pairs of hashes (less, greater) of the records of one part that share a key, one of them an index row, and whose sketches are near."""
    found = [np.zeros((0, 2), np.int64)]
    order = np.sort(r["key"].astype(np.uint64) << np.uint64(32) | np.arange(len(r), dtype=np.uint64))
    key, order = (order >> np.uint64(32)).astype(np.uint32), (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start, size = runs_of(key | PROBE)
    some = np.repeat((size > 1) & (key[start] & PROBE == 0), size)  # most keys have one row, or no index row
    key, order = key[some], order[some]
    again = np.lexsort((r["hash"][order], key))
    key, order = key[again], order[again]
    once = np.append(True, (key[1:] != key[:-1]) | (r["hash"][order[1:]] != r["hash"][order[:-1]]))[: len(key)]
    key, x = key[once], r[order[once]]
    hashes, sketch = np.ascontiguousarray(x["hash"]), np.ascontiguousarray(x["sketch"])
    start, size = runs_of(key | PROBE)  # index rows come first
    rows = np.add.reduceat((key & PROBE == 0).astype(np.int64), start) if len(start) else size
    at = np.arange(len(key))
    for j, i in pairs_of(at, np.repeat(start, size), np.minimum(at - np.repeat(start, size), np.repeat(rows, size))):
        ok = (np.bitwise_count(sketch[i] ^ sketch[j]) <= most_bits) & (hashes[i] != hashes[j])
        if ok.any():
            found.append(np.unique(np.sort(np.stack([hashes[i[ok]], hashes[j[ok]]], 1), axis=1), axis=0))
    return np.unique(np.concatenate(found), axis=0)


def placed(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the places of one part, each once: the first of each line, those that aren't, and the first of the line of each of those."""
    r = r[np.lexsort((r["text"], r["line"], r["doc"], r["g"], r["h"]))]
    same = np.ones((2, max(0, len(r) - 1)), bool)
    for k, columns in enumerate((("h", "g"), ("doc", "line", "text"))):
        for c in columns:
            same[k] &= r[c][1:] == r[c][:-1]
    first = np.append(True, ~same[0])[: len(r)]
    of = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
    later = np.flatnonzero(~first & ~np.append(False, same.all(0))[: len(r)])
    return r[first], r[later], r[of[later]]


def edit_distances(a: list[str], b: list[str], most: int) -> np.ndarray:
    """Edit distance of each pair, or most + 1 if it is more: bit-parallel in a band of 2 * most + 1 diagonals, all pairs at once."""
    n = len(a)
    out = np.full(n, most + 1, np.int64)
    swap = [len(x) < len(y) for x, y in zip(a, b, strict=True)]
    long_, short = [y if s else x for x, y, s in zip(a, b, swap, strict=True)], [x if s else y for x, y, s in zip(a, b, swap, strict=True)]
    n1, n2 = np.fromiter(map(len, long_), np.int64, n), np.fromiter(map(len, short), np.int64, n)
    tiny = np.flatnonzero(n1 <= 2 * most)  # as narrow as the band
    out[tiny] = [min(most + 1, _whole(long_[i], short[i])) for i in tiny]
    rows = np.flatnonzero((n1 - n2 <= most) & (n1 > 2 * most))
    rows = rows[np.argsort(n1[rows], kind="stable")]
    k = 0
    while k < len(rows):  # as many pairs at once as keep the arrays small
        part = rows[k : k + 4096]
        part = part[: max(1, int(np.searchsorted(n1[part] * np.arange(1, len(part) + 1), 1_000_000, "right")))]
        out[part] = _band([long_[i] for i in part], [short[i] for i in part], n1[part], n2[part], most)
        k += len(part)
    return out


def _whole(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def _band(a: list[str], b: list[str], n1: np.ndarray, n2: np.ndarray, most: int) -> np.ndarray:
    width = int(n1.max(initial=0))
    pad = 2 * most + 2
    m1 = np.zeros((len(a), width + 2 * pad), np.uint32)
    m2 = np.zeros((len(a), width + 1), np.uint32)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        m1[i, pad : pad + len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
        m2[i, : len(y)] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    m1, m2 = np.ascontiguousarray(m1.T), np.ascontiguousarray(m2.T)
    # bit 2 * most of the band is row i + most of the matrix in column i; bit most is the main diagonal
    top = 2 * most
    full = np.uint64((1 << (top + 1)) - 1)
    vp = np.full(len(a), ((1 << (most + 1)) - 1) << most, np.uint64)
    vn = np.zeros(len(a), np.uint64)
    dist = np.full(len(a), most, np.int64)
    one = np.uint64(1)
    for i in range(int(n2.max(initial=0))):
        eq = np.zeros(len(a), np.uint64)
        c = m2[i]
        for k in range(top + 1):
            eq |= ((m1[pad + i + k - most] == c) & (c > 0)).astype(np.uint64) << np.uint64(k)
        with np.errstate(over="ignore"):
            d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        live = i < n2
        down = i < n1 - most  # the last row of the matrix is not in the band yet: along the lowest diagonal
        at = np.maximum(top - 1 - (i - (n1 - most)), 0).astype(np.uint64)
        dist += np.where(live & down, ((d0 >> np.uint64(top)) & one ^ one).astype(np.int64), 0)
        dist += np.where(live & ~down, ((hp >> at) & one).astype(np.int64) - ((hn >> at) & one).astype(np.int64), 0)
        x = d0 >> one
        vp = (hn | ~(x | hp)) & full
        vn = x & hp
    return np.minimum(dist, most + 1)


SOLID = r"(?U)\S"  # a character that isn't white space


def solid(c: str):
    """Whether a text has such a character: most lines begin with a printable one of ASCII, and the expression needn't be tried."""
    return F.ascii(c).between(33, 126) | F.col(c).rlike(SOLID)


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, line of the lines that aren't blank."""
    d = docs.select(whole_id("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.split(F.col("text"), "\n").alias("l")).where("doc_id is not null and l is not null")
    return d.select("doc_id", "text_hash", F.posexplode("l").alias("line_no", "line")).where(solid("line")).withColumn("line", F.rtrim("line", F.lit("\r")))


def key_batches(batches: Iterator[pa.RecordBatch], n: int, params: Params = Params()) -> Iterator[pa.RecordBatch]:
    """The records of batches of lines and their hashes, by part of n. Keys take some 40 bytes a character, so that text and not only lines are bounded."""
    for b in text_slices(batches, 0):
        r, key = keyed(b.column(0).to_pylist(), b.column(1).to_numpy(), params)
        yield scattered(r, (key % np.uint64(n)).astype(np.uint16 if n <= 1 << 16 else np.int64), n)  # sixteen bits are sorted by radix


def met(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """What comes of all lines by their keys and hashes, in one pass over the documents: pairs that may be near copies, each line's first place, and all other places. Parts from n on are of places."""
    n = partitions(docs.sparkSession)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from key_batches(iter([b]), n, params)
            r = np.empty(len(b), PLACE)
            for k, c in enumerate(PLACE.names):
                r[c] = b.column(k + 1).to_numpy()
            yield scattered(r, n + r["h"] % n, n)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, list[bytes]] = {}
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                have.setdefault(p, []).append(x)
        for p in sorted(have):
            raw = b"".join(have.pop(p))
            if p < n:
                c = candidates(np.frombuffer(raw, RECORD))
                yield met_batch(PAIR, len(c), a=c[:, 0], b=c[:, 1])
            else:
                first, later, of = placed(np.frombuffer(raw, PLACE))
                yield met_batch(FIRST, len(first), a=first["h"], doc_id=first["doc"], text_hash=first["text"], line_no=first["line"])
                yield met_batch(EXACT, len(later), doc_id=later["doc"], text_hash=later["text"], line_no=later["line"], kept_doc_id=of["doc"], kept_line_no=of["line"])

    lines = line_table(docs).select("line", F.xxhash64("line").alias("h"), F.xxhash64(F.reverse("line")).alias("g"), "doc_id", "text_hash", "line_no")
    return lines.mapInArrow(records, BLOB_SCHEMA).repartitionById(n, F.col("part") % n).mapInArrow(joined, MET)


def met_batch(what: int, rows: int, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows of MET with some of its columns."""
    columns = {"what": np.full(rows, what, np.int32)} | columns
    kinds = {c: pa.int64() if t == "bigint" else pa.int32() for c, t in (x.split() for x in MET.split(", "))}
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(columns[c]), t) if c in columns else pa.nulls(rows, t) for c, t in kinds.items()], list(kinds))


def dropped_lines(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, line_no, kept_doc_id, kept_line_no, kind (exact or near) for each line that goes; kept is an earlier line that it copies."""
    return dropped(docs, params).drop("text_hash").distinct()


def dropped(docs: DataFrame, params: Params) -> DataFrame:
    """As dropped_lines, and with the hash of the text that the line is of."""
    lines = written(met(docs, params), "lines")
    pairs = written(lines.where(F.col("what") == PAIR).select("a", "b").distinct(), "pairs")
    wanted = written(pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct(), "wanted")
    few = wanted.count() <= BROADCAST_ROWS  # the lines' texts then stay where they are but for those looked for
    hashes = F.broadcast(wanted) if few else wanted
    first = written(lines.where(F.col("what") == FIRST).select(F.col("a").alias("h"), "doc_id", "line_no", "text_hash").join(hashes, "h"), "first")
    held = docs
    if few:
        gid = fresh(docs, "__id")
        held = docs.join(F.broadcast(first.select(F.col("doc_id").alias(gid)).distinct()), whole_id("doc_id") == F.col(gid), "left_semi")
    texts = line_table(held).withColumn("h", F.xxhash64("line")).join(hashes, "h").groupBy("h").agg(F.min("line").alias("line"))
    texts = written(texts, "texts")

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        nx, ny = x.str.len().to_numpy(np.int64), y.str.len().to_numpy(np.int64)
        tau = threshold(np.minimum(nx, ny), params)
        return pd.Series(edit_distances(x.tolist(), y.tolist(), 2) <= tau) if len(x) else pd.Series([], dtype=bool)

    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").where(near("x", "y")).select("a", "b")
    f = first.groupBy("h").agg(F.min(F.struct("doc_id", "line_no", "text_hash")).alias("first"))
    sided = both.join(f.toDF("a", "fa"), "a").join(f.toDF("b", "fb"), "b")
    later = sided.select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("h"), F.least("fa", "fb").alias("of")).groupBy("h").agg(F.min("of").alias("of"))
    near_ones = first.join(later, "h").select("doc_id", "text_hash", "line_no", F.col("of.doc_id").alias("kept_doc_id"), F.col("of.line_no").alias("kept_line_no"), F.lit("near").alias("kind"))
    exact = lines.where(F.col("what") == EXACT).select("doc_id", "text_hash", "line_no", "kept_doc_id", "kept_line_no", F.lit("exact").alias("kind"))
    return exact.union(near_ones)


def without_copies(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """docs with the lines that go taken out of text, and n_chars as it then is; documents of which nothing is left go. The other columns stay as they are."""
    gone, gid, gtext = fresh(docs, "__lines"), fresh(docs, "__id"), fresh(docs, "__text")
    drops = dropped(docs, params).groupBy(F.col("doc_id").alias(gid), F.col("text_hash").alias(gtext)).agg(F.collect_set("line_no").alias(gone))
    j = docs.join(drops, (whole_id("doc_id") == F.col(gid)) & (F.xxhash64("text") == F.col(gtext)), "left")

    kept = F.transform(F.filter(F.transform(F.split(F.col("text"), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col(gone), s["i"])), lambda s: s["x"])
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(text.alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.length(text).cast(docs.schema[c].dataType)).alias(c))
        else:
            cols.append(named(c)[0])
    out = j.select(*cols, F.col(gone).isNotNull().alias(gone))
    return out.where(~F.col(gone) | F.col("text").rlike(SOLID)).select(*named(*docs.columns))
