"""Best-fit packing by patterns.

Documents are cut into pieces of at most a bin's tokens. Piece lengths are rounded up to classes; patterns of few pieces that
fill a bin are enumerated over the classes, repeat counts are fitted to the histogram of classes by non-negative least
squares, and rounded down so that no class is overdrawn. What is left is packed best-fit decreasing by class, with repeated
bins counted and not walked. Only the histogram and the patterns come to the driver; their size depends on the number of
classes, not on that of documents. Pieces of a class are numbered in parallel, and a piece's number gives its bin.

Tokens are runs of characters that aren't white space. Defined results: null, empty and blank texts have no tokens and are not
packed; a document of more than bin_tokens tokens has several pieces, whole bins first, whatever its length; rows whose doc_id is
null are packed too, and repeated rows are packed each for itself. Pieces of one doc_id and number (of repeated rows) are
interchangeable: which of them has which place is open, and the rows of the result are the same. Other columns aren't read,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written


@dataclass(frozen=True)
class Params:
    bin_tokens: int = 2048
    step: int = 8  # tokens by which the classes of lengths differ
    slack: int = 1  # classes by which a pattern may fall short of a bin
    part_pieces: int = 1_000_000  # pieces, about, that are numbered in one task; a class of more has as many parts as that takes


def patterns(classes: np.ndarray, full: int, slack: int) -> list[tuple[int, ...]]:
    """Multisets of up to three classes, and of up to eight pieces where two classes repeat, that fill a bin but for the slack."""
    have = sorted(int(c) for c in classes)
    got: set[tuple[int, ...]] = set()
    inside = set(have)
    for k in (1, 2, 3):
        for head in combinations_with_replacement(have, k - 1):
            for gap in range(slack + 1):
                last = full - gap - sum(head)
                if last in inside and (not head or last >= head[-1]):
                    got.add((*head, last))
    for a in have:
        for i in range(2, 8):
            for gap in range(slack + 1):
                rest = full - gap - a * i
                for j in range(1, 9 - i):
                    if rest > 0 and rest % j == 0 and rest // j in inside:
                        got.add(tuple(sorted((a,) * i + (rest // j,) * j)))
    return sorted(got)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares by the active-set method."""
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max()))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[on] = -np.inf
        if not n or w.max() <= 1e-9 * scale:
            break
        on[int(np.argmax(w))] = True
        while True:
            s = np.zeros(n)
            s[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if s[on].min() > 0:
                break
            bad = on & (s <= 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(bad, x / np.where(x - s == 0, 1, x - s), np.inf).min()
            x = x + step * (s - x)
            on &= x > 1e-12
            x[~on] = 0
            if not on.any():
                s = np.zeros(n)
                break
        x = s
    return x


def plan(count: dict[int, int], full: int, slack: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; together they hold every piece of the histogram."""
    left = {c: k for c, k in count.items() if k}
    out = []
    if full in left:
        out.append(((full,), left.pop(full)))
    if left:
        classes = np.array(sorted(left))
        pats = patterns(classes, full, slack)
        if pats:
            at = {int(c): i for i, c in enumerate(classes)}
            a = np.zeros((len(classes), len(pats)))
            for j, p in enumerate(pats):
                for c in p:
                    a[at[c], j] += 1
            b = np.array([left[int(c)] for c in classes], float)
            scale = np.sqrt(np.maximum(b, 1.0))
            x = nnls(a / scale[:, None], b / scale)
            for j in np.argsort(-x):
                if x[j] <= 0:
                    break
                p = pats[j]
                k = min([int(np.floor(x[j] + 1e-6)), *(left[c] // p.count(c) for c in set(p))])
                if k > 0:
                    out.append((p, k))
                    for c in p:
                        left[c] -= k
    while left := {c: k for c, k in left.items() if k}:  # best-fit decreasing; each round uses up a class or halves it
        room, p = full, []
        taken: dict[int, int] = {}
        while fit := [c for c, k in left.items() if c <= room and taken.get(c, 0) < k]:
            c = max(fit)
            p.append(c)
            taken[c] = taken.get(c, 0) + 1
            room -= c
        k = min(left[c] // n for c, n in taken.items())
        out.append((tuple(sorted(p)), k))
        for c, n in taken.items():
            left[c] -= k * n
    return out


def ranges(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class: the first number of each run of pieces, the bin of that piece, and its place in the bin."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    at = 0
    for p, k in made:
        for slot, c in enumerate(sorted(p, reverse=True)):
            out.setdefault(c, []).append((used.get(c, 0), at, slot))
            used[c] = used.get(c, 0) + k
        at += k
    return {c: tuple(np.array(v, np.int64) for v in zip(*rows, strict=True)) for c, rows in out.items()}


def pieces(docs: DataFrame, params: Params) -> DataFrame:
    """doc_id, piece, first_token, tokens, class."""
    size = params.bin_tokens
    d = docs.select("doc_id", F.regexp_count(F.col("text"), F.lit("\\S+")).cast("bigint").alias("n")).where("n > 0")
    d = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {size}"))).alias("piece"))
    d = d.select("doc_id", "piece", (F.col("piece") * size).alias("first_token"), F.least(F.lit(size).cast("bigint"), F.col("n") - F.col("piece") * size).alias("tokens"))
    return d.withColumn("class", F.expr(f"cast((tokens + {params.step - 1}) div {params.step} as int)"))


def packed(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, piece, first_token, tokens, bin, slot for each piece of each document; no bin holds more than bin_tokens tokens."""
    if params.bin_tokens % params.step:
        raise ValueError("bin_tokens must be a multiple of step")
    p = written(pieces(docs, params), "pieces")
    total = {r["class"]: r["count"] for r in p.groupBy("class").count().collect()}
    parts = {c: -(-k // params.part_pieces) for c, k in total.items()}
    hot = [x for c, k in parts.items() if k > 1 for x in (F.lit(c), F.lit(k))]
    of_class = F.coalesce(F.create_map(*hot)[F.col("class")], F.lit(1)) if hot else F.lit(1)
    p = p.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), of_class).cast("int"))
    first: dict[int, np.ndarray] = {c: np.zeros(k, np.int64) for c, k in parts.items()}  # number of the first piece of each part
    if hot:
        for r in p.where(F.col("class").isin([c for c, k in parts.items() if k > 1])).groupBy("class", "salt").count().collect():
            first[r["class"]][r["salt"]] = r["count"]
        first = {c: np.cumsum(n) - n for c, n in first.items()}
    where = ranges(plan(total, params.bin_tokens // params.step, params.slack))

    @F.pandas_udf("bin bigint, slot int")
    def place(cls: pd.Series, salt: pd.Series, rank: pd.Series) -> pd.DataFrame:
        bins, slots = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int32)
        c, part, rank = cls.to_numpy(), salt.to_numpy(), rank.to_numpy()
        for k in np.unique(c):
            starts, at, slot = where[int(k)]
            rows = np.flatnonzero(c == k)
            number = rank[rows] - 1 + first[int(k)][part[rows]]
            j = np.searchsorted(starts, number, "right") - 1
            bins[rows], slots[rows] = at[j] + number - starts[j], slot[j]
        return pd.DataFrame({"bin": bins, "slot": slots})

    w = Window.partitionBy("class", "salt").orderBy("doc_id", "piece")
    out = p.withColumn("rank", F.row_number().over(w)).withColumn("at", place("class", "salt", "rank"))
    return out.select("doc_id", "piece", "first_token", "tokens", F.col("at.bin").alias("bin"), F.col("at.slot").alias("slot"))
