"""Toxicity by compression distance.

Three zstandard dictionaries are trained, each by the library's trainer. One of ordinary text as a whole holds what prose has in
common. Two are small, separate and of one class each: of stretches of ordinary text, and of stretches of toxic text, that are
new against the ordinary texts. The ordinary compressor has the ordinary class's dictionary and the common one behind it, the
toxic compressor the toxic class's and the common one, so that what both know costs both the same, in any language. A window's
gain is the number of bytes by which the toxic compressor is shorter. A stretch is new where fewer than two ordinary texts hold its
strings of five bytes; stretches are bytes, wherever words begin and end, and the trainer chooses among them by how they recur.

A gain has a weight, the logarithm of how much oftener windows of toxic documents have it than those of ordinary ones; a document
is toxic if the sum over its windows is at least a threshold. Weights and threshold are calibrated by cross-fitting: the labelled
documents are dealt into folds, and each fold is compressed with dictionaries trained on the others. Nothing is calibrated on a
text that its dictionaries have seen, and the dictionaries in use are those of all folds. Texts are fitted on and scored whole.

Defined results: a null text has a null score and is not toxic; an empty text scores 0 and is not toxic; a text of any length
is cut into windows at white space, and one without white space is one window; repeated rows are scored alike, each for itself;
equal labelled texts count once in fitting; a document labelled both ways counts in both classes; labels of null, or of documents
that aren't there, are left out of training; without toxic or without ordinary labels nothing is toxic. Ids may be of any
type. Ties in the choice of labelled documents are settled by the id. Columns of any name may stand beside those read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_parts, named

LEAST, MOST = -8, 12  # gains beyond these have the weight of these


@dataclass(frozen=True)
class Params:
    window: int = 64  # bytes, cut at white space
    train_per_class: int = 2000  # labelled documents of each class that are fitted on; the bound of what the driver gathers
    folds: int = 3
    level: int = 13
    min_match: int = 5
    false_cost: float = 5.0  # how many missed toxic documents one ordinary document taken for toxic is worth, in shares
    common_bytes: int = 110_000
    class_bytes: int = 3000
    segment: int = 24  # bytes that the trainer takes at a time for a class
    gram: int = 5  # bytes of the strings by which stretches are new
    known_from: int = 2  # ordinary texts that hold a string for it to be ordinary


@dataclass(frozen=True)
class Model:
    common: bytes
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]  # by bytes gained, from LEAST or less to MOST or more
    cutoff: float
    params: Params


@lru_cache(maxsize=8)
def compressors(model: Model) -> tuple:
    """The ordinary and the toxic compressor of a model, made once in a worker."""
    p = zstd.ZstdCompressionParameters.from_level(model.params.level, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=model.params.min_match, window_log=18, hash_log=17, chain_log=17)
    out = []
    for own in (model.ordinary, model.toxic):
        d = zstd.ZstdCompressionDict(model.common + own, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        out.append(zstd.ZstdCompressor(dict_data=d, compression_params=p))
    return tuple(out)


def lowered(text: str) -> bytes:
    return (" " + text.lower() + " ").encode("utf-8", "replace") if text else b""


def cuts(raw: bytes, window: int) -> np.ndarray:
    """Where windows begin, and the end: each is the first white space at or after a multiple of window."""
    n = len(raw)
    if n <= window:
        return np.array([0, n] if n else [0])
    a = np.frombuffer(raw, np.uint8)
    sp = np.flatnonzero((a == 32) | (a == 10))
    at = np.searchsorted(sp, np.arange(window, n, window))
    return np.unique(np.concatenate([[0], sp[at[at < len(sp)]], [n]]))


def window_gains(texts: list[str], model: Model, comp) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every text the bytes that the toxic dictionary saves, and the number of windows of each text."""
    raws = [lowered(t) for t in texts]
    spans = [cuts(r, model.params.window) for r in raws]
    counts = np.array([len(s) - 1 for s in spans])
    if not counts.sum():
        return np.zeros(0, int), counts
    base = np.concatenate([[0], np.cumsum([len(r) for r in raws])[:-1]])
    starts = np.concatenate([s[:-1] + b for s, b in zip(spans, base, strict=True)])
    lengths = np.concatenate([np.diff(s) for s in spans])
    buf = b"".join(raws)
    gain = np.zeros(len(starts), np.int64)
    step = 100_000
    for k in range(0, len(starts), step):
        s, n = starts[k : k + step], lengths[k : k + step]
        seg = np.stack([s, n], 1).astype(np.uint64).tobytes()
        sized = []
        for c in comp:
            r = c.multi_compress_to_buffer(zstd.BufferWithSegments(buf, seg), threads=1)
            sized.append(np.fromiter((len(r[i]) for i in range(len(r))), np.int64, len(r)))
        gain[k : k + step] = sized[0] - sized[1]
    return gain, counts


def gain_bins(gain: np.ndarray) -> np.ndarray:
    return np.clip(gain, LEAST, MOST) - LEAST


def decided(gain: np.ndarray, counts: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each text is toxic, its score, and the number of its windows that speak for it."""
    w = np.array(model.weights)[gain_bins(gain)]
    ends = np.cumsum(counts)
    sums, speak = (np.concatenate([[0.0], np.cumsum(x)]) for x in (w, w > 0))
    score = sums[ends] - sums[ends - counts] if len(counts) else np.zeros(0)
    return (score >= model.cutoff) & (counts > 0), score, (speak[ends] - speak[ends - counts]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def grams(raw: bytes, size: int) -> np.ndarray:
    """The string of so many bytes that begins at each place, as a number."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = len(a) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(size):
        out = out << np.uint64(8) | a[k : k + n] if n > 0 else out
    return out


def known_strings(texts: list[bytes], params: Params) -> np.ndarray:
    """The strings that at least params.known_from of the texts hold, in order."""
    g, n = np.unique(np.concatenate([np.unique(grams(t, params.gram)) for t in texts]), return_counts=True)
    return g[n >= params.known_from]


def stretches(raw: bytes, known: np.ndarray, params: Params) -> list[tuple[bytes, bytes]]:
    """Stretches of a text whose strings, three at least, are all new: with three bytes around, by which copies of one document show, and without."""
    g = grams(raw, params.gram)
    there = known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g if len(known) else np.zeros(len(g), bool)
    new = np.concatenate([[False], ~there, [False]])
    edge = np.flatnonzero(new[1:] != new[:-1])
    return [(raw[max(0, s - 3) : e + params.gram + 2], raw[s : e + params.gram - 1]) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if e - s >= 3]


def trained_dictionary(samples: list[bytes], size: int, k: int) -> bytes:
    """The content of a trained dictionary of at most size bytes; too few samples for the trainer are taken as they are."""
    packed, cur, held = [], [], 0
    for s in samples:
        cur.append(s)
        held += len(s)
        if held >= 64:
            packed.append(b"".join(cur))
            cur, held = [], 0
    if sum(map(len, packed)) > 4 * size:
        try:
            return zstd.train_dictionary(size + 1024, packed, k=k, d=6).as_bytes()[-size:]  # without its header
        except zstd.ZstdError:
            pass
    return b"".join(dict.fromkeys(samples))[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes], params: Params) -> Model:
    """A model of the dictionaries alone."""
    pieces = [r[a:b] for r in ordinary for c in (cuts(r, params.window).tolist(),) for a, b in zip(c, c[1:], strict=False)]
    known = known_strings(ordinary, params)
    own = [list(dict(x for r in texts for x in stretches(r, known, params)).values()) for texts in (ordinary, toxic)]
    return Model(trained_dictionary(pieces, params.common_bytes, 24), *(trained_dictionary(s, params.class_bytes, params.segment) or b" " * 8 for s in own), (0.0,) * (MOST - LEAST + 1), 0.0, params)


def fit(toxic: list[str], ordinary: list[str], params: Params = Params()) -> Model:
    """Dictionaries of all texts; weights and threshold of each fold's gains under the dictionaries of the others."""
    t, o = (list(dict.fromkeys(x for x in texts if x)) for texts in (toxic, ordinary))
    if not t or not o:
        return Model(b" " * 8, b" " * 8, b" " * 8, (0.0,) * (MOST - LEAST + 1), float("inf"), params)
    t_raw, o_raw = [lowered(x) for x in t], [lowered(x) for x in o]
    whole = dictionaries(t_raw, o_raw, params)
    folds = min(params.folds, len(t), len(o))
    if folds < 2:
        return replace(whole, cutoff=float("inf"))
    gains, counts = ([[], []] for _ in range(2))
    for f in range(folds):
        rest = dictionaries([x for i, x in enumerate(t_raw) if i % folds != f], [x for i, x in enumerate(o_raw) if i % folds != f], params)
        for kind, texts in enumerate((o, t)):
            g, n = window_gains(texts[f::folds], rest, compressors(rest))
            gains[kind].append(g)
            counts[kind].append(n)
    gains, counts = [np.concatenate(x) for x in gains], [np.concatenate(x) for x in counts]
    have = [np.bincount(gain_bins(g), minlength=MOST - LEAST + 1) + 0.5 for g in gains]
    weights = np.log(have[1] / have[1].sum()) - np.log(have[0] / have[0].sum())
    model = replace(whole, weights=tuple(weights.tolist()))
    so, st = (decided(g, n, model)[1] for g, n in zip(gains, counts, strict=True))
    at = np.unique(np.concatenate([st, so]))
    best = max(at.tolist(), key=lambda c: ((st >= c).mean() - params.false_cost * (so >= c).mean(), c))
    below = at[at < best]
    return replace(model, cutoff=float((best + below[-1]) / 2 if len(below) else best))


def train(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on the whole texts of at most params.train_per_class labelled documents of each class, taken by the hash of their ids."""
    lab = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__y")).where("__id is not null and __y in (0, 1)").distinct()
    parts = [lab.where(f"__y = {y}").orderBy(F.xxhash64("__id"), "__id").limit(params.train_per_class) for y in (1, 0)]
    chosen = parts[0].union(parts[1])
    d = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).where("__t is not null and __id is not null")
    rows = d.join(F.broadcast(chosen), "__id").orderBy(F.xxhash64("__id"), "__id", "__t").collect()
    return fit([r["__t"] for r in rows if r["__y"] == 1], [r["__t"] for r in rows if r["__y"] == 0], params)


def scorer(model: Model):
    def of(texts: pd.Series) -> pd.DataFrame:
        comp = compressors(model)
        null = texts.isna().to_numpy()
        gain, counts = window_gains([t if isinstance(t, str) else "" for t in texts], model, comp)
        toxic, total, speak = decided(gain, counts, model)
        return pd.DataFrame({"score": np.where(null, np.nan, total), "windows": counts, "toxic_windows": speak, "toxic": toxic & ~null})

    @F.pandas_udf("score double, windows bigint, toxic_windows bigint, toxic boolean")
    def score(texts: pd.Series) -> pd.DataFrame:
        return in_parts(of, texts)

    return score


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, Column]:
    name = fresh(docs, "__toxicity")
    return docs.withColumn(name, scorer(model)(F.col(text_col))), F.col(name)


def toxicity(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, score (sum of the windows' weights), windows, toxic_windows, toxic for each row of docs."""
    model = train(docs, labels, params)
    d = docs.select(F.col("doc_id"), scorer(model)(F.col("text")).alias("s"))
    return d.select("doc_id", F.when(~F.isnan("s.score"), F.col("s.score")).alias("score"), "s.windows", "s.toxic_windows", "s.toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """docs without the rows that are toxic; all columns stay as they are."""
    d, s = scored(docs, train(docs, labels, params))
    return d.where(~s["toxic"]).select(*named(*docs.columns))
