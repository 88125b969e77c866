"""Quality classifier by co-training.

Two views of a document, its text content and its metadata, have a logistic classifier each. Over some rounds either
classifier labels the documents of an unlabelled pool about which it is surest and hands them to the other. Both are then
calibrated on labelled documents held out, their calibrated log-odds are combined, and every document is scored.

Defined results: a null text counts as empty; an empty text (no character that isn't white space) is rejected with score 0;
null lang, source or n_chars are categories (0) of their own; labels that are null or whose documents aren't there are
left out; without both classes among the labels every document that isn't empty is kept with score null.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_parts, linear, logistic, named


@dataclass(frozen=True)
class Params:
    train_docs: int = 4000  # labelled documents that are fitted on, the bound of what the driver gathers
    pool_docs: int = 4000  # unlabelled documents of the pool
    rounds: int = 5
    per_round: int = 150  # pseudo-labels that a view hands over in a round
    sure: float = 0.95
    held_out: float = 0.4
    keep_recall: float = 0.995  # share of good held-out documents that the threshold keeps


def content_features(text: str) -> np.ndarray:
    """Shares of bytes by kind, in square roots, word shape and repetition."""
    raw = text.encode("utf-8", "replace")
    a = np.frombuffer(raw, np.uint8)
    h = np.bincount(a, minlength=256).astype(np.float64)
    n = max(1, len(raw))
    ascii_ = h[:128]
    high = h[128:].reshape(8, 16).sum(1)
    spaces = max(1.0, h[32] + h[10])
    letters = max(1.0, h[65:91].sum() + h[97:123].sum() + h[128:].sum())
    shape = [h[65:91].sum() / letters, np.log1p(n / spaces), (h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()) / n, h[48:58].sum() / n]
    words = text.split()
    k = max(1, len(words))
    again = sum(map(str.__eq__, words, words[1:])) / k
    shape += [np.sqrt(again), float(again > 0.2), len(set(words)) / k, float(len(words) < 10)]
    return np.concatenate([np.sqrt(ascii_[9:] / n), np.sqrt(high / n), shape])


def meta_features(text: str, lang, source, n_chars) -> np.ndarray:
    """Language and source in hashed categories, sizes, and layout."""
    out = np.zeros(16 + 32 + 5)
    out[zlib.crc32(str(lang).encode()) % 16 if isinstance(lang, str) else 0] = 1
    out[16 + (zlib.crc32(str(source).encode()) % 32 if isinstance(source, str) else 0)] = 1
    n = float(n_chars) if n_chars is not None and n_chars == n_chars else 0.0
    lines = text.count("\n") + 1
    longest = max(map(len, text.split("\n")))
    out[48:] = [np.log1p(max(n, 0)), np.log1p(lines), np.log1p(len(text) / lines), np.log1p(longest), float(abs(n - len(text)) > 0)]
    return out


def features(texts, langs, sources, n_chars) -> tuple[np.ndarray, np.ndarray]:
    t = [x if isinstance(x, str) else "" for x in texts]
    return np.array([content_features(x) for x in t]), np.array([meta_features(*r) for r in zip(t, langs, sources, n_chars, strict=True)])


@dataclass
class Model:
    mean: list
    sd: list
    views: list
    platt: list
    combine: np.ndarray | None
    threshold: float
    handed: tuple = (0, 0)

    def score(self, views) -> np.ndarray:
        if self.combine is None:
            return np.full(len(views[0]), np.nan)
        z = [linear(np.clip((v - m) / s, -8, 8), w) for v, m, s, w in zip(views, self.mean, self.sd, self.views, strict=True)]
        z = np.stack([p[0] * np.clip(x, -30, 30) + p[1] for x, p in zip(z, self.platt, strict=True)], 1)
        return 1 / (1 + np.exp(-np.clip(linear(z, self.combine), -30, 30)))


def fit(views: tuple, y: np.ndarray, pool: tuple, params: Params = Params()) -> Model:
    """views, pool: the two feature arrays of labelled and of unlabelled documents; y: 0 or 1."""
    none = Model([], [], [], [], None, 0.0)
    if len(set(y.tolist())) < 2:
        return none
    k = max(2, round(len(y) * (1 - params.held_out)))
    if len(set(y[:k].tolist())) < 2 or len(set(y[k:].tolist())) < 2:
        k = len(y)
    held = slice(k, None) if k < len(y) else slice(None)
    mean = [v[:k].mean(0) for v in views]
    sd = [np.maximum(v[:k].std(0), 1e-3) for v in views]
    std = [np.clip((v - m) / s, -8, 8) for v, m, s in zip(views, mean, sd, strict=True)]
    pl = [np.clip((v - m) / s, -8, 8) if len(v) else np.zeros((0, len(m))) for v, m, s in zip(pool, mean, sd, strict=True)]
    own = [(list(range(k)), y[:k].tolist()) for _ in range(2)]
    given: list[dict[int, int]] = [{}, {}]  # pseudo-labels of each view's training set
    prior = float(y[:k].mean())

    def trained(i: int) -> np.ndarray:
        x, t = std[i][:k], y[:k]
        if given[i]:
            x, t = np.vstack([x, pl[i][list(given[i])]]), np.append(t, list(given[i].values()))
        w = np.append(np.ones(k), np.full(len(given[i]), 0.5))
        return logistic(x, t.astype(float), w)

    del own
    for _ in range(params.rounds if len(pl[0]) else 0):
        ws = [trained(i) for i in range(2)]
        for i in range(2):
            p = 1 / (1 + np.exp(-np.clip(linear(pl[i], ws[i]), -30, 30)))
            other = given[1 - i]
            for label, order, ok, most in ((1, np.argsort(-p), p >= params.sure, prior), (0, np.argsort(p), p <= 1 - params.sure, 1 - prior)):
                new = [j for j in order.tolist() if ok[j] and j not in other][: max(1, round(params.per_round * most))]
                other.update(dict.fromkeys(new, label))
    ws = [trained(i) for i in range(2)]
    z = [linear(s[held], w) for s, w in zip(std, ws, strict=True)]
    yh = y[held].astype(float)
    platt = [logistic(np.clip(x, -30, 30)[:, None], yh, l2=0.01) for x in z]
    zz = np.stack([p[0] * np.clip(x, -30, 30) + p[1] for x, p in zip(z, platt, strict=True)], 1)
    model = Model(mean, sd, ws, platt, logistic(zz, yh, l2=0.1), 0.5, (len(given[0]), len(given[1])))
    s = model.score([v[held] for v in views])
    good, bad = np.sort(s[yh == 1]), s[yh == 0]
    cap = good[int((1 - params.keep_recall) * len(good))] if len(good) else 0.5
    grid = [t for t in np.unique(np.concatenate([s, [0.5, cap]])) if t <= cap]
    model.threshold = float(max(grid, key=lambda t: ((bad < t).mean() + (good >= t).mean(), -abs(t - 0.5))))
    if len(bad) and bad.max() < model.threshold:
        model.threshold = float((bad.max() + model.threshold) / 2)
    return model


def train(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Fits on bounded samples, taken by the hash of doc_id."""
    lab = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__y")).where("__id is not null and __y in (0, 1)").distinct()
    chosen = lab.orderBy(F.xxhash64("__id"), "__id").limit(params.train_docs)
    d = docs.select(F.col("doc_id").alias("__id"), "text", "lang", "source", "n_chars").where("__id is not null")
    drawn = d.select("__id").orderBy(F.xxhash64("__id", F.lit(7)), "__id").limit(params.pool_docs).distinct().withColumn("__y", F.lit(-1)).join(chosen.select("__id"), "__id", "left_anti")
    extract = F.pandas_udf(_packed, "array<double>")
    rows = d.join(F.broadcast(chosen.union(drawn)), "__id").select("__id", "__y", extract("text", "lang", "source", "n_chars").alias("x")).orderBy(F.xxhash64("__id"), "__id", "__y").collect()
    if not rows:
        return Model([], [], [], [], None, 0.0)
    x = np.array([r["x"] for r in rows])
    y = np.array([r["__y"] for r in rows])
    cut = len(content_features(""))
    a, b = x[:, :cut], x[:, cut:]
    return fit((a[y >= 0], b[y >= 0]), y[y >= 0], (a[y < 0], b[y < 0]), params)


def _packed(text: pd.Series, lang: pd.Series, source: pd.Series, n: pd.Series) -> pd.Series:
    a, b = features(text, lang, source, n)
    return pd.Series(list(np.hstack([a, b]))) if len(a) else pd.Series([], dtype=object)


def scorer(model: Model):
    def of(text: pd.Series, lang: pd.Series, source: pd.Series, n: pd.Series) -> pd.DataFrame:
        if not len(text):
            return pd.DataFrame({"score": np.zeros(0), "keep": np.zeros(0, bool)})
        empty = np.array([not isinstance(t, str) or not t.strip() for t in text])
        s = model.score(features(text, lang, source, n))
        keep = ~empty & (np.isnan(s) | (s >= model.threshold))
        return pd.DataFrame({"score": np.where(empty, 0.0, s), "keep": keep})

    @F.pandas_udf("score double, keep boolean")
    def score(text: pd.Series, lang: pd.Series, source: pd.Series, n: pd.Series) -> pd.DataFrame:
        return in_parts(of, text, lang, source, n)

    return score


def quality(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, score, keep for each row of docs."""
    model = train(docs, labels, params)
    d = docs.select("doc_id", scorer(model)("text", "lang", "source", "n_chars").alias("s"))
    return d.select("doc_id", F.when(~F.isnan("s.score"), F.col("s.score")).alias("score"), "s.keep")


def keep_good(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """docs without the rows that the classifier rejects; all columns stay as they are."""
    name = fresh(docs, "__quality")
    d = docs.withColumn(name, scorer(train(docs, labels, params))("text", "lang", "source", "n_chars"))
    return d.where(F.col(name)["keep"]).select(*named(*docs.columns))
