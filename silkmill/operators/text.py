"""Text analytics: bag of words, TF-IDF, similarity, word vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def words(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term: lower-case runs of a to z."""
    return rows.select(id_col, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z]+"), 0)).alias("term"))


def bag(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return words(rows, id_col, text_col).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def tfidf(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Smoothed, ln((N + 1) / (n + 1)) + 1, scaled to unit length by document."""
    tf = bag(rows, id_col, text_col)
    df = tf.groupBy("term").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    w = tf.join(df, "term").crossJoin(F.broadcast(total)).select(id_col, "term", (F.col("tf") * (F.log((F.col("total") + 1) / (F.col("n") + 1)) + 1)).alias("w"))
    norm = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, id_col).select(id_col, "term", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))


def bag_cosine(rows: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """Pairs of documents whose bags are at least so similar, joined by term; euclidean distance too."""
    tf = bag(rows, id_col, text_col)
    norm = tf.groupBy(id_col).agg(F.sum(F.col("tf") * F.col("tf")).cast("double").alias("sq"))
    a, b = (tf.select(F.col(id_col).alias(x), "term", F.col("tf").alias(f"t{x}")) for x in ("a", "b"))
    dots = a.join(b, "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("ta") * F.col("tb")).cast("double").alias("dot"))
    s = dots.join(norm.toDF("a", "sa"), "a").join(norm.toDF("b", "sb"), "b")
    s = s.select("a", "b", (F.col("dot") / F.sqrt(F.col("sa") * F.col("sb"))).alias("c"), F.sqrt(F.greatest(F.lit(0.0), F.col("sa") + F.col("sb") - 2 * F.col("dot"))).alias("e"))
    return s.where(F.col("c") >= least).select("a", "b", F.round("c", 6).alias("cosine"), F.round("e", 6).alias("euclidean"))


def word2vec(rows: DataFrame, id_col: str, text_col: str, dim: int = 50, least: int = 5, seed: int = 7) -> DataFrame:
    """id, vector: the mean of the vectors of a document's known words, zeros where none is known."""
    t = rows.select(id_col, F.regexp_extract_all(F.lower(text_col), F.lit("[a-z]+"), 0).alias("terms"))
    model = Word2Vec(vectorSize=dim, minCount=least, seed=seed, inputCol="terms", outputCol="v", numPartitions=1, maxIter=1).fit(t)
    from pyspark.ml.functions import vector_to_array

    v = model.getVectors().select(F.col("word").alias("term"), F.posexplode(vector_to_array("vector")).alias("i", "x"))
    mean = words(rows, id_col, text_col).join(v, "term").groupBy(id_col, "i").agg(F.avg("x").alias("x"))
    whole = mean.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    return rows.select(id_col).join(whole, id_col, "left").select(id_col, F.coalesce("vector", F.array_repeat(F.lit(0.0), dim)).alias("vector"))


def subword_vectors(rows: DataFrame, id_col: str, text_col: str, dim: int = 64, least: int = 3, most: int = 6) -> DataFrame:
    """id, vector: hashed character n-grams of the words. Stands in for trained subword vectors."""
    import zlib

    def of(text: str) -> np.ndarray:
        v = np.zeros(dim)
        for w in text.lower().split():
            w = f"<{w}>"
            for n in range(least, most + 1):
                for i in range(len(w) - n + 1):
                    h = zlib.crc32(w[i : i + n].encode())
                    v[h % dim] += 1 if h >> 16 & 1 else -1
        n = np.linalg.norm(v)
        return v / n if n else v

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b.iloc[:, 0], "vector": [of(x or "").tolist() for x in b.iloc[:, 1]]})

    return rows.select(F.col(id_col).cast("bigint").alias(id_col), text_col).mapInPandas(each, f"{id_col} bigint, vector array<double>")
