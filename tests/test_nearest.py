import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from silkmill.functions import vectors


def test_blocks_give_what_pairs_give(spark, monkeypatch):
    """Ties, vectors of other lengths, without a length, with nulls, empty and missing: as pair by pair, and by blocks."""
    monkeypatch.setattr(vectors, "BLOCK", 64)
    g = np.random.default_rng(3)
    data = [[float(a) for a in g.integers(-2, 3, 6)] for _ in range(300)] + [[1.0, 2.0]] * 20 + [None, [], [0.0] * 6, [1.0, None, 2.0, 3.0, 4.0, 5.0]]
    rows = spark.createDataFrame(list(enumerate(data)), "vec_id bigint, embedding array<float>")
    q = rows.where("embedding is not null and vec_id % 9 = 0 or vec_id >= 318").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    scored = rows.where("embedding is not null").crossJoin(q).select("query_id", "vec_id", vectors.tidy(vectors.cosine_distance(F.col("embedding"), F.col("query"))).alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    want = scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 5")
    got = vectors.nearest_batch(rows, q, 5)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
