import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from verify import canon  # noqa: E402

import __spark_entry__ as entry
from silkmill.functions import vectors

NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "events", "benchmark", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    got = entry.queries()[name](spark, sf).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        assert canon(got) == canon(con.sql(sql).df())
    else:
        assert len(got.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lsh_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = {r.vec_id for r in vectors.nearest(e, e.where("vec_id = 0").first()["embedding"], 10, "l2").collect()}
    assert len(exact & {r.vec_id for r in entry.queries()["lsh_ann"](spark, sf).collect()}) >= 9
