import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from silkmill.llm import linededup, simhash
from silkmill.llm.common import connected

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        assert docs.columns == base
        sizes.append(docs.count())
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}, name
        if name == "line_dedup":
            assert linededup.dropped_lines(docs).where("kind = 'exact'").count() == 0
        if name == "near_dedup":
            assert simhash.groups(docs).where("copies > 1").count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    got: dict = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.tokens
    assert got == {i: n for i, n in words.items() if n}


def test_run_and_odd_rows(spark, sf, odd, none):
    assert entry.queries()["pipeline"](spark, sf).count() > 0
    for docs in (odd.drop("__gone"), none.drop("__gone")):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            assert docs.count() >= 0


def test_queries_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("of, most", [(lambda b: linededup.key_batches(b, 4), 150e6), (simhash.print_batches, 90e6)])
def test_workers_hold_bounded_text(of, most):
    """A batch of long texts takes a worker about what one part of it does, and gives what one row at a time does."""
    rng = np.random.default_rng(6)
    texts = [" ".join(bytes(rng.integers(97, 123, 6).tolist()).decode() for _ in range(600)) for _ in range(1200)]
    columns = [pa.array(texts), pa.array(range(1200))] if most > 100e6 else [pa.array(range(1200)), pa.array(range(1200)), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, list("xyz")[: len(columns)])
    list(of(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    got = list(of(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < most
    one = [r for k in range(100) for b in of(iter([batch.slice(k, 1)])) for r in b.to_pylist()]
    if "blob" not in one[0]:
        assert pa.Table.from_batches(got).to_pylist()[:100] == one
    else:
        few = [r for b in of(iter([batch.slice(0, 100)])) for r in b.to_pylist()]
        records = lambda rows: sorted((r["part"], x) for r in rows for x in np.frombuffer(r["blob"], linededup.RECORD).tolist())
        assert records(few) == records(one)


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    e = rng.integers(0, 60, (40, 2)).tolist() + [[i, i + 1] for i in range(100, 130)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    root = {x: x for p in e for x in p if p[0] != p[1]}
    for _ in range(200):
        for a, b in e:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root and connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
