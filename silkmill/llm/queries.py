"""The queries of this package's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import editprint, htmlgraph, linededup, nndescent, packing, quality, sentencepiece_bpe, simhash, toxicity, warc
from .common import Query, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encoded(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dropped_lines(table(spark, sf_dir, "documents"))


def op4_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.copies(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.salvage_pages(spark, sf_dir)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlgraph.extracted(table(spark, sf_dir, "pages"))


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (op1_toxicity, op2_sentencepiece, op3_line_dedup, op4_edit_fingerprints, op5_simhash, op6_packing, op7_warc_salvage, op8_html_extraction, op9_embedding_neardup, op10_quality)}

#: op7: the records of all pages but the damaged ones, and a gap for each of those. op9: all pairs of different vectors, and the least vector that each reaches by near ones.
ORACLE_SQL: dict[str, str] = {
    "op7_warc_salvage": """
SELECT 'record' AS kind, page_id, url, md5(html) AS html_md5 FROM pages WHERE page_id % 50 <> 7 AND url IS NOT NULL AND html IS NOT NULL
UNION ALL
SELECT 'gap', NULL, NULL, NULL FROM pages WHERE page_id % 50 = 7 AND url IS NOT NULL AND html IS NOT NULL""",
    "op9_embedding_neardup": """
WITH RECURSIVE v AS (SELECT embedding, min(vec_id) AS id, count(DISTINCT vec_id) AS copies FROM embeddings WHERE vec_id IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x * x)) > 0 GROUP BY 1),
near AS (SELECT a.id AS a, b.id AS b FROM v a, v b WHERE a.id <> b.id AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.95),
reach(a, b) AS (SELECT id, id FROM v UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
grouped AS (SELECT a, min(b) AS group_id FROM reach GROUP BY 1), links AS (SELECT a, count(*) AS links FROM near GROUP BY 1)
SELECT DISTINCT e.vec_id, g.group_id, coalesce(l.links, 0) AS links, v.copies FROM embeddings e JOIN v ON v.embedding = e.embedding JOIN grouped g ON g.a = v.id LEFT JOIN links l ON l.a = v.id""",
}
