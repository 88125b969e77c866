"""HTML operators over pages: Arrow batches in, rows out; no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom
from .batches import table_of, text_parts

LINKS = "page_id bigint, position int, kind string, url string, anchor string, context string"


def rows_of(pages: DataFrame, of: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that of makes of each page, after its page_id; of has the other columns, the last of which is its html."""
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    types = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[k] for k in kinds]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_parts(batches, "html"):
            yield table_of([(i, *r) for i, *page in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in of(*page)], list(names), types)

    return pages.mapInArrow(each, schema)


def links(pages: DataFrame, hosts: tuple[str, ...] | None = None) -> DataFrame:
    return rows_of(pages.select("page_id", "url", "html").where("url is not null"), lambda u, h: dom.links(h, u, hosts), LINKS)


def link_graph(pages: DataFrame) -> DataFrame:
    """from_page, to_page of links between known pages; no loops."""
    to = pages.select(F.col("page_id").alias("to_page"), F.regexp_replace("url", "#.*$", "").alias("url"))
    return links(pages).select(F.col("page_id").alias("from_page"), "url").join(to, "url").where("from_page <> to_page").select("from_page", "to_page").distinct()


def link_targets(pages: DataFrame) -> DataFrame:
    """Host and number of links that pages have to it."""
    return links(pages).groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count("*").alias("links"))


def images(pages: DataFrame) -> DataFrame:
    return rows_of(pages.select("page_id", "url", "html").where("url is not null"), lambda u, h: ((*r, "BINARY") for r in dom.images(h, u)), "page_id bigint, position int, url string, filename string, content_type string")


def blocks(pages: DataFrame, selectors: tuple[str, ...] = dom.SELECTORS) -> DataFrame:
    def of(html: str | None) -> list:
        root = dom.root_of(dom.parse(html), selectors) if html else None
        if root is None:
            return []
        dom.strip_noise(root)
        return dom.blocks(root)

    return rows_of(pages.select("page_id", "html"), lambda h: ((k, *r) for k, r in enumerate(of(h))), "page_id bigint, position int, tag string, level int, text string")


def cleaned(pages: DataFrame, selectors: tuple[str, ...] = dom.SELECTORS, compat: bool = False) -> DataFrame:
    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return pd.Series([dom.cleaned(h, selectors, compat) for h in html], dtype=object)

    return pages.select("page_id", run("html").alias("cleaned_content"))


def meta(pages: DataFrame) -> DataFrame:
    @F.pandas_udf("title string, description string")
    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dom.meta(dom.parse(h)) if h else (None, None) for h in html], columns=["title", "description"])

    return pages.select("page_id", run("html").alias("m")).select("page_id", "m.*")


def title(html: Column) -> Column:
    """By pattern, without a parser: the title as written, trimmed, null where empty."""
    return F.nullif(F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def incomplete_shell(content_type: Column, html: Column, least: int = 400) -> Column:
    """A page that has still to be rendered: short, or without a link; no body counts as short, and no content type as another."""
    body = F.trim(F.coalesce(html, F.lit("")))
    return F.lower(F.coalesce(content_type, F.lit(""))).contains("text/html") & ((F.length(body) < least) | ~F.lower(body).contains("<a "))
