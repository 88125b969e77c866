"""Wrapper induction by host."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wrapper as w
from ..functions.urls import host_key


def by_host(pages: DataFrame) -> DataFrame:
    """host, template of all its pages, folded in the order of page_id; a task holds the template and one batch of pages."""
    p = pages.where("html is not null").select(F.regexp_extract(host_key(F.col("url")), r"([^.]+\.[^.]+)$", 1).alias("host"), "page_id", "html")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, t = None, None
        for b in batches:
            for h, page in zip(b.host, b.html, strict=True):
                if t is not None and h != host:
                    yield pd.DataFrame({"host": [host], "template": [w.dumps(t)]})
                    t = None
                host, t = h, w.added(t, page)
        if t is not None:
            yield pd.DataFrame({"host": [host], "template": [w.dumps(t)]})

    return p.repartition("host").sortWithinPartitions("host", "page_id", "html").mapInPandas(each, "host string, template string")


def extract(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """page_id, values by the template of the page's host."""
    p = pages.where("html is not null").select(F.regexp_extract(host_key(F.col("url")), r"([^.]+\.[^.]+)$", 1).alias("host"), "page_id", "html").join(templates, "host")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, w.Tpl] = {}
        for b in batches:
            vals = []
            for h, t in zip(b.html, b.template, strict=True):
                if t not in seen:
                    seen[t] = w.loads(t)
                vals.append(w.extract(w.tree(h), seen[t]))
            yield pd.DataFrame({"page_id": b.page_id, "values": vals})

    return p.select("page_id", "html", "template").mapInPandas(each, "page_id bigint, values array<string>")
