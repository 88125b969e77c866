"""Functions for SQL: register(spark), then SELECT canonical_url(url), cleaned_text(html), ... or a lateral call of a table function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import dom, segment
from .urls import CANONICAL, canonicalize


def register(spark: SparkSession) -> list[str]:
    """Registers the package's Arrow functions and table functions with a session; returns their names."""

    @F.pandas_udf(CANONICAL)
    def canonical_url(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([canonicalize(x) for x in raw], columns=["accepted", "url", "reason"])

    @F.pandas_udf(CANONICAL)
    def canonical_url_at(raw: pd.Series, base: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([canonicalize(x, y) for x, y in zip(raw, base, strict=True)], columns=["accepted", "url", "reason"])

    @F.pandas_udf("string")
    def cleaned_text(html: pd.Series) -> pd.Series:
        return pd.Series([dom.cleaned(h) for h in html], dtype=object)

    @F.pandas_udf("bigint")
    def strict_tokens(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else segment.strict(t)).astype("Int64")

    @F.udtf(returnType="chunk_index int, heading_path string, segment_type string, segment_text string, embedding_text string, token_estimate int")
    class Segments:
        def eval(self, text: str, strategy: str):
            for k, s in enumerate(segment.segments(text, strategy)):
                yield k, s["heading_path"], s["segment_type"], s["segment_text"], s["embedding_text"], s["token_estimate"]

    @F.udtf(returnType="position int, kind string, url string, anchor string, context string")
    class Links:
        def eval(self, html: str, base: str):
            yield from dom.links(html, base)

    @F.udtf(returnType="position int, url string, filename string")
    class Images:
        def eval(self, html: str, base: str):
            yield from dom.images(html, base)

    scalar = {"canonical_url": canonical_url, "canonical_url_at": canonical_url_at, "cleaned_text": cleaned_text, "strict_tokens": strict_tokens}
    tables = {"segments": Segments, "page_links": Links, "page_images": Images}
    for n, f in scalar.items():
        spark.udf.register(n, f)
    for n, f in tables.items():
        spark.udtf.register(n, f)
    return [*scalar, *tables]
