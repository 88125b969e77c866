"""Fetching: protocols for pages, an offline web made of a table, redirects, and a model server's health."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDIRECTS = (301, 302, 303, 307, 308)
MOST_HOPS = 10


@dataclass(frozen=True)
class Fetched:
    url: str
    status: int
    content_type: str | None
    body: str | None
    location: str | None = None


class Fetcher(Protocol):
    def fetch(self, url: str) -> Fetched: ...


def resolve_location(url: str, location: str | None) -> str | None:
    """Where a redirect leads, null where it names nothing."""
    return urljoin(url, location.strip()) if location and location.strip() else None


def follow(fetcher: Fetcher, url: str, allowed=lambda u: True, most: int = MOST_HOPS) -> tuple[Fetched | None, str | None]:
    """The last response and an error category; every hop is asked for leave, and loops and too many hops time out."""
    seen: set[str] = set()
    for _ in range(most + 1):
        if url in seen:
            return None, "FETCH_TIMEOUT"
        if not allowed(url):
            return None, "ROBOTS_DISALLOWED"
        seen.add(url)
        r = fetcher.fetch(url)
        if r.status in REDIRECTS and (to := resolve_location(url, r.location)):
            url = to
            continue
        if r.status in (429, 503):
            return r, "FETCH_HTTP_OVERLOAD"
        return r, "FETCH_TIMEOUT" if r.status >= 500 else "FETCH_HTTP_CLIENT" if r.status >= 400 else None
    return None, "FETCH_TIMEOUT"


def fetched(claims: DataFrame, web: DataFrame) -> DataFrame:
    """claims (id, url) against a table of pages (url, html): status and body, 404 where there is no such page. The distributed form of a fetch, without a network."""
    w = web.select(F.col("url").alias("u"), "html")
    return claims.join(w, claims["url"] == F.col("u"), "left").drop("u").withColumn("http_status_code", F.when(F.col("html").isNull(), 404).otherwise(200))


def is_html(content_type: Column, body: Column, forced_binary: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("text/html"), F.lit(False)) & body.isNotNull() & ~forced_binary


def has_model(tags: dict, name: str) -> bool:
    """Whether a model server's tag list has a model, with or without its tag."""
    names = [m.get("name", "") for m in tags.get("models", [])]
    return any(n == name or re.split(":", n)[0] == name for n in names)
