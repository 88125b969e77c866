"""Sources: tables, keyword and query-set files, seeds, robots.txt, bodies."""

from __future__ import annotations

import json
import re
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import keywords
from ..functions.urls import canonicalize


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 16, **options: str) -> DataFrame:
    """A database table in key ranges; needs the database's driver on the classpath."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a restarted job has still to do."""
    return rows.join(done.select(key), key, "left_anti")


def texts(rows: DataFrame, text_col: str, only_missing: str | None = None) -> DataFrame:
    """Rows whose text isn't blank; only_missing names a column that must still be null or blank."""
    r = rows.where(F.col(text_col).isNotNull() & (F.length(F.trim(text_col)) > 0))
    return r if only_missing is None else r.where(F.col(only_missing).isNull() | (F.length(F.trim(only_missing)) == 0))


def keyword_file(path: str) -> dict[str, list[str]]:
    return keywords(Path(path).read_text())


def query_set(spark: SparkSession, text: str) -> DataFrame:
    """id, category, query, expected_behavior of a YAML list."""
    rows = yaml.safe_load(text) or []
    rows = rows.get("queries", []) if isinstance(rows, dict) else rows
    return spark.createDataFrame([tuple(str(r.get(k, "")) for k in ("id", "category", "query", "expected_behavior")) for r in rows], "id string, category string, query string, expected_behavior string")


def seeds(spark: SparkSession, urls: list[str], known: DataFrame, score: float) -> tuple[DataFrame, dict[str, int]]:
    """Seed rows (url, relevance_score) for an empty page table, and how many were configured, inserted, rejected and skipped."""
    if known.take(1):
        return spark.createDataFrame([], "url string, relevance_score double"), {"configured": len(urls), "inserted": 0, "rejected": 0, "skipped": len(urls)}
    got = [canonicalize(u) for u in urls]
    good = list(dict.fromkeys(u for ok, u, _ in got if ok))
    bad = sum(not ok for ok, _, _ in got)
    return spark.createDataFrame([(u, score) for u in good], "url string, relevance_score double"), {"configured": len(urls), "inserted": len(good), "rejected": bad, "skipped": len(urls) - bad - len(good)}


def decoded(body: Column, content_type: Column) -> Column:
    """A body by the charset of its content type, else UTF-8."""
    c = F.upper(F.regexp_extract(content_type, r"(?i)charset=[\"']?([A-Za-z0-9_-]+)", 1))
    return F.when(c == "ISO-8859-1", F.decode(body, "ISO-8859-1")).when(c == "UTF-16", F.decode(body, "UTF-16")).when(c == "US-ASCII", F.decode(body, "US-ASCII")).otherwise(F.decode(body, "UTF-8"))


def robots_rules(text: str, agent: str = "*") -> dict:
    """allow and disallow patterns, crawl delay and sitemaps of a robots.txt: those of the agent's own groups, and of * only where it has none."""
    sitemaps: list[str] = []
    groups: dict[str, dict] = {}
    names, fresh = [], True  # the agents of the group at hand; whether rules have begun
    for line in text.splitlines():
        k, _, v = (x.strip() for x in line.split("#")[0].partition(":"))
        k = k.lower()
        if k == "user-agent":
            names = [v.lower()] if fresh else [*names, v.lower()]
            groups.setdefault(v.lower(), {"allow": [], "disallow": [], "delay": None})
            fresh = False
        elif k == "sitemap":
            sitemaps.append(v)
        elif k in ("allow", "disallow", "crawl-delay"):
            fresh = True
            for g in (groups[x] for x in names):
                if k != "crawl-delay" and v:
                    g[k].append(v)
                elif k == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", v):
                    g["delay"] = float(v)
    own = groups.get(agent.lower()) or groups.get("*") or {"allow": [], "disallow": [], "delay": None}
    return own | {"sitemaps": sitemaps}


def robots_allows(rules: dict, path: str) -> bool:
    """The longest matching rule decides, allow on a tie; * and $ are wild."""
    def longest(ps: list[str]) -> int:
        hits = [len(p) for p in ps if re.match("".join(".*" if c == "*" else re.escape(c) for c in p.rstrip("$")) + ("$" if p.endswith("$") else ""), path)]
        return max(hits, default=-1)

    return longest(rules["allow"]) >= longest(rules["disallow"])


def robots_decision(loaded: bool, status: int | None, text: str | None, path: str, in_deny_window: bool) -> str:
    if not loaded or in_deny_window or status is None or status >= 500 or 300 <= status < 400:
        return "TEMPORARY_DENY"
    if 400 <= status < 500:
        return "ALLOWED"
    return "ALLOWED" if robots_allows(robots_rules(text or ""), path) else "DISALLOWED"


def catalog_report(df: DataFrame, want: dict[str, str]) -> list[str]:
    """What of the wanted columns and types is missing or otherwise."""
    have = dict(df.dtypes)
    return [f"{c}: {have.get(c, 'missing')}, not {t}" for c, t in want.items() if have.get(c) != t]


def traces(path: str) -> list[dict]:
    return [json.loads(x) for x in Path(path).read_text().splitlines() if x]
