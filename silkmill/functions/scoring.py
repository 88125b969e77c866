"""Substring counts and keyword relevance."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def occurrences(haystack: Column, needle: str) -> Column:
    """Non-overlapping occurrences, from the left."""
    return ((F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit("")))) / len(needle)).cast("bigint")


def relevance(url: Column, anchor: Column, context: Column, primary: list[str], secondary: list[str], weights: tuple[float, float] = (0.18, 0.09), cap: int = 128) -> Column:
    hay = F.concat_ws(" ", F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(anchor, F.lit(""))), F.lower(F.coalesce(context, F.lit(""))))
    terms = [F.lit(w) * F.least(occurrences(hay, k), F.lit(cap)) for ks, w in ((primary, weights[0]), (secondary, weights[1])) for k in ks]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def keywords(text: str) -> dict[str, list[str]]:
    """The tiers of a keyword file: trimmed, lower case, distinct in order; an empty tier is an error."""
    raw = json.loads(text)
    out = {t: list(dict.fromkeys(k.strip().lower() for k in raw.get(t, []) if k and k.strip())) for t in ("primary", "secondary")}
    for t, ks in out.items():
        if not ks:
            raise ValueError(f"no {t} keywords")
    return out


def max_score(tiers: dict[str, list[str]], weights: tuple[float, float] = (0.18, 0.09), cap: int = 128) -> float:
    return cap * (weights[0] * len(tiers["primary"]) + weights[1] * len(tiers["secondary"]))
