"""URL functions: built-in column expressions for absolute URLs, and an exact normalizer for the rest."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RESERVED = "about account collections customer-stories enterprise explore features git login logout marketplace mobile new notifications organizations pricing pulls readme security settings signup sponsor sponsors team trending".split()
CANONICAL = "accepted boolean, url string, reason string"
MAX_URL = 3000


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def host_key(url: Column) -> Column:
    """Lower-cased host without user and port, null where there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(h != "", h)


def site_key(url: Column) -> Column:
    h = host_key(url)
    return F.when(h == "www.github.com", "github.com").otherwise(h)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def path_segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, only page parameters, sorted; for absolute URLs without dot segments."""
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*?(:\d+)(?:[/?#]|$)", 1)
    drop = ((scheme(url) == "http") & (port == ":80")) | ((scheme(url) == "https") & (port == ":443"))
    p = path(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pages = F.array_sort(F.filter(F.split(query, "&"), lambda x: x.startswith("page=")))
    host = site_key(url)
    return F.concat(scheme(url), F.lit("://"), host, F.when(drop, "").otherwise(port), F.when(p == "", "/").otherwise(p), F.when(F.size(pages) > 0, F.concat(F.lit("?"), F.array_join(pages, "&"))).otherwise(""))


def reject_reason(url: Column, max_url: int = MAX_URL) -> Column:
    return F.when(url.isNull() | (F.trim(url) == ""), "INVALID_URL").when(F.length(url) > max_url, "URL_TOO_LONG")


def topics_blocked(url: Column, hosts: tuple[str, ...]) -> Column:
    return F.coalesce(host_key(url).isin(*hosts), F.lit(False)) & path(url).rlike(r"(?i)^/topics(/.*)?$")


def subpath_blocked(url: Column, hosts: tuple[str, ...], deny: tuple[str, ...]) -> Column:
    if not deny:
        return F.lit(False)
    s = path_segments(url)
    return F.coalesce(host_key(url).isin(*hosts), F.lit(False)) & (F.size(s) >= 3) & F.lower(F.get(s, 2)).isin(*deny)


def hub(url: Column, hosts: tuple[str, ...]) -> Column:
    """Topic listings, and profiles: one path segment that isn't a reserved word."""
    seg = F.lower(F.regexp_extract(path(url), r"^/([^/]+)/?$", 1))
    return F.coalesce(host_key(url).isin(*hosts), F.lit(False)) & (topics_blocked(url, hosts) | (seg.rlike("^[a-z0-9-]+$") & ~seg.isin(*RESERVED)))


def suffix(url: Column) -> Column:
    """The suffix of the last path segment, null where it isn't one of 2 to 32 letters and digits."""
    s = F.lower(F.regexp_extract(path(url), r"[^/]\.([A-Za-z0-9]{2,32})$", 1))
    return F.when(s != "", s)


def forced_binary(url: Column, deny: tuple[str, ...]) -> Column:
    return F.coalesce(suffix(url).isin(*deny), F.lit(False))


def file_name(url: Column) -> Column:
    tail = F.regexp_extract(url, r"/([^/]+)$", 1)
    name = F.regexp_replace(F.regexp_replace(tail, r"\?.*$", ""), "#.*$", "")
    return F.when(F.trim(name) == "", "image").otherwise(F.substring(name, 1, 255))


def binary_type(content_type: Column, url: Column) -> Column:
    """Document type by MIME type, then by the path's extension."""
    ct, p = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(path(url))
    office = "application/vnd.openxmlformats-officedocument."
    rules = [(office + "wordprocessingml.document", "DOCX"), ("application/msword", "DOC"), (office + "presentationml.presentation", "PPTX"), ("application/vnd.ms-powerpoint", "PPT"), ("application/pdf", "PDF")]
    out = None
    for needle, code in rules:
        out = (F if out is None else out).when(ct.contains(needle), code)
    for code in ("DOCX", "DOC", "PPTX", "PPT", "PDF"):
        out = out.when(p.endswith("." + code.lower()), code)
    return out


def percent_decode(x: Column) -> Column:
    """Decoded, or as it is where that fails."""
    return F.coalesce(F.try_url_decode(x), x)


def percent_encode(x: Column) -> Column:
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


def redact_jdbc(url: Column) -> Column:
    """A JDBC URL without user and password."""
    return F.regexp_replace(F.regexp_replace(url, r"(?i)((?:password|user)=)[^&;]*", "$1***"), r"//[^/@]*@", "//***@")


PORTS = {"http": 80, "https": 443}


def canonicalize(raw: str | None, base: str | None = None, max_url: int = MAX_URL) -> tuple[bool, str | None, str | None]:
    """(accepted, url, reason), exact: relative references, dot segments, ports, page parameters."""
    if raw is None or not raw.strip():
        return False, None, "INVALID_URL"
    try:
        joined = urljoin(base, raw.strip()) if base else raw.strip()
        u = urlsplit(joined)
        name = u.scheme.lower()
        if not name:
            return False, None, "INVALID_URL"
        if name not in PORTS:
            return False, None, "UNSUPPORTED_SCHEME"
        host = (u.hostname or "").lower()
        if not host or re.search(r"[\s<>\"{}|\\^`]", host):
            return False, None, "INVALID_URL"
        host = "github.com" if host == "www.github.com" else host
        port = f":{u.port}" if u.port and u.port != PORTS[name] else ""
        p = quote(unquote(_dots(u.path or "/")), safe="/:@!$&'()*+,;=~-._") if "%" not in (u.path or "") else _dots(u.path)
        pages = sorted(v for k, v in parse_qsl(u.query, keep_blank_values=True) if k == "page")
        query = "&".join("page=" + quote(v, safe="") for v in pages)
        url = f"{name}://{host}{port}{p}" + (f"?{query}" if query else "")
    except ValueError:
        return False, None, "INVALID_URL"
    if len(url) > max_url:
        return False, None, "URL_TOO_LONG"
    return True, url, None


def _dots(p: str) -> str:
    out: list[str] = []
    parts = p.split("/")
    for i, s in enumerate(parts):
        if s in (".", ".."):
            if s == ".." and len(out) > 1:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(s)
    q = "/".join(out)
    return q if q.startswith("/") else "/" + q


def canonical_exact(raw: Column, base: Column | None = None) -> Column:
    """canonicalize as a column: accepted, url, reason."""

    @F.pandas_udf(CANONICAL)
    def run(r: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [canonicalize(x, y) for x, y in zip(r, b, strict=True)]
        return pd.DataFrame(rows, columns=["accepted", "url", "reason"])

    return run(raw, F.lit(None).cast("string") if base is None else base)
