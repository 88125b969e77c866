"""Registered queries: name to (spark, sf_dir) -> DataFrame, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import scoring, urls, vectors
from ..operators import dedup, frontier, html, rag, report, segment, text, wrapper
from ..sources import sinks
from ..streaming import events as stream
from .fixtures import AS_OF, AS_OF_SQL, CATEGORIES, PAGE_SQL, START, as_of, crawl_page, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CFG = EngineConfig()
HOSTS = CFG.crawl_hosts
NOW = f"TIMESTAMP_NTZ '{AS_OF}'"
PRIMARY, SECONDARY = ["the", "re", "an"], ["tion", "er"]


def query(sql: str | None = None, pages: bool = False):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH {PAGE_SQL} {sql}" if pages else sql).strip()
        return f

    return add


def derived_urls(s: SparkSession, d: str) -> DataFrame:
    """URLs of the shapes that the rules tell apart, one for each document."""
    i = F.col("doc_id").cast("string")
    forms = ["https://github.com/topics/t{}", "https://github.com/org{}", "https://github.com/org{}/repo/blob/main/a.py", "https://www.github.com/o/r{}/issues", "https://github.com/explore", "https://site.example.com/a{}.ipynb", "https://site.example.com/img{}.png?x=1#y", "https://github.com/o/r{}/tree/main", "", "https://site.example.com/d{}.pdf"]
    arr = F.array(*[F.concat(F.lit(f.split("{}")[0]), i, F.lit(f.split("{}")[1])) if "{}" in f else F.lit(f) for f in forms])
    return load(s, d, "documents").select("doc_id", F.get(arr, (F.col("doc_id") % len(forms)).cast("int")).alias("url"))


_forms = "ARRAY['https://github.com/topics/t' || doc_id, 'https://github.com/org' || doc_id, 'https://github.com/org' || doc_id || '/repo/blob/main/a.py', 'https://www.github.com/o/r' || doc_id || '/issues', 'https://github.com/explore', 'https://site.example.com/a' || doc_id || '.ipynb', 'https://site.example.com/img' || doc_id || '.png?x=1#y', 'https://github.com/o/r' || doc_id || '/tree/main', '', 'https://site.example.com/d' || doc_id || '.pdf']"
URLS_SQL = f"urls AS (SELECT doc_id, ({_forms})[CAST(doc_id % 10 + 1 AS INTEGER)] AS url FROM documents)"
HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"


# --- URLs


@query(f"""SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1)) || '://' || {HOST} || {PATH} ||
  CASE WHEN regexp_extract(url, '[?&](page=[^&#]*)', 1) <> '' THEN '?' || regexp_extract(url, '[?&](page=[^&#]*)', 1) ELSE '' END AS canonical_url FROM pages""")
def url_canonical(s, d):
    return load(s, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical_url"))


@query(f"""SELECT page_id, TRUE AS accepted, lower(regexp_extract(url, '^(https?)://', 1)) || '://' || {HOST} || {PATH} ||
  CASE WHEN regexp_extract(url, '[?&](page=[^&#]*)', 1) <> '' THEN '?' || regexp_extract(url, '[?&](page=[^&#]*)', 1) ELSE '' END AS url FROM pages""")
def url_canonical_exact(s, d):
    return load(s, d, "pages").select("page_id", urls.canonical_exact(F.col("url")).alias("c")).select("page_id", "c.accepted", "c.url")


@query(f"SELECT {HOST} AS host, count(*) AS pages FROM pages GROUP BY 1")
def url_host_key(s, d):
    return load(s, d, "pages").groupBy(urls.host_key(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@query(f"SELECT page_id, CAST(len(list_filter(string_split({PATH}, '/'), lambda x: x <> '')) AS BIGINT) AS segments FROM pages")
def url_path_segments(s, d):
    return load(s, d, "pages").select("page_id", F.size(urls.path_segments(F.col("url"))).cast("bigint").alias("segments"))


@query(f"""WITH {URLS_SQL} SELECT doc_id, CASE WHEN regexp_extract(url, '[^/][.]([A-Za-z0-9]+)([?#].*)?$', 1) IN ('ipynb', 'py', 'txt', 'yaml') THEN TRUE ELSE FALSE END AS forced_binary FROM urls""")
def url_suffix_policy(s, d):
    return derived_urls(s, d).select("doc_id", urls.forced_binary(F.col("url"), CFG.binary_suffixes).alias("forced_binary"))


@query(f"WITH {URLS_SQL} SELECT doc_id, doc_id % 10 IN (0, 1) AS hub FROM urls")
def hub_classify(s, d):
    return derived_urls(s, d).select("doc_id", urls.hub(F.col("url"), HOSTS).alias("hub"))


@query(f"WITH {URLS_SQL} SELECT doc_id, url LIKE 'https://github.com/topics%' AS topics, doc_id % 10 IN (2, 3) AS subpath FROM urls")
def discovery_blocks(s, d):
    u = F.col("url")
    return derived_urls(s, d).select("doc_id", urls.topics_blocked(u, HOSTS).alias("topics"), urls.subpath_blocked(u, HOSTS, CFG.deny_subpaths).alias("subpath"))


@query(f"WITH {URLS_SQL} SELECT CASE WHEN trim(url) = '' THEN 'INVALID_URL' WHEN doc_id % 7 = 0 THEN 'URL_TOO_LONG' END AS reason, count(*) AS urls FROM urls GROUP BY 1")
def ingest_reject_reason(s, d):
    long = F.when((F.col("doc_id") % 7 == 0) & (F.col("url") != ""), F.concat("url", F.repeat(F.lit("x"), F.lit(3000)))).otherwise(F.col("url"))
    return derived_urls(s, d).groupBy(urls.reject_reason(long).alias("reason")).agg(F.count("*").alias("urls"))


@query(f"""WITH {URLS_SQL} SELECT doc_id, CASE WHEN doc_id % 10 = 8 THEN NULL WHEN {HOST} = 'www.github.com' THEN 'github.com' ELSE {HOST} END AS site FROM urls""")
def site_registry_key(s, d):
    return derived_urls(s, d).select("doc_id", urls.site_key(F.col("url")).alias("site"))


@query(f"""WITH {URLS_SQL} SELECT doc_id, CASE WHEN regexp_extract(url, '/([^/?#]+)[^/]*$', 1) = '' THEN 'image' ELSE regexp_extract(url, '/([^/?#]+)[^/]*$', 1) END AS filename FROM urls""")
def image_filename(s, d):
    return derived_urls(s, d).select("doc_id", urls.file_name(F.col("url")).alias("filename"))


@query(f"WITH {URLS_SQL} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'DOC' WHEN url LIKE '%.pdf' THEN 'PDF' END AS data_type FROM urls")
def binary_document_type(s, d):
    return derived_urls(s, d).select("doc_id", urls.binary_type(F.when(F.col("doc_id") % 4 == 0, "application/msword"), F.col("url")).alias("data_type"))


@query("SELECT doc_id, replace(replace(replace(source || ' a+b&c', ' ', '%20'), '+', '%2B'), '&', '%26') AS encoded, source || ' a+b&c' AS decoded FROM documents")
def percent_coding(s, d):
    x = F.concat("source", F.lit(" a+b&c"))
    return load(s, d, "documents").select("doc_id", urls.percent_encode(x).alias("encoded"), urls.percent_decode(urls.percent_encode(x)).alias("decoded"))


@query("SELECT DISTINCT 'jdbc:postgresql://***@db/' || source || '?user=***&password=***' AS url FROM documents")
def jdbc_redaction(s, d):
    u = F.concat(F.lit("jdbc:postgresql://me:pw@db/"), "source", F.lit("?user=me&password=pw"))
    return load(s, d, "documents").select(urls.redact_jdbc(u).alias("url")).distinct()


# --- exact duplicates


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_sha256(s, d):
    return load(s, d, "documents").select("doc_id", dedup.sha256(F.col("text")).alias("content_hash"))


@query("SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS owner, count(*) AS copies FROM documents GROUP BY 1")
def content_owner(s, d):
    return dedup.owners(load(s, d, "documents"), "doc_id", "text")


@query("SELECT DISTINCT from_page, to_page FROM (SELECT doc_id AS from_page, min(doc_id) OVER (PARTITION BY text) AS to_page FROM documents) WHERE from_page <> to_page")
def duplicate_edges(s, d):
    return dedup.duplicate_edges(load(s, d, "documents"), "doc_id", "text")


@query("SELECT md5(text) AS content_fingerprint, min(doc_id) AS canonical_id, CAST(max(length(text)) AS BIGINT) AS content_length, count(*) AS duplicate_count FROM documents WHERE length(trim(text)) > 0 GROUP BY 1")
def canonical_content(s, d):
    return dedup.canonical(load(s, d, "documents"), "doc_id", "text")


@query("SELECT doc_id, md5(text) AS content_fingerprint, doc_id = min(doc_id) OVER (PARTITION BY md5(text)) AS is_canonical FROM documents WHERE length(trim(text)) > 0")
def page_content_map(s, d):
    return dedup.page_map(load(s, d, "documents"), "doc_id", "text")


@query("SELECT count(*) AS texts, count(DISTINCT md5(text)) AS fingerprints FROM documents WHERE length(trim(text)) > 0")
def distinct_fingerprints(s, d):
    r = load(s, d, "documents").where(dedup.filled("text"))
    return r.agg(F.count("*").alias("texts"), F.countDistinct(F.md5("text")).alias("fingerprints"))


@query("""SELECT id, content_hash, CASE WHEN id <> owner THEN 'DUPLICATE' WHEN github_hub_page THEN 'HUB' ELSE 'HTML' END AS page_type_code,
  CASE WHEN id = owner THEN CAST(length(html_content) AS BIGINT) END AS html_length, CASE WHEN id <> owner THEN owner END AS link_to
  FROM (SELECT *, sha256(html_content) AS content_hash, min(id) OVER (PARTITION BY html_content) AS owner FROM crawl_page)""", pages=True)
def persist_outcome(s, d):
    return frontier.persisted(crawl_page(s, d))


@query("SELECT source AS domain, min(doc_id) AS first_doc FROM documents GROUP BY source")
def dimension_get_or_create(s, d):
    first = load(s, d, "documents").groupBy(F.col("source").alias("domain")).agg(F.min("doc_id").alias("first_doc"))
    return dedup.get_or_insert(first.where("first_doc % 2 = 0"), first, "domain").drop("inserted")


# --- scoring


def _occ(k: str) -> str:
    return f"(length(hay) - length(replace(hay, '{k}', ''))) / {len(k)}"


_score = " + ".join([*(f"0.18 * least({_occ(k)}, 128)" for k in PRIMARY), *(f"0.09 * least({_occ(k)}, 128)" for k in SECONDARY)])


@query("SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS n FROM documents")
def keyword_count(s, d):
    return load(s, d, "documents").select("doc_id", scoring.occurrences(F.lower("text"), "the").alias("n"))


def scored_pages(s, d):
    return load(s, d, "pages").select("page_id", "url", F.round(scoring.relevance(F.col("url"), html.title(F.col("html")), F.lit(""), PRIMARY, SECONDARY), 4).alias("score"))


HAY = "SELECT page_id, url, lower(url) || ' ' || lower(coalesce(nullif(trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)), ''), '')) || ' ' AS hay FROM pages"


@query(f"SELECT page_id, url, round({_score}, 4) AS score FROM ({HAY})")
def keyword_score(s, d):
    return scored_pages(s, d)


@query(f"SELECT page_id, score FROM (SELECT page_id, round({_score}, 4) AS score FROM ({HAY})) ORDER BY score DESC, page_id LIMIT 20")
def keyword_score_topk(s, d):
    return scored_pages(s, d).select("page_id", "score").orderBy(F.desc("score"), "page_id").limit(20)


@query(f"""SELECT host, page_id, score, rank FROM (SELECT {HOST} AS host, page_id, round({_score}, 4) AS score, row_number() OVER (PARTITION BY {HOST} ORDER BY round({_score}, 4) DESC, page_id) AS rank FROM ({HAY})) WHERE rank <= 3""")
def flagship(s, d):
    """Pages by canonical URL, scored and ranked within their host: one scan, one window."""
    p = load(s, d, "pages")
    scored = p.select(urls.host_key(F.col("url")).alias("host"), "page_id", urls.canonical(F.col("url")).alias("canonical_url"), F.round(scoring.relevance(F.col("url"), html.title(F.col("html")), F.lit(""), PRIMARY, SECONDARY), 4).alias("score"))
    first = dedup.first_arrivals(scored, "canonical_url", "page_id")
    w = Window.partitionBy("host").orderBy(F.desc("score"), "page_id")
    return first.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 3").select("host", "page_id", "score", "rank")


# --- frontier

ORDER = "relevance_score DESC, next_attempt_at ASC, accessed_time ASC NULLS LAST, id ASC"
CLAIM = f"id, url, site_id, relevance_score, attempt_count, parser_retry_count, next_attempt_at, {AS_OF_SQL} AS claimed_at, {AS_OF_SQL} + INTERVAL 60 SECOND AS claim_expires_at"
DUE = f"page_type_code = 'FRONTIER' AND next_attempt_at <= {AS_OF_SQL}"


@query(f"SELECT {CLAIM} FROM (SELECT * FROM crawl_page WHERE {DUE} ORDER BY {ORDER} LIMIT 5)", pages=True)
def claim_next(s, d):
    return frontier.claim_next(crawl_page(s, d), as_of(), 5)


@query(f"SELECT {CLAIM} FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY {ORDER}) AS rn FROM crawl_page WHERE {DUE}) WHERE rn = 1", pages=True)
def claim_per_domain(s, d):
    return frontier.claim_per_domain(crawl_page(s, d), as_of())


STALE = f"page_type_code = 'PROCESSING' AND claim_expires_at < {AS_OF_SQL}"


@query(f"SELECT id, claim_expires_at FROM crawl_page WHERE {STALE} ORDER BY claim_expires_at, id LIMIT 10", pages=True)
def stale_leases(s, d):
    return frontier.stale_leases(crawl_page(s, d), as_of(), 10).select("id", "claim_expires_at")


@query(f"""SELECT p.id, CASE WHEN h.id IS NULL THEN page_type_code ELSE 'FRONTIER' END AS page_type_code, CASE WHEN h.id IS NULL THEN next_attempt_at ELSE {AS_OF_SQL} END AS next_attempt_at,
  CASE WHEN h.id IS NULL THEN last_error_category ELSE 'DB_TRANSIENT' END AS last_error_category, CASE WHEN h.id IS NULL THEN claimed_by END AS claimed_by, attempt_count
  FROM crawl_page p LEFT JOIN (SELECT id FROM crawl_page WHERE {STALE} ORDER BY claim_expires_at, id LIMIT 10) h ON p.id = h.id""", pages=True)
def lease_recovery(s, d):
    return frontier.recover_leases(crawl_page(s, d), as_of(), 10).select("id", "page_type_code", "next_attempt_at", "last_error_category", "claimed_by", "attempt_count")


_cats = "(ARRAY[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "])[CAST(doc_id // 3 % 10 + 1 AS INTEGER)]"
DECIDE = """CASE WHEN category IN ('INVALID_URL', 'ROBOTS_DISALLOWED', 'FETCH_HTTP_CLIENT', 'DB_CONSTRAINT') THEN 'TERMINAL'
  WHEN category = 'PARSER_FAILURE' THEN CASE WHEN parser_retry_count < 1 THEN 'RESCHEDULE' ELSE 'TERMINAL' END
  WHEN attempt_count < CASE WHEN category IN ('FETCH_HTTP_OVERLOAD', 'DB_TRANSIENT') THEN 5 ELSE 3 END THEN 'RESCHEDULE' ELSE 'TERMINAL' END"""
DELAY = """CAST(CASE WHEN category IN ('FETCH_TIMEOUT', 'DB_TRANSIENT') THEN least(100 * CAST(pow(2, attempt_count) AS BIGINT), 300000) WHEN category = 'FETCH_HTTP_OVERLOAD' THEN least(5000 * CAST(pow(2, attempt_count) AS BIGINT), 300000)
  WHEN category = 'FETCH_CAPACITY_EXHAUSTED' THEN least(100 * (attempt_count + 1), 30000) WHEN category = 'ROBOTS_TRANSIENT' THEN 120000 WHEN category = 'PARSER_FAILURE' THEN 2000 ELSE 100 END AS BIGINT)"""


def failing(s, d):
    return crawl_page(s, d).withColumn("category", F.get(F.array(*map(F.lit, CATEGORIES)), F.expr("cast(doc_id div 3 % 10 as int)")))


@query(f"SELECT id, category, {DECIDE} AS decision FROM (SELECT *, {_cats} AS category FROM crawl_page)", pages=True)
def retry_decision(s, d):
    return failing(s, d).select("id", "category", frontier.retry_decision(F.col("category"), F.col("attempt_count"), F.col("parser_retry_count")).alias("decision"))


@query(f"SELECT id, {DELAY} AS delay_ms FROM (SELECT *, {_cats} AS category FROM crawl_page)", pages=True)
def retry_delay(s, d):
    return failing(s, d).select("id", frontier.retry_delay_ms(F.col("category"), F.col("attempt_count")).alias("delay_ms"))


@query(f"""SELECT id, category, CASE WHEN again THEN 'FRONTIER' ELSE 'ERROR' END AS page_type_code, attempt_count + CASE WHEN again AND category <> 'PARSER_FAILURE' THEN 1 ELSE 0 END AS attempt_count,
  parser_retry_count + CASE WHEN again AND category = 'PARSER_FAILURE' THEN 1 ELSE 0 END AS parser_retry_count, CASE WHEN again THEN {AS_OF_SQL} + to_milliseconds(delay_ms) ELSE next_attempt_at END AS next_attempt_at,
  CAST(NULL AS VARCHAR) AS claimed_by, CAST(NULL AS TIMESTAMP) AS claimed_at, CAST(NULL AS TIMESTAMP) AS claim_expires_at, category AS last_error_category, {AS_OF_SQL} AS last_error_at
  FROM (SELECT *, {DECIDE} = 'RESCHEDULE' AS again, {DELAY} AS delay_ms FROM (SELECT *, {_cats} AS category FROM crawl_page WHERE page_type_code = 'PROCESSING'))""", pages=True)
def reschedule(s, d):
    return frontier.reschedule(failing(s, d), as_of())


@query("SELECT id, relevance_score FROM crawl_page WHERE page_type_code = 'FRONTIER' ORDER BY relevance_score, next_attempt_at DESC, id DESC LIMIT 10", pages=True)
def victim_order(s, d):
    return frontier.victims(crawl_page(s, d), 10).select("id", "relevance_score")


@query("SELECT id, relevance_score FROM crawl_page WHERE page_type_code = 'FRONTIER' AND github_hub_page ORDER BY relevance_score, next_attempt_at DESC, id DESC LIMIT 10", pages=True)
def hub_victim_order(s, d):
    return frontier.victims(crawl_page(s, d), 10, hubs=True).select("id", "relevance_score")


def _offers(s, d):
    p = crawl_page(s, d).select("url", "relevance_score", F.col("id").alias("arrival"), "page_type_code")
    return p.where("page_type_code = 'FRONTIER'").drop("page_type_code"), p.where("page_type_code = 'HTML'").drop("page_type_code")


@query("""SELECT url, relevance_score FROM (SELECT url, relevance_score, id AS arrival, page_type_code = 'HTML' AS offered FROM crawl_page WHERE page_type_code IN ('FRONTIER', 'HTML')) ORDER BY relevance_score DESC, offered, arrival, url LIMIT 60""", pages=True)
def admission_topn(s, d):
    f, o = _offers(s, d)
    return frontier.admitted(f, o, 60).select("url", "relevance_score")


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 8 THEN 'INVALID_URL' WHEN doc_id % 10 = 0 THEN 'GITHUB_TOPICS_PATH_BLOCKED' WHEN doc_id % 10 IN (2, 3) THEN 'GITHUB_REPO_SUBPATH_BLOCKED' WHEN doc_id % 10 = 1 AND hub_room = -1 THEN 'HUB_BUDGET_ZERO' WHEN doc_id % 10 = 1 AND hub_room = 0 AND doc_id % 4 = 0 THEN 'HUB_BUDGET_DROPPED' WHEN doc_id % 10 = 1 AND hub_room = 0 AND doc_id % 4 = 1 THEN 'HUB_BUDGET_LOW_SCORE'
  WHEN (frontier_room = 0 OR (doc_id % 10 <> 1 AND html_room = 0)) AND doc_id % 9 = 0 THEN 'BUDGET_DROPPED' WHEN doc_id % 10 <> 1 AND html_room = 0 AND doc_id % 9 < 6 THEN 'BUDGET_DROPPED' WHEN frontier_room = 0 AND doc_id % 9 < 6 THEN 'FRONTIER_FULL_LOW_SCORE'
  WHEN doc_id % 7 = 0 THEN 'ROBOTS_DISALLOWED' END AS reason FROM (SELECT doc_id, doc_id // 11 % 3 - 1 AS hub_room, doc_id // 13 % 2 AS html_room, doc_id // 17 % 2 AS frontier_room FROM documents)""")
def discovery_admission(s, d):
    u, i = F.col("url"), F.col("doc_id")
    r = frontier.admission_reason(urls.reject_reason(u), urls.topics_blocked(u, HOSTS), urls.subpath_blocked(u, HOSTS, ("blob", "issues")), urls.hub(u, HOSTS), F.expr("doc_id div 11 % 3 - 1"), F.expr("doc_id div 13 % 2"), F.expr("doc_id div 17 % 2"), F.when(i % 9 != 0, i % 9 >= 6), F.when(i % 7 == 0, "DISALLOWED").otherwise("ALLOWED"), F.when(i % 4 != 0, i % 4 != 1))
    return derived_urls(s, d).select("doc_id", r.alias("reason"))


@query(f"""SELECT id, CASE WHEN doc_id % 5 = 0 THEN 'REJECT_CRAWL_SCOPE' WHEN doc_id % 3 = 0 THEN 'REJECT_ROBOTS' WHEN doc_id % 3 = 1 THEN 'DEFER' ELSE 'ACCEPT' END AS decision,
  CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN next_attempt_at ELSE {AS_OF_SQL} END AS due_at FROM crawl_page""", pages=True)
def enqueue_decision(s, d):
    i = F.col("doc_id")
    dec, due_at = frontier.enqueue_decision(i % 5 != 0, F.when(i % 3 == 0, "DISALLOWED").when(i % 3 == 1, "TEMPORARY_DENY").otherwise("ALLOWED"), as_of(), F.col("next_attempt_at"))
    return crawl_page(s, d).select("id", dec.alias("decision"), due_at.alias("due_at"))


@query("SELECT http_status_code, CASE WHEN http_status_code IN (429, 503) THEN 'FETCH_HTTP_OVERLOAD' WHEN http_status_code >= 500 THEN 'FETCH_TIMEOUT' WHEN http_status_code >= 400 THEN 'FETCH_HTTP_CLIENT' END AS category, CASE http_status_code WHEN 200 THEN '2xx' WHEN 404 THEN '4xx' ELSE '3xx_5xx' END AS class, count(*) AS pages FROM crawl_page GROUP BY 1, 2, 3", pages=True)
def fetch_status(s, d):
    c = F.col("http_status_code")
    return crawl_page(s, d).groupBy("http_status_code", frontier.fetch_category(c).alias("category"), frontier.status_class(c).alias("class")).agg(F.count("*").alias("pages"))


@query("SELECT id, attempt_count * 10000 + 15000 > 40000 AS abort, CAST(least(120000 * pow(2, greatest(attempt_count - 1, 0)), 600000) AS BIGINT) AS robots_ms, CAST(least(5000 * pow(2, attempt_count), 300000) AS BIGINT) AS overload_ms FROM crawl_page", pages=True)
def politeness_windows(s, d):
    a = F.col("attempt_count")
    return crawl_page(s, d).select("id", frontier.lease_too_short(a * 10_000, F.lit(60_000), F.lit(40_000)).alias("abort"), frontier.robots_window_ms(a).alias("robots_ms"), frontier.overload_backoff_ms(a).alias("overload_ms"))


# --- reports


@query("SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE page_type_code = '{c}') AS {n}" for c, n in (("HTML", "html"), ("HUB", "hub"), ("BINARY", "bin"), ("DUPLICATE", "duplicate"), ("FRONTIER", "frontier"), ("PROCESSING", "processing"), ("ERROR", "error"))) + " FROM crawl_page", pages=True)
def run_summary(s, d):
    return report.run_summary(crawl_page(s, d))


@query(f"""SELECT count(*) FILTER (WHERE page_type_code = 'FRONTIER') AS frontier, count(*) FILTER (WHERE page_type_code = 'PROCESSING') AS processing, count(*) FILTER (WHERE page_type_code NOT IN ('FRONTIER', 'PROCESSING')) AS terminal,
  CAST(coalesce(max(CASE WHEN page_type_code = 'PROCESSING' THEN date_diff('millisecond', claimed_at, {AS_OF_SQL}) END), 0) AS BIGINT) AS oldest_lease_ms FROM crawl_page""", pages=True)
def heartbeat(s, d):
    return report.heartbeat(crawl_page(s, d), NOW)


@query(f"SELECT count(*) AS overdue, CAST(coalesce(round(avg(ms)), 0) AS BIGINT) AS avg_ms, CAST(coalesce(max(ms), 0) AS BIGINT) AS max_ms FROM (SELECT date_diff('millisecond', next_attempt_at, {AS_OF_SQL}) AS ms FROM crawl_page WHERE {DUE})", pages=True)
def overdue_health(s, d):
    return report.overdue(crawl_page(s, d), NOW)


@query("SELECT coalesce(nullif(trim(last_error_category), ''), 'UNKNOWN') AS category, count(*) AS pages FROM crawl_page WHERE page_type_code = 'ERROR' GROUP BY 1", pages=True)
def errors_by_category(s, d):
    return report.errors_by_category(crawl_page(s, d))


@query("SELECT 'src' || site_id AS domain, count(*) AS pages FROM crawl_page WHERE page_type_code NOT IN ('FRONTIER', 'PROCESSING') GROUP BY site_id ORDER BY pages DESC, domain LIMIT 5", pages=True)
def top_domains(s, d):
    site = load(s, d, "documents").select(F.substring("source", 4, 10).cast("int").alias("site_id"), F.col("source").alias("domain")).distinct()
    return report.top_domains(crawl_page(s, d), site, 5)


@query("SELECT DISTINCT site_id FROM crawl_page WHERE page_type_code = 'FRONTIER'", pages=True)
def frontier_domains(s, d):
    return crawl_page(s, d).where("page_type_code = 'FRONTIER'").select("site_id").distinct()


@query("SELECT site_id, min(next_attempt_at) AS next_attempt_at FROM crawl_page WHERE page_type_code = 'FRONTIER' GROUP BY site_id", pages=True)
def min_next_attempt(s, d):
    return crawl_page(s, d).where("page_type_code = 'FRONTIER'").groupBy("site_id").agg(F.min("next_attempt_at").alias("next_attempt_at"))


@query("SELECT count(*) FILTER (WHERE github_hub_page AND page_type_code IN ('HUB', 'FRONTIER', 'PROCESSING')) AS hubs FROM crawl_page", pages=True)
def hub_budget(s, d):
    return crawl_page(s, d).agg(F.count_if(F.col("github_hub_page") & F.col("page_type_code").isin("HUB", "FRONTIER", "PROCESSING")).alias("hubs"))


@query("""SELECT CAST(user_id AS VARCHAR) AS key, CAST(CASE WHEN value * 1000 < 100 THEN 0 WHEN value * 1000 < 500 THEN 1 WHEN value * 1000 < 2000 THEN 2 WHEN value * 1000 < 5000 THEN 3 WHEN value * 1000 < 10000 THEN 4 WHEN value * 1000 < 30000 THEN 5 WHEN value * 1000 < 60000 THEN 6 ELSE 7 END AS INTEGER) AS bucket, count(*) AS n
  FROM events WHERE user_id IN (SELECT user_id FROM (SELECT user_id, min(event_id) AS seen FROM events GROUP BY user_id ORDER BY seen LIMIT 256)) GROUP BY 1, 2
  UNION ALL SELECT '_other_', CAST(CASE WHEN value * 1000 < 100 THEN 0 WHEN value * 1000 < 500 THEN 1 WHEN value * 1000 < 2000 THEN 2 WHEN value * 1000 < 5000 THEN 3 WHEN value * 1000 < 10000 THEN 4 WHEN value * 1000 < 30000 THEN 5 WHEN value * 1000 < 60000 THEN 6 ELSE 7 END AS INTEGER) AS bucket, count(*) AS n
  FROM events WHERE user_id NOT IN (SELECT user_id FROM (SELECT user_id, min(event_id) AS seen FROM events GROUP BY user_id ORDER BY seen LIMIT 256)) GROUP BY 1, 2""")
def latency_histogram(s, d):
    return report.histogram(load(s, d, "events").withColumn("ms", F.col("value") * 1000), "user_id", "ms")


@query("SELECT 'pages' AS name, count(*) AS n FROM pages UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def state_counts_union(s, d):
    t = [load(s, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("pages", "documents", "embeddings")]
    return t[0].unionByName(t[1]).unionByName(t[2])


@query("SELECT 'lease_incomplete' AS check, 0 AS n UNION ALL SELECT 'self_loop', 0 UNION ALL SELECT 'duplicate_url', count(*) FROM (SELECT url FROM crawl_page GROUP BY url HAVING count(*) > 1)", pages=True)
def constraint_violations(s, d):
    return report.violations(crawl_page(s, d), dedup.duplicate_edges(load(s, d, "documents"), "doc_id", "text"))


@query("SELECT site_id, CAST(least(1000, floor(count(*) * 1000 / 40)) AS BIGINT) AS permille FROM crawl_page WHERE page_type_code = 'PROCESSING' GROUP BY site_id", pages=True)
def utilization(s, d):
    return crawl_page(s, d).where("page_type_code = 'PROCESSING'").groupBy("site_id").agg(F.count("*").alias("n")).select("site_id", report.utilization_permille(F.col("n"), F.lit(40)).alias("permille"))


@query("SELECT string_agg(page_type_code || '=' || n, ',' ORDER BY page_type_code) AS summary FROM (SELECT page_type_code, count(*) AS n FROM crawl_page GROUP BY 1)", pages=True)
def run_result_concat(s, d):
    return report.joined_counts(crawl_page(s, d), "page_type_code")


@query("SELECT event_type AS event, count(*) AS n, sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) AS k FROM events GROUP BY 1")
def event_log_counts(s, d):
    lines = load(s, d, "events").select(F.concat(F.lit("event="), "event_type", F.lit(" k="), F.get_json_object("props", "$.k")).alias("line"))
    return report.parsed_log(lines).groupBy(F.col("fields")["event"].alias("event")).agg(F.count("*").alias("n"), F.sum(F.col("fields")["k"].cast("bigint")).alias("k"))


@query("SELECT coalesce(nullif(trim(last_error_category), ''), 'UNKNOWN') AS category, count(*) AS pages FROM crawl_page WHERE page_type_code = 'ERROR' GROUP BY 1", pages=True)
def remediation(s, d):
    return report.remedies(crawl_page(s, d)).select("category", "pages")


@query(f"SELECT count(*) FILTER (WHERE next_attempt_at > {AS_OF_SQL}) AS denied, max(attempt_count) AS worst FROM crawl_page", pages=True)
def deny_gauge(s, d):
    return crawl_page(s, d).agg(F.count_if(F.col("next_attempt_at") > as_of()).alias("denied"), F.max("attempt_count").alias("worst"))


@query("SELECT page_id, CASE WHEN page_id % 5 IN (0, 1) OR page_id % 7 = 0 OR html IS NULL THEN TRUE ELSE html NOT ILIKE '%<a %' END AS shell FROM pages")
def incomplete_shell(s, d):
    """Bodies as they are, in capitals, cut short, padded with blanks, and with links taken out."""
    i, b = F.col("page_id"), F.col("html")
    body = F.when(i % 5 == 0, F.substring(b, 1, 399)).when(i % 5 == 1, F.concat(F.repeat(F.lit(" "), F.lit(500)), F.substring(b, 1, 300))).when(i % 7 == 0, F.regexp_replace(b, "(?i)<a ", "<b ")).when(i % 5 == 2, F.upper(b)).otherwise(b)
    return load(s, d, "pages").select("page_id", html.incomplete_shell(F.lit("Text/HTML; charset=utf-8"), body).alias("shell"))


# --- vectors

QV = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
DIST = {
    "cosine": "list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))",
    "l2": "list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))",
    "ip": "list_negative_inner_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))",
    "l1": "list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), lambda p: abs(p[1] - p[2])))",
}


def _knn(metric: str) -> None:
    def run(s, d):
        e = load(s, d, "embeddings")
        q = e.where("vec_id = 0").first()
        return vectors.nearest(e, q["embedding"], 10, metric).select("vec_id", "distance")

    run.__name__ = f"knn_{metric}"
    query(f"SELECT vec_id, round({DIST[metric]}, 6) + 0.0 AS distance FROM embeddings, {QV} ORDER BY distance, vec_id LIMIT 10")(run)


for _m in DIST:
    _knn(_m)


@query(f"""SELECT query_id, vec_id, distance, rank FROM (SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
  FROM (SELECT b.vec_id AS query_id, a.vec_id, round({DIST["cosine"].replace("embedding AS", "a.embedding AS").replace("q AS", "b.embedding AS")}, 6) + 0.0 AS distance FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0)) WHERE rank <= 5""")
def knn_batch(s, d):
    e = load(s, d, "embeddings")
    return vectors.nearest_batch(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 5)


@query(f"SELECT vec_id, url, distance FROM (SELECT vec_id, round({DIST['cosine']}, 6) + 0.0 AS distance FROM embeddings, {QV} WHERE label = 1 ORDER BY distance, vec_id LIMIT 5) JOIN pages ON page_id = vec_id")
def knn_filtered_join(s, d):
    e = load(s, d, "embeddings")
    top = vectors.nearest(e.where("label = 1"), e.where("vec_id = 0").first()["embedding"], 5)
    return top.join(load(s, d, "pages"), F.col("vec_id") == F.col("page_id")).select("vec_id", "url", "distance")


@query("""SELECT count(*) AS vectors, min(norm) AS min_norm, round(quantile_cont(norm, 0.5), 6) AS median_norm, count(*) FILTER (WHERE norm <= 1e-6) AS near_zero, count(*) FILTER (WHERE share <= 0.05) AS sparse
  FROM (SELECT round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm, len(list_filter(embedding, lambda x: x <> 0)) / len(embedding) AS share FROM embeddings)""")
def vector_quality(s, d):
    return vectors.quality(load(s, d, "embeddings"))


_bits = "list_filter(list_zip(embedding, q), lambda p: {})"


@query(f"""SELECT vec_id, CAST(len({_bits.format("(p[1] > 0) <> (p[2] > 0)")}) AS BIGINT) AS hamming,
  round(1 - len({_bits.format("p[1] > 0 AND p[2] > 0")}) / len({_bits.format("p[1] > 0 OR p[2] > 0")}), 6) + 0.0 AS jaccard FROM embeddings, {QV}""")
def binary_distances(s, d):
    e = load(s, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 0").first()["embedding"]])
    return e.select("vec_id", vectors.hamming(F.col("embedding"), q).alias("hamming"), vectors.tidy(vectors.jaccard(F.col("embedding"), q)).alias("jaccard"))


@query()
def lsh_ann(s, d):
    """Approximate neighbours by random projections; recall is tested against exact search."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    e = load(s, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=2.0, numHashTables=6, seed=5).fit(e)
    found = model.approxNearestNeighbors(e, e.where("vec_id = 0").first()["v"], 10, "distance")
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


# --- HTML


@query("SELECT page_id, nullif(trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)), '') AS title FROM pages")
def page_title(s, d):
    return load(s, d, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS links FROM pages WHERE html LIKE '%<a href=%'")
def page_link_counts(s, d):
    return html.links(load(s, d, "pages")).groupBy("page_id").agg(F.count("*").alias("links"))


@query()
def page_links(s, d):
    return html.links(load(s, d, "pages"))


@query()
def link_graph(s, d):
    return html.link_graph(load(s, d, "pages"))


@query()
def link_hosts(s, d):
    return html.link_targets(load(s, d, "pages"))


@query()
def page_images(s, d):
    return html.images(load(s, d, "pages"))


@query()
def page_meta(s, d):
    return html.meta(load(s, d, "pages"))


@query()
def page_blocks(s, d):
    return html.blocks(load(s, d, "pages"))


@query()
def cleaned_text(s, d):
    return html.cleaned(load(s, d, "pages"))


# --- segmentation

TOKENS = segment.TOKENS


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{TOKENS}')) AS BIGINT) AS tokens FROM documents")
def token_estimate(s, d):
    return load(s, d, "documents").select("doc_id", segment.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, substr(text, CAST(i * 50 + 1 AS INTEGER), 50) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(floor((length(text) - 1) / 50) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)")
def fixed_chunks(s, d):
    return segment.fixed_chunks(load(s, d, "documents"), "doc_id", "text")


@query("SELECT count(*) AS chunks, min(n) AS least, CAST(quantile_cont(n, 0.5) AS INTEGER) AS median, max(n) AS most FROM (SELECT least(50, length(text) - i * 50) AS n FROM (SELECT text, unnest(range(0, CAST(floor((length(text) - 1) / 50) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0))")
def fixed_chunk_quality(s, d):
    c = segment.fixed_chunks(load(s, d, "documents"), "doc_id", "text").select(F.length("chunk").cast("bigint").alias("n"))
    return c.agg(F.count("*").alias("chunks"), F.min("n").alias("least"), F.expr("cast(percentile(n, 0.5) as int)").alias("median"), F.max("n").alias("most"))


@query()
def sentence_chunks(s, d):
    return segment.sentence_chunks(load(s, d, "documents"), "doc_id", "text")


@query("SELECT value FROM (SELECT n_chars AS value, row_number() OVER (ORDER BY n_chars, doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn = greatest(1, round_even((95 / 100.0) * n, 0))")
def percentile_nearest_rank(s, d):
    return vectors.percentile_nearest_rank(load(s, d, "documents"), "n_chars", 95)


def outlined(s, d) -> DataFrame:
    """Multi-block texts, one for each twenty documents: heading marks and bodies."""
    g = load(s, d, "documents").select((F.col("doc_id") / 20).cast("bigint").alias("page_id"), F.struct("doc_id", F.concat(F.lit("[H"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("] "), "source", F.lit("\n\n"), "text").alias("t")).alias("p"))
    g = g.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "page_id")  # a number of their own, as small partitions that are joined would segment on few cores
    return g.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), "\n\n").alias("cleaned_content"))


@query("SELECT doc_id, CASE WHEN text LIKE '%|%' AND len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND x LIKE '%|%')) >= greatest(2, floor(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) / 2)) THEN 'table_rows' ELSE 'other' END AS kind FROM documents WHERE regexp_matches(text, '\\S') AND NOT regexp_matches(text, '\\n\\s*\\n')")
def block_kinds(s, d):
    r = load(s, d, "documents").where(F.col("text").rlike(r"\S") & ~F.col("text").rlike(r"\n\s*\n"))
    b = segment.block_kinds(r, "doc_id", "text")
    return b.select("doc_id", F.when(F.col("kind") == "table_rows", "table_rows").otherwise("other").alias("kind"))


def _segments(strategy: str) -> None:
    def run(s, d):
        return segment.segments(outlined(s, d), strategy)

    run.__name__ = f"segments_{strategy}"
    query()(run)


for _v in ("v1", "v2", "v3", "v4"):
    _segments(_v)


@query()
def segment_quality(s, d):
    o = outlined(s, d)
    return segment.quality(segment.segments(o, "v1").unionByName(segment.segments(o, "v4")))


@query()
def segment_upsert(s, d):
    o = outlined(s, d)
    return sinks.merged_segments(segment.segments(o, "v1"), segment.segments(o.where("page_id % 2 = 0"), "v1")).select("page_id", "strategy", "chunk_index", "token_estimate")


# --- retrieval

HITS_SQL = "hits AS (SELECT doc_id // 10 AS query_id, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS rank, doc_id, source, trim(text) AS body FROM documents)"


def hits(s, d) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("doc_id")
    r = load(s, d, "documents").select(F.expr("doc_id div 10").alias("query_id"), "doc_id", "source", F.col("text").alias("body"))
    r = r.withColumn("rank", F.row_number().over(w).cast("bigint")).withColumn("url", F.concat(F.lit("https://"), "source"))
    return r.withColumn("head", rag.header(F.col("rank"), F.col("url"), F.col("doc_id"), F.col("doc_id"), F.lit(0.5))).withColumn("question", F.concat(F.lit("what of "), "source"))


CONTEXT_SQL = f"""WITH {HITS_SQL}, blocks AS (SELECT query_id, rank, '[' || rank || '] URL: https://' || source || ' | segment_id: ' || doc_id || ' | page_id: ' || doc_id || ' | score: 0.5000' || chr(10) || body AS block FROM hits),
kept AS (SELECT * FROM (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) + 2 * (rank - 1) AS upto FROM blocks) WHERE upto <= 7000 OR rank = 1)
SELECT query_id, substr(string_agg(block, chr(10) || chr(10) ORDER BY rank), 1, 7000) AS context FROM kept GROUP BY query_id"""


@query(CONTEXT_SQL)
def rag_context(s, d):
    return rag.contexts(hits(s, d))


@query(f"SELECT query_id, 'Answer from the context alone and name the sources by their numbers. If it is not there, say so.' || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: q' || chr(10) || 'Answer:' AS prompt FROM ({CONTEXT_SQL})")
def rag_prompt(s, d):
    return rag.contexts(hits(s, d)).select("query_id", rag.prompt(F.lit("q"), F.col("context")).alias("prompt"))


@query(f"WITH {HITS_SQL} SELECT query_id, string_agg('[' || rank || '] https://' || source || ': ' || substr(replace(body, chr(10), ' '), 1, 120) || '...', ' | ' ORDER BY rank) AS summary FROM hits WHERE rank <= 3 GROUP BY query_id")
def eval_summary(s, d):
    return rag.summaries(hits(s, d))


@query()
def rerank_topk(s, d):
    return rag.rerank(hits(s, d), 5).select("query_id", "doc_id", "new_rank", F.round("rerank_score", 6).alias("rerank_score"))


@query()
def retrieval_search(s, d):
    docs = load(s, d, "documents").select(F.col("doc_id").alias("segment_id"), F.col("text").alias("body"), F.lit("v4").alias("strategy"))
    q = s.createDataFrame([(0, "the of and"), (1, "der die das")], "query_id bigint, question string")
    return rag.search(rag.embed(docs, "body"), q, rag.Retrieval(strategy="v4", rerank=False)).select("query_id", "segment_id", "distance", "rank")


@query("SELECT '| ' || doc_id || ' | ' || CASE WHEN length(replace(replace(text, chr(10), ' '), '|', chr(92) || '|')) > 40 THEN substr(replace(replace(text, chr(10), ' '), '|', chr(92) || '|'), 1, 40) || '...' ELSE replace(replace(text, chr(10), ' '), '|', chr(92) || '|') END || ' |' AS line FROM documents")
def markdown_table(s, d):
    return sinks.markdown(load(s, d, "documents").select("doc_id", "text"), 40)


# --- text analytics

WORDS_SQL = "words AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark), tf AS (SELECT item_id, term, count(*) AS tf FROM words GROUP BY 1, 2)"


@query(f"WITH {WORDS_SQL} SELECT * FROM tf")
def bag_of_words(s, d):
    return text.bag(load(s, d, "benchmark"), "item_id", "text")


@query(f"""WITH {WORDS_SQL}, df AS (SELECT term, count(*) AS n FROM tf GROUP BY 1), w AS (SELECT item_id, term, tf * (ln(((SELECT count(*) FROM benchmark) + 1) / (n + 1)) + 1) AS w FROM tf JOIN df USING (term)),
nm AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1) SELECT item_id, term, round(w / norm, 6) AS weight FROM w JOIN nm USING (item_id)""")
def tfidf(s, d):
    return text.tfidf(load(s, d, "benchmark"), "item_id", "text")


@query(f"""WITH {WORDS_SQL}, sq AS (SELECT item_id, CAST(sum(tf * tf) AS DOUBLE) AS sq FROM tf GROUP BY 1), dots AS (SELECT x.item_id AS a, y.item_id AS b, CAST(sum(x.tf * y.tf) AS DOUBLE) AS dot FROM tf x JOIN tf y USING (term) WHERE x.item_id < y.item_id GROUP BY 1, 2)
SELECT a, b, round(dot / sqrt(p.sq * q.sq), 6) AS cosine, round(sqrt(greatest(0, p.sq + q.sq - 2 * dot)), 6) AS euclidean FROM dots JOIN sq p ON p.item_id = a JOIN sq q ON q.item_id = b WHERE dot / sqrt(p.sq * q.sq) >= 0.5""")
def bag_cosine(s, d):
    return text.bag_cosine(load(s, d, "benchmark"), "item_id", "text", 0.5)


@query()
def word2vec(s, d):
    return text.word2vec(load(s, d, "benchmark"), "item_id", "text")


@query()
def subword_vectors(s, d):
    return text.subword_vectors(load(s, d, "benchmark"), "item_id", "text")


# --- wrapper induction


@query()
def wrapper_by_host(s, d):
    return wrapper.by_host(load(s, d, "pages"))


@query()
def wrapper_extract(s, d):
    p = load(s, d, "pages")
    return wrapper.extract(p, wrapper.by_host(p))


# --- streams


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(s, d):
    return stream.tumbling(s, d)


@query("""SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1""")
def sliding_counts(s, d):
    return stream.sliding(s, d)


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, g""")
def session_windows(s, d):
    return stream.sessions(s, d)


@query("""SELECT event_id, user_id AS domain, CAST(max(us - i * 5000000) OVER (PARTITION BY user_id ORDER BY i) + i * 5000000 - us AS BIGINT) AS wait_us FROM (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)""")
def token_schedule(s, d):
    return stream.token_schedule(s, d)


@query("""SELECT event_id, user_id AS domain, CASE WHEN event_type = 'error' THEN CAST(least(5000 * pow(2, least(20, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY i))), 300000) AS BIGINT) WHEN event_type <> 'signup' THEN 0 END AS backoff_ms
  FROM (SELECT *, sum(CASE WHEN event_type NOT IN ('error', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS g FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events))""")
def overload_backoff(s, d):
    return stream.overload_backoff(s, d)


@query()
def frontier_stream(s, d):
    return stream.leases(s, d)


__all__ = ["ORACLE_SQL", "QUERIES", "START", "flagship"]
