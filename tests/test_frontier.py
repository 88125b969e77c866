from datetime import datetime

from pyspark.sql import functions as F

from silkmill.operators import dedup, frontier, report

T = datetime(2024, 1, 1)
NOW = datetime(2024, 1, 1, 12)
SCHEMA = "id bigint, url string, site_id int, page_type_code string, relevance_score double, next_attempt_at timestamp_ntz, accessed_time timestamp_ntz, attempt_count bigint, parser_retry_count bigint, claimed_by string, claimed_at timestamp_ntz, claim_expires_at timestamp_ntz, last_error_category string, github_hub_page boolean, html_content string"


def page(i, state="FRONTIER", score=0.5, due=T, seen=None, site=1, expires=None, **k):
    leased = state == "PROCESSING"
    return (i, f"https://s/{i}", site, state, score, due, seen, k.get("attempts", 0), k.get("parser", 0), "w" if leased else None, T if leased else None, expires, None, k.get("hub", False), k.get("html"))


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def test_claim_order_and_ties(spark):
    p = table(spark, page(1), page(2, seen=datetime(2023, 1, 1)), page(3, score=0.9, due=datetime(2024, 1, 2)), page(4, score=0.6), page(5, "HTML", 1.0))
    assert [r.id for r in frontier.claim_next(p, now(), 3).collect()] == [4, 2, 1]


def test_claim_lease_is_a_second_at_least(spark):
    r = frontier.claim_next(table(spark, page(1)), now(), 1, 0).first()
    assert (r.claim_expires_at - r.claimed_at).total_seconds() == 1


def test_claim_per_domain(spark):
    p = table(spark, page(1, site=1), page(2, site=1, score=0.9), page(3, site=2))
    assert {r.id for r in frontier.claim_per_domain(p, now()).collect()} == {2, 3}


def test_recovery_touches_only_expired(spark):
    p = table(spark, page(1, "PROCESSING", expires=datetime(2024, 1, 1, 1)), page(2, "PROCESSING", expires=datetime(2024, 1, 2)), page(3, "PROCESSING", expires=None), page(4, attempts=2))
    got = {r.id: r for r in frontier.recover_leases(p, now(), 10).collect()}
    assert got[1].page_type_code == "FRONTIER" and got[1].claimed_by is None and got[1].next_attempt_at == NOW and got[1].last_error_category == "DB_TRANSIENT"
    assert got[2].page_type_code == got[3].page_type_code == "PROCESSING" and got[4].attempt_count == 2


def decide(spark, c, a, p=0):
    return spark.range(1).select(frontier.retry_decision(F.lit(c), F.lit(a), F.lit(p)).alias("d"), frontier.retry_delay_ms(F.lit(c), F.lit(a)).alias("ms")).first()


def test_retry_table(spark):
    assert decide(spark, "FETCH_TIMEOUT", 2).d == "RESCHEDULE" and decide(spark, "FETCH_TIMEOUT", 3).d == "TERMINAL"
    assert all(decide(spark, c, 2).d == "RESCHEDULE" and decide(spark, c, 3).d == "TERMINAL" for c in ("ROBOTS_TRANSIENT", "FETCH_CAPACITY_EXHAUSTED"))
    assert decide(spark, "FETCH_HTTP_OVERLOAD", 4).d == "RESCHEDULE" and decide(spark, "FETCH_HTTP_OVERLOAD", 5).d == "TERMINAL"
    assert decide(spark, "PARSER_FAILURE", 9, 0).d == "RESCHEDULE" and decide(spark, "PARSER_FAILURE", 0, 1).d == "TERMINAL"
    assert all(decide(spark, c, 0).d == "TERMINAL" for c in frontier.FATAL)
    assert decide(spark, "FETCH_TIMEOUT", 3).ms == 800 and decide(spark, "DB_TRANSIENT", 30).ms == 300_000
    assert [decide(spark, "FETCH_HTTP_OVERLOAD", n).ms for n in (0, 1, 3, 9)] == [5000, 10_000, 40_000, 300_000] and decide(spark, "INVALID_URL", 0).ms == 100 and decide(spark, "FETCH_CAPACITY_EXHAUSTED", 1).ms == 200 and decide(spark, "PARSER_FAILURE", 0).ms == 2000


def offers(spark, *rows):
    return spark.createDataFrame([(f"u{i}", s, i) for i, s in rows], "url string, relevance_score double, arrival bigint")


def test_admission_evicts_only_for_better(spark):
    have = offers(spark, *((i, 0.1) for i in range(5)))
    got = lambda *o: {r.url for r in frontier.admitted(have, offers(spark, *o), 5).collect()}
    assert "u9" in got((9, 0.99)) and "u9" not in got((9, 0.05)) and "u9" not in got((9, 0.1))


def test_window_form_equals_the_fold(spark):
    have = offers(spark, *((i, (i * 7 % 10) / 10) for i in range(20)))
    new = offers(spark, *((100 + i, (i * 3 % 11) / 10) for i in range(30)))
    a = {(r.url, r.relevance_score) for r in frontier.admitted(have, new, 20).collect()}
    b = {(r.url, r.relevance_score) for r in frontier.admit_fold(have, new, 20).collect()}
    assert a == b


def test_persist_same_body(spark):
    got = {r.id: r for r in frontier.persisted(table(spark, *(page(i, html="same", hub=i == 3) for i in (5, 3, 8)), page(1, html="own"))).collect()}
    assert got[3].page_type_code == "HUB" and got[3].link_to is None
    assert all(got[i].page_type_code == "DUPLICATE" and got[i].html_length is None and got[i].link_to == 3 for i in (5, 8))
    assert got[1].page_type_code == "HTML"


def test_overdue_and_heartbeat(spark):
    p = table(spark, page(1, due=datetime(2024, 1, 1, 11, 59)), page(2, due=datetime(2024, 1, 1, 11, 55)), page(3, due=datetime(2024, 1, 2)), page(4, "PROCESSING", expires=NOW))
    sql = "TIMESTAMP_NTZ '2024-01-01 12:00:00'"
    r = report.overdue(p, sql).first()
    assert (r.overdue, r.avg_ms, r.max_ms) == (2, 180_000, 300_000)
    h = report.heartbeat(p, sql).first()
    assert (h.frontier, h.processing, h.terminal, h.oldest_lease_ms) == (3, 1, 0, 12 * 3_600_000)
    e = report.overdue(p.where("id > 9"), sql).first()
    assert (e.overdue, e.avg_ms, e.max_ms) == (0, 0, 0)


def test_first_value_is_never_overwritten(spark):
    known = spark.createDataFrame([("a", 1)], "k string, v int")
    got = {r.k: (r.v, r.inserted) for r in dedup.get_or_insert(known, spark.createDataFrame([("a", 9), ("b", 2)], "k string, v int"), "k").collect()}
    assert got == {"a": (1, False), "b": (2, True)}


def test_reschedule_in_milliseconds(spark):
    rows = table(spark, page(1, "PROCESSING", attempts=1), page(2, "PROCESSING", attempts=3), page(3, "PROCESSING", parser=0), page(4)).withColumn("category", F.when(F.col("id") == 3, "PARSER_FAILURE").otherwise("FETCH_TIMEOUT"))
    got = {r.id: r for r in frontier.reschedule(rows, now()).collect()}
    assert set(got) == {1, 2, 3} and all(r.claimed_by is None and r.claimed_at is None and r.last_error_category == r.category and r.last_error_at == NOW for r in got.values())
    assert (got[1].next_attempt_at - NOW).total_seconds() == 0.2 and got[1].attempt_count == 2 and got[1].page_type_code == "FRONTIER"
    assert got[2].page_type_code == "ERROR" and got[2].attempt_count == 3 and got[2].next_attempt_at == T
    assert got[3].parser_retry_count == 1 and got[3].attempt_count == 0


def test_hub_victims(spark):
    p = table(spark, page(1, score=0.1), page(2, score=0.5, hub=True), page(3, score=0.4, hub=True), page(4, "HUB", score=0.0, hub=True))
    assert [r.id for r in frontier.victims(p, 5, hubs=True).collect()] == [3, 2] and frontier.victims(p, 1).first().id == 1


def test_admission_reasons_of_budgets(spark):
    def why(hub, hub_room, html_room, frontier_room, better, hub_better):
        c = lambda x, t="boolean": F.lit(x).cast(t)
        r = frontier.admission_reason(c(None, "string"), c(False), c(False), c(hub), c(hub_room, "int"), c(html_room, "int"), c(frontier_room, "int"), c(better), c("ALLOWED", "string"), c(hub_better))
        return spark.range(1).select(r.alias("r")).first().r

    assert why(True, -1, 1, 1, True, True) == "HUB_BUDGET_ZERO" and why(True, 0, 1, 1, True, None) == "HUB_BUDGET_DROPPED" and why(True, 0, 1, 1, True, False) == "HUB_BUDGET_LOW_SCORE"
    assert why(False, 0, 0, 1, None, None) == why(False, 0, 1, 0, None, None) == why(False, 0, 0, 0, False, None) == "BUDGET_DROPPED"
    assert why(False, 0, 1, 0, False, None) == "FRONTIER_FULL_LOW_SCORE" and why(True, 1, 0, 1, None, None) is None and why(False, 0, 0, 0, True, None) is None
