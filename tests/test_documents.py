import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silkmill.config import EngineConfig, layered
from silkmill.functions import dom, scoring, segment, wrapper
from silkmill.operators import rag
from silkmill.operators import segment as ops
from silkmill.operators.batches import text_parts
from silkmill.sources import readers

README = """<html><head><title> T </title><meta name=description content=" d "></head><body><a href="/x">top</a><article class="markdown-body entry-content">
<h1>Name<a class="anchor" href="#n"></a></h1><p>Intro <a href=https://e.com/p>paper</a>, <a href="https://e.com/i.png">pic</a> or <a href="https://e.com/long">a long label</a><br>end.</p>
<h2>Contents</h2><ul><li>One</li><li>Two</li></ul><h2>Use</h2><pre>a: 1
b: 2</pre><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td></td></tr></table><ul><li>x<ul><li>y</li></ul></li></ul><script>no()</script></article>"""


def test_cleaned_readme():
    t = dom.cleaned(README)
    assert t.startswith("[H1] Name\n\nIntro paper (https://e.com/p), pic or a long label end.")
    assert "One" not in t and "no()" not in t and "```\na: 1\nb: 2\n```" in t and "k | v" in t and t.endswith("y")
    assert dom.cleaned("<p>x") is None and dom.cleaned(None) is None and dom.cleaned("<article></article>") is None


def test_blocks_in_wrappers_come_once_unless_compat():
    root = dom.parse("<article><li><div><p>a</p></div></li></article>")
    assert [b[2] for b in dom.blocks(root)] == ["a"] and [b[2] for b in dom.blocks(root, compat=True)] == ["a", "a"]


def test_links_images_meta():
    html = """<body><a href="a?page=2&x=1#t">A  b</a><a href="https://off.com/">o</a><div onclick="location.href='/c'">C</div><div onclick='document.location = "/d"'>D</div><a href="javascript:0">j</a><img src="i.png"></body>"""
    got = dom.links(html, "https://e.com/dir/", ("e.com",))
    assert [(k, u, a) for _, k, u, a, _ in got] == [("href", "https://e.com/dir/a?page=2", "A b"), ("onclick", "https://e.com/c", "C"), ("onclick", "https://e.com/d", "D")]
    assert dom.images(html, "https://e.com/dir/") == [(0, "https://e.com/dir/i.png", "i.png")]
    assert dom.meta(dom.parse(README)) == ("T", "d")


@pytest.mark.parametrize(("hay", "k", "n"), [("aaa", "aa", 1), ("xyxyxyxyxy", "xy", 5), ("", "a", 0)])
def test_occurrences(spark, hay, k, n):
    assert spark.range(1).select(scoring.occurrences(F.lit(hay), k).alias("n")).first().n == n


def test_relevance_cap_and_weights(spark):
    r = spark.range(1).select(scoring.relevance(F.lit("xyxyxyxyxy"), F.lit(""), F.lit(None).cast("string"), ["xy"], [], (1.0, 0.5), 3).alias("a"), scoring.relevance(F.lit("AA b"), F.lit("B"), F.lit("c"), ["a"], ["b"], (1.0, 0.5)).alias("b")).first()
    assert r.a == 3.0 and r.b == 3.0
    assert scoring.keywords('{"primary": [" A ", "a"], "secondary": ["b"]}') == {"primary": ["a"], "secondary": ["b"]}
    with pytest.raises(ValueError):
        scoring.keywords('{"primary": [], "secondary": ["b"]}')


def test_block_kinds():
    k = segment.kind_of
    assert k("- a\n- b") == "list_item" and k("a | b\nc | d") == "table_rows" and k("```x```") == "code_block" and k("    x\ny") == "code_block" and k("plain text") == "prose" and k("a: 1\nb: 2") == "code_block"


def test_bundles():
    blocks = [segment.Block(f"- {i}", "list_item") for i in range(20)]
    sizes = [b.text.count("\n") + 1 for b in segment.bundled(blocks, segment.Config())]
    assert sizes == [12, 8]


def outline(words):
    return "[H1] A\n\n" + "w " * words[0] + ".\n\n" + "".join(f"[H2] S{i}\n\n" + "x " * n + ".\n\n" for i, n in enumerate(words[1:]))


words = st.lists(st.integers(0, 400), min_size=1, max_size=8)


@settings(max_examples=60, deadline=None)
@given(words)
def test_segment_invariants(ns):
    text = outline(ns)
    for s in segment.STRATEGIES:
        rows = segment.segments(text, s)
        body = " ".join(r["segment_text"] for r in rows)
        assert "[H" not in body and (s in ("v2", "v3") or "###" not in body)  # v2 and v3 cut a part together with its title
        if s != "v1":
            assert all(r["token_estimate"] <= 240 + (s == "v4") * 16 for r in rows), s
            assert body.split().count("x") == sum(ns[1:]) and body.split().count("w") == ns[0]


def test_sibling_merging():
    small = outline([1, 5, 5, 5])
    assert len(segment.segments(small, "v3")) < 4
    v4 = segment.segments("[H1] P\n\n[H2] Authors\n\nAnn and Bob wrote it.", "v4")
    assert "Type: authors" in v4[0]["embedding_text"] and v4[0]["segment_text"] == "Ann and Bob wrote it."


def test_long_words_are_cut():
    rows = segment.segments("[H1] A\n\n" + "://" * 400, "v2")
    assert all(r["token_estimate"] <= 240 for r in rows) and "".join(r["segment_text"] for r in rows) .removeprefix("### A").replace("\n", "") == "://" * 400


def test_sentence_chunks():
    assert segment.sentence_chunks("a b c. d e. f", 3) == ["a b c.", "d e. f"]
    assert segment.sentence_chunks("a b c d. e", 3, compat=True)[0] == "" and segment.sentence_chunks("a b c d. e", 3)[0] == "a b c d."


def test_segments_survive_repartitioning(spark):
    df = spark.createDataFrame([(i, outline([i * 10, 50, 300])) for i in range(12)] + [(99, None), (98, "  ")], "page_id bigint, cleaned_content string")
    a = sorted(map(tuple, ops.segments(df.repartition(1), "v4").collect()))
    assert a == sorted(map(tuple, ops.segments(df.repartition(7), "v4").collect())) and {r[0] for r in a} == set(range(12))


def test_context_budget(spark):
    h = spark.createDataFrame([(1, 1, "h1", "a" * 10), (1, 2, "h2", "b" * 10), (2, 1, "h", "c" * 100)], "query_id int, rank int, head string, body string")
    got = {r.query_id: r.context for r in rag.contexts(h, 30).collect()}
    assert got[1] == "h1\n" + "a" * 10 + "\n\nh2\n" + "b" * 10 and got[2] == ("h\n" + "c" * 100)[:30]
    assert rag.contexts(h, 20).where("query_id = 1").first().context == "h1\n" + "a" * 10


def test_rerank_falls_back(spark):
    class Broken:
        def score(self, pairs):
            raise RuntimeError

    h = spark.createDataFrame([(1, "x y", 1, "none"), (1, "x y", 2, "x y")], "query_id int, question string, rank int, body string")
    assert [r["rank"] for r in rag.rerank(h, 2).orderBy("new_rank").collect()] == [2, 1]
    assert [r["rank"] for r in rag.rerank(h, 2, Broken()).orderBy("new_rank").collect()] == [1, 2]


def test_answer(spark):
    segs = rag.embed(spark.createDataFrame([(1, "cats sleep all day", "v4"), (2, "dogs bark", "v4")], "segment_id bigint, body string, strategy string"), "body")
    r = rag.answer(spark, segs, "do cats sleep", "both")
    assert r[0].hits[0]["segment_id"] == 1 and "cats sleep" in r[0].prompt and r[1].hits == [] and '"mode": "rag"' in r[0].to_json()
    with pytest.raises(ValueError):
        rag.Retrieval(top_k=0).validate()


def test_wrapper():
    t = wrapper.induce(["<ul><li><b>n</b> one</li></ul><p>Fixed</p><img>", "<ul><li><b>n</b> two</li><li><b>n</b> three</li></ul><p>Fixed</p>"])
    assert wrapper.extract(wrapper.tree("<ul><li><b>n</b> four</li><li><b>n</b> five</li></ul><p>Fixed</p>"), t) == ["four", "five"]
    assert wrapper.loads(wrapper.dumps(t)) == t


def test_config():
    assert layered({"workers": "3"}, {"workers": "4"}, environ={"SILKMILL_HUB_CAP": "7"}, top_k=9) == EngineConfig(workers=4, hub_cap=7, top_k=9)
    assert EngineConfig().validate(10.0)
    for bad in ({"workers": 0}, {"max_backoff_ms": 1}, {"hub_cap": -1}):
        with pytest.raises(ValueError):
            EngineConfig(**bad).validate()
    with pytest.raises(ValueError):
        EngineConfig(seed_score=1.0).validate(1.0)


def test_robots():
    r = readers.robots_rules("User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\nCrawl-delay: 2\nSitemap: https://e/s.xml\nUser-agent: other\nDisallow: /")
    assert r["delay"] == 2 and r["sitemaps"] == ["https://e/s.xml"]
    assert not readers.robots_allows(r, "/a/x") and readers.robots_allows(r, "/a/b") and not readers.robots_allows(r, "/z.pdf") and readers.robots_allows(r, "/z.pdfx")
    d = readers.robots_decision
    assert d(False, None, None, "/", False) == "TEMPORARY_DENY" and d(True, 404, None, "/", False) == "ALLOWED" and d(True, 200, "User-agent: *\nDisallow: /", "/x", False) == "DISALLOWED" and d(True, 503, "", "/", False) == "TEMPORARY_DENY"


def test_seeds_and_query_set(spark):
    empty = spark.createDataFrame([], "id bigint")
    rows, stats = readers.seeds(spark, ["https://A.com", "https://a.com/", "bad url"], empty, 9.0)
    assert stats == {"configured": 3, "inserted": 1, "rejected": 1, "skipped": 1} and rows.first().url == "https://a.com/"
    assert readers.seeds(spark, ["https://a.com"], spark.range(1), 9.0)[1]["skipped"] == 1
    assert readers.query_set(spark, "- {id: 1, category: c, query: q, expected_behavior: e}").first().asDict() == {"id": "1", "category": "c", "query": "q", "expected_behavior": "e"}


def test_wrapper_of_all_pages(spark):
    """A node that only the last of many pages has is in the template, as an optional one."""
    from silkmill.operators import wrapper as by

    page = "<html><body><h1>title {}</h1>{}</body></html>"
    rows = [(i, f"https://www.one.com/{i}", page.format(i, "<em>late</em>" if i == 39 else "")) for i in range(40)]
    rows += [(100 + i, f"https://two.com/{i}", page.format(i, "")) for i in range(3)]
    got = {r.host: r.template for r in by.by_host(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert set(got) == {"one.com", "two.com"}
    assert '"tag": "em"' in got["one.com"] and '"tag": "em"' not in got["two.com"]


def test_own_group_of_robots_replaces_the_general_one():
    text = "User-agent: *\nDisallow: /a\nCrawl-delay: 9\n\nUser-agent: x\nUser-agent: Mine\nDisallow: /b\nSitemap: s"
    own, other = readers.robots_rules(text, "mine"), readers.robots_rules(text, "else")
    assert own == {"allow": [], "disallow": ["/b"], "delay": None, "sitemaps": ["s"]} and other["disallow"] == ["/a"] and other["delay"] == 9


def test_rerank_falls_back_for_the_whole_query(spark):
    class Failing:
        def score(self, pairs):
            if any("bad" in p for _, p in pairs):
                raise ValueError
            return [float(len(p)) for _, p in pairs]

    rows = [(1, "q", 1, "a"), (1, "q", 2, "bad"), (1, "q", 3, "long one"), (2, "q", 1, "a"), (2, "q", 2, "abc")]
    hits = spark.createDataFrame(rows, "query_id int, question string, rank int, body string").repartition(5, "rank", "query_id")
    got = {(r.query_id, r.new_rank): (r["rank"], r.rerank_score) for r in rag.rerank(hits, 3, Failing()).collect()}
    assert [got[1, k] for k in (1, 2, 3)] == [(1, None), (2, None), (3, None)]


def test_search_among_texts_without_a_vector(spark):
    segs = spark.createDataFrame([(1, "cats sleep", "v4"), (2, " ", "v4"), (3, "", "v4")], "segment_id bigint, body string, strategy string")
    q = spark.createDataFrame([(0, "cats"), (1, "")], "query_id bigint, question string")
    got = rag.search(rag.embed(segs, "body"), q, rag.Retrieval(strategy="v4", rerank=False)).collect()
    assert {(r.query_id, r.segment_id, r["rank"]) for r in got} == {(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 1, 1), (1, 2, 2), (1, 3, 3)}
    assert [r.segment_id for r in got if r.distance == r.distance] == [1]


def test_summary_trims_bodies(spark):
    hits = spark.createDataFrame([(1, 1, "u", "  a\nb "), (1, 2, "v", "  c　"), (2, 1, "w", "\t d\n ")], "query_id bigint, rank bigint, url string, body string")
    got = {r.query_id: r.summary for r in rag.summaries(hits).collect()}
    assert got == {1: "[1] u: a b... | [2] v: c...", 2: "[1] w: \t d ..."}


def test_segments_count_a_text_a_few_times(monkeypatch):
    seen = []

    class Counting:
        def findall(self, text, token=segment.TOKEN):
            seen.append(len(text))
            return token.findall(text)

    monkeypatch.setattr(segment, "TOKEN", Counting())
    text = " ".join(f"word{i % 997}," for i in range(20_000))
    for v in segment.STRATEGIES:
        seen.clear()
        got = segment.segments(text, v)
        assert sum(seen) <= 8 * len(text)
        assert got == segment.segments(text, v, segment.Config(count=lambda x: segment.strict(x)))


def test_text_parts_are_bounded():
    b = pa.record_batch({"id": list(range(6)), "t": ["a" * 40, None, "b" * 50, "c" * 500, "", "d" * 90]})
    parts = [p.column("id").to_pylist() for p in text_parts(iter([b, b.slice(3), b.slice(0, 0)]), "t", 100)]
    assert parts == [[0, 1, 2], [3], [4, 5]] + [[3], [4, 5]]


def test_quality_segments_once(spark):
    pages = spark.createDataFrame([(i, "[H1] a\n\n" + "word, " * (i * 40)) for i in range(1, 30)] + [(None, "x")], "page_id bigint, cleaned_content string")
    segs = ops.segments(pages, "v1")
    q = ops.quality(segs)
    assert q._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    p, r = segs.toPandas(), q.first()
    t = p.token_estimate.sort_values().tolist()
    assert (r.pages, r.segments, r.min_tokens, r.median_tokens) == (29, len(t), t[0], int(p.token_estimate.median()))
    assert (r.under_20, r.under_40, r.over_cap) == (sum(x < 20 for x in t), sum(x < 40 for x in t), sum(x > 240 for x in t))
    assert r.p95_tokens == t[max(1, round(0.95 * len(t))) - 1] and r.heading_percent == 100.0
