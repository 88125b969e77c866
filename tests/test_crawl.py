from silkmill.config import EngineConfig
from silkmill.plans.crawl import crawl
from silkmill.sources import fetch


def web(spark):
    a = "https://a.com/"
    rows = [(1, a, '<body><a href="/x">deep mask</a><a href="https://b.com/">b</a><a href="/gone">g</a></body>'), (2, a + "x", '<body><a href="/">home</a> unet</body>'), (3, "https://b.com/", '<body><a href="https://a.com/copy">c</a></body>'), (4, a + "copy", '<body><a href="/">home</a> unet</body>')]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_crawl_until_the_queue_is_empty(spark):
    seeds = spark.createDataFrame([("https://a.com/", 1000.0)], "url string, relevance_score double")
    seen = []
    cfg = EngineConfig(crawl_hosts=("a.com", "b.com"))
    r = crawl(web(spark), seeds, {"primary": ["mask"], "secondary": ["unet"]}, cfg, on_round=lambda n, p: seen.append(n))
    got = {x.url: x.state for x in r.pages.collect()}
    assert got == {"https://a.com/": "HTML", "https://a.com/x": "HTML", "https://b.com/": "HTML", "https://a.com/gone": "ERROR", "https://a.com/copy": "DUPLICATE"}
    assert r.stopped == "empty" and seen == list(range(1, r.rounds + 1)) and r.links.count() == 6


def test_crawl_budget(spark):
    seeds = spark.createDataFrame([("https://a.com/", 1000.0)], "url string, relevance_score double")
    r = crawl(web(spark), seeds, {"primary": ["mask"], "secondary": ["unet"]}, EngineConfig(html_budget=1, crawl_hosts=("a.com",)))
    assert r.stopped == "budget" and r.rounds == 1


class Site:
    def __init__(self, pages):
        self.pages = pages

    def fetch(self, url):
        return self.pages.get(url, fetch.Fetched(url, 404, None, None))


def test_redirects():
    hop = lambda a, b, s=301: (a, fetch.Fetched(a, s, None, None, b))
    ok = fetch.Fetched("https://a/z", 200, "text/html", "x")
    s = Site(dict([hop("https://a/x", "/y"), hop("https://a/y", "https://a/z", 308), ("https://a/z", ok), hop("https://a/l", "/l"), ("https://a/b", fetch.Fetched("https://a/b", 503, None, None))]))
    assert fetch.follow(s, "https://a/x") == (ok, None) and fetch.follow(s, "https://a/l") == (None, "FETCH_TIMEOUT")
    assert fetch.follow(s, "https://a/b")[1] == "FETCH_HTTP_OVERLOAD" and fetch.follow(s, "https://a/none")[1] == "FETCH_HTTP_CLIENT"
    assert fetch.follow(s, "https://a/x", lambda u: "z" not in u)[1] == "ROBOTS_DISALLOWED" and fetch.follow(s, "https://a/x", most=1)[1] == "FETCH_TIMEOUT"
    assert fetch.has_model({"models": [{"name": "m:1b"}]}, "m") and not fetch.has_model({}, "m")
