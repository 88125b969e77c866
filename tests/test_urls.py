import pytest
from pyspark.sql import functions as F

from silkmill.functions import urls

TOPICS = "https://github.com/topics/x"

CASES = [
    ("../torvalds/linux", TOPICS, "https://github.com/torvalds/linux", None),
    ("//www.github.com/a/b", TOPICS, "https://github.com/a/b", None),
    ("HTTP://Host.Example.ORG:80/one/../two", None, "http://host.example.org/two", None),
    ("https://example.com:443/a#frag", None, "https://example.com/a", None),
    ("https://example.com:8443/a", None, "https://example.com:8443/a", None),
    ("https://example.com", None, "https://example.com/", None),
    ("https://example.com/s?page=2&utm_source=x", None, "https://example.com/s?page=2", None),
    ("https://example.com/s?page=b&q=1&page=a", None, "https://example.com/s?page=a&page=b", None),
    ("https://www.github.com/o/r", None, "https://github.com/o/r", None),
    ("/a/./b/../c/", "https://example.com/x", "https://example.com/a/c/", None),
    ("javascript:alert(1)", None, None, "UNSUPPORTED_SCHEME"),
    ("mailto:a@b.c", TOPICS, None, "UNSUPPORTED_SCHEME"),
    ("http://a b", None, None, "INVALID_URL"),
    ("", None, None, "INVALID_URL"),
    ("   ", TOPICS, None, "INVALID_URL"),
    (None, None, None, "INVALID_URL"),
    ("https://example.com/" + "a" * 3000, None, None, "URL_TOO_LONG"),
]


@pytest.mark.parametrize(("raw", "base", "want", "reason"), CASES)
def test_canonicalize(raw, base, want, reason):
    assert urls.canonicalize(raw, base) == (want is not None, want, reason)
    if want:
        assert urls.canonicalize(want)[1] == want


def test_column_form_agrees_with_exact(spark):
    rows = [(u,) for u in ("HTTP://A.com:80/x?page=2&b=1#f", "https://WWW.GitHub.com/o", "https://a.com", "http://u@b.com:81/p?page=1")]
    got = spark.createDataFrame(rows, "u string").select("u", urls.canonical(F.col("u")).alias("c"), urls.canonical_exact(F.col("u"))["url"].alias("e")).collect()
    assert all(r.c == r.e for r in got), got


def one(spark, url, f):
    return spark.createDataFrame([(url,)], "u string").select(f(F.col("u")).alias("x")).first().x


HOSTS = ("github.com", "www.github.com")


@pytest.mark.parametrize(
    ("url", "hub"),
    [("https://github.com/topics", True), ("https://github.com/TOPICS/a", True), ("https://github.com/imgly", True), ("https://github.com/imgly/", True), ("https://github.com/explore", False), ("https://github.com/a/b", False), ("https://github.com/", False), ("https://example.com/imgly", False), ("https://github.com/a_b", False)],
)
def test_hub(spark, url, hub):
    assert one(spark, url, lambda u: urls.hub(u, HOSTS)) is hub


@pytest.mark.parametrize(("url", "blocked"), [("https://github.com/a/b/blob/x", True), ("https://github.com/a/b/Issues", True), ("https://github.com/a/b/tree/x", False), ("https://github.com/a/b", False), ("https://example.com/a/b/blob", False)])
def test_subpath(spark, url, blocked):
    deny = ("blob", "issues")
    assert one(spark, url, lambda u: urls.subpath_blocked(u, HOSTS, deny)) is blocked
    assert one(spark, url, lambda u: urls.subpath_blocked(u, HOSTS, ())) is False


@pytest.mark.parametrize(("url", "want"), [("https://a.com/x.py", True), ("https://a.com/x.PY?a=1", True), ("https://a.com/.py", False), ("https://a.com/py", False), ("https://a.com/x.py/y", False), ("https://a.com/x.p", False)])
def test_suffix(spark, url, want):
    assert one(spark, url, lambda u: urls.forced_binary(u, ("py",))) is want


@pytest.mark.parametrize(("url", "want"), [("https://a.com/b/i.png?x#y", "i.png"), ("https://a.com/b/", "image"), ("https://a.com/" + "n" * 300, "n" * 255)])
def test_file_name(spark, url, want):
    assert one(spark, url, urls.file_name) == want


def test_binary_type(spark):
    rows = [("application/pdf; x", "https://a/b", "PDF"), ("APPLICATION/MSWORD", "https://a/b", "DOC"), (None, "https://a/b.PPTX", "PPTX"), ("text/html", "https://a/b.html", None), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "https://a/b.pdf", "DOCX")]
    got = spark.createDataFrame(rows, "c string, u string, w string").select(urls.binary_type(F.col("c"), F.col("u")).alias("t"), "w").collect()
    assert all(r.t == r.w for r in got)


def test_percent(spark):
    rows = [("a%20b", "a b"), ("%zz", "%zz")]
    got = spark.createDataFrame(rows, "x string, w string").select(urls.percent_decode(F.col("x")).alias("d"), "w", urls.percent_encode(F.lit("a b+c")).alias("e")).collect()
    assert all(r.d == r.w and r.e == "a%20b%2Bc" for r in got)
