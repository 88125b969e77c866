from silkmill.functions.register import register


def test_functions_in_sql(spark):
    assert "segments" in register(spark)
    r = spark.sql("SELECT canonical_url('HTTP://A.com:80/x/../y#z').url AS u, canonical_url_at('../b', 'https://a.com/x/y').url AS v, cleaned_text('<article><h1>T</h1><p>x</p></article>') AS t, strict_tokens('a b.') AS n").first()
    assert (r.u, r.v, r.t, r.n) == ("http://a.com/y", "https://a.com/b", "[H1] T\n\nx", 5)
    rows = spark.sql("SELECT s.* FROM (SELECT '[H1] A\n\none two' AS t) d, LATERAL segments(d.t, 'v4') s").collect()
    assert [(x.heading_path, x.segment_text) for x in rows] == [("README > A", "one two")]
    assert spark.sql("SELECT url FROM page_links('<body><a href=\"/q\">q</a></body>', 'https://a.com/')").first().url == "https://a.com/q"
    assert spark.sql("SELECT filename FROM page_images('<img src=i.png>', 'https://a.com/')").first().filename == "i.png"
