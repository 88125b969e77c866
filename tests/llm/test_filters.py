import numpy as np
from pyspark.sql import functions as F

from silkmill.llm import quality, toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def test_toxicity_held_out(spark):
    """Fitted on part of the labels, held against the rest. English toxic text has words of its own; in the other languages it is made of the syllables of ordinary text, in another order, of which 40 to 70 labelled documents show dictionaries too little."""
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(d, lab.where("doc_id % 2 = 0"))
    other = lab.where("doc_id % 2 = 1")
    r = d.join(other, "doc_id").select("toxic", F.expr("lang = 'en'").alias("en"), toxicity.scorer(model)("text")["toxic"].cast("int").alias("p"))
    rate = {(x.toxic, x.en): x.rate for x in r.groupBy("toxic", "en").agg(F.avg("p").alias("rate")).collect()}
    every = {x.toxic: x.rate for x in r.groupBy("toxic").agg(F.avg("p").alias("rate")).collect()}
    assert rate[1, True] > 0.75 and every[1] > 0.45 and every[0] < 0.03


def test_dictionaries_are_trained_on_both_classes(monkeypatch):
    """The library's trainer makes the common dictionary and that of toxic text, each of texts of its class alone."""
    seen = []
    own = toxicity.zstd.train_dictionary
    monkeypatch.setattr(toxicity.zstd, "train_dictionary", lambda size, samples, **kw: seen.append(b"".join(samples)) or own(size, samples, **kw))
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeioulmnrst"), 5)) for _ in range(300)]
    toxic = ["".join(rng.choice(list("bcdfghjkz"), 8)) for _ in range(30)]
    text = lambda bad: " ".join(rng.choice([*words, *toxic * (3 * bad)], 400))
    m = toxicity.dictionaries([toxicity.lowered(text(1)) for _ in range(60)], [toxicity.lowered(text(0)) for _ in range(120)], toxicity.Params(common_bytes=20_000, class_bytes=400))
    has = [any(w.encode() in x for w in toxic) for x in seen]
    assert has.count(False) >= 1 and has.count(True) == 1 and sum(w.encode() in m.toxic for w in toxic) >= 20
    assert not any(w.encode() in m.common + m.ordinary for w in toxic) and toxicity.compressors(m)[0] is not toxicity.compressors(m)[1]


def test_toxic_words_are_found():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeioulmnrst"), 5)) for _ in range(400)]
    text = lambda bad: " ".join(rng.choice([*words, *["moronic", "idiotic"] * (20 * bad)], 120))
    m = toxicity.fit([text(1) for _ in range(80)], [text(0) for _ in range(160)])
    comp = toxicity.compressors(m)
    hit = lambda bad: np.mean([toxicity.decided(*toxicity.window_gains([text(bad)], m, comp), m)[0] for _ in range(60)])
    assert hit(1) > 0.9 and hit(0) < 0.1


def test_windows_cover_the_text():
    raw = ("word " * 1000 + "x" * 500).encode()
    c = toxicity.cuts(raw, 64)
    assert c[0] == 0 and c[-1] == len(raw) and (np.diff(c) > 0).all() and toxicity.cuts(b"", 64).tolist() == [0]


def test_toxicity_odd_rows(spark, odd, none):
    lab = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1), (7, None, None), (99, 0, 1)], LABELS)
    got = toxicity.toxicity(odd, lab).collect()
    assert len(got) == 10 and all(not r.toxic for r in got if r.doc_id in (3, 4, 5)) and next(r for r in got if r.doc_id == 3).score is None
    assert toxicity.toxicity(none, lab).count() == 0 and toxicity.drop_toxic(odd, lab.where("false")).columns == odd.columns
    assert toxicity.drop_toxic(odd, lab.where("false")).count() == 10


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    r = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", quality.scorer(model)("text", "lang", "source", "n_chars")["keep"].alias("k")).groupBy("quality").agg(F.avg(F.col("k").cast("int")).alias("rate")).collect()
    rate = {x.quality: x.rate for x in r}
    assert rate[1] > 0.97 and rate[0] < 0.25


def test_views_hand_over_labels(docs, labels):
    model = quality.train(docs, labels)
    assert min(model.handed) > 0


def test_quality_odd_rows(spark, odd, none):
    lab = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 1), (2, None, None)], LABELS)
    for labels in (lab, lab.where("false")):
        got = quality.quality(odd, labels).collect()
        assert len(got) == 10 and all(not r.keep and r.score == 0 for r in got if r.doc_id in (3, 4, 5))
        assert quality.quality(none, labels).count() == 0
    kept = quality.keep_good(odd, lab.where("false"))
    assert kept.columns == odd.columns and kept.count() == 7


def test_toxic_words_far_into_a_text_are_found(spark):
    """Labelled documents that are toxic after 20,000 characters of ordinary text only."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("aeiourstln"), 6)) for _ in range(400)]
    text = lambda bad: " ".join([*rng.choice(words, 3000), *(f"{w} {rng.choice(['grobulous', 'snarvicate'])}" for w in rng.choice(words, 40 * bad))])
    rows = [(i, text(int(i % 2))) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(120)], LABELS)
    m = toxicity.train(d, lab)
    assert b"robulous" in m.toxic and b"narvicate" in m.toxic
    new = [text(1) for _ in range(10)] + [text(0) for _ in range(10)]
    hit = toxicity.decided(*toxicity.window_gains(new, m, toxicity.compressors(m)), m)[0]
    assert hit[:10].mean() >= 0.9 and hit[10:].mean() <= 0.1
