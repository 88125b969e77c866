import gzip
import itertools
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from silkmill.llm import htmlgraph, nndescent, packing, warc
from silkmill.llm import sentencepiece_bpe as sp

# --- SentencePiece


@pytest.fixture(scope="module")
def vocabulary():
    return sp.load()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text("aabcdeth  \n\té日😀.▁1", max_size=60))
def test_encoding_equals_the_library(vocabulary, library, text):
    ids, n = sp.encode([text, None, text], vocabulary)
    assert n[1] == 0 and ids[: n[0]].tolist() == library.encode(text) == ids[n[0] :].tolist()
    assert sp.decode(ids[: n[0]], n[:1], vocabulary) == [library.decode(library.encode(text))]


def test_runs_and_long_words(vocabulary, library):
    texts = [" " * k for k in range(45)] + ["x" + " " * k + "y" for k in range(45)] + ["a" * 5000, "ab" * 3000, "the " * 3000]
    ids, n = sp.encode(texts, vocabulary)
    at = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(at, n, strict=True)] == library.encode(texts)


def test_round_trip_of_documents(docs, library):
    got = sp.encoded(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.round_trip and r.ids == library.encode(text[r.doc_id]) for r in got)
    back = {r.doc_id: r.text for r in sp.decoded(sp.encoded(docs)).collect()}
    assert back == text


def test_sentencepiece_odd_rows(odd, none):
    got = {r.doc_id: r for r in sp.encoded(odd).collect()}
    assert got[3].ids is None and got[3].n_tokens is None and got[4].ids == [] and not got[8].round_trip and got[6].round_trip
    assert sp.encoded(none).count() == 0 and sp.decoded(sp.encoded(odd)).count() == 10


def test_encoding_in_parts_of_text(vocabulary, library):
    """A batch of long texts of different words takes a worker little more than a part of it does."""
    rng = np.random.default_rng(5)
    texts = [" ".join(bytes(rng.integers(97, 123, 6).tolist()).decode() for _ in range(300)) for _ in range(2000)] + [None, "", "x " * 800_000]
    vocabulary.tables()
    tracemalloc.start()
    got = list(sp.encoded_batches(iter([pa.RecordBatch.from_arrays([pa.array(range(2003)), pa.array(texts)], ["doc_id", "text"])]), vocabulary))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    rows = pa.Table.from_batches(got).to_pylist()
    assert [r["doc_id"] for r in rows] == list(range(2003)) and rows[2000]["ids"] is None and rows[2001]["ids"] == []
    assert [r["ids"] for r in rows[:50] + rows[2002:]] == library.encode(texts[:50] + texts[2002:])


# --- packing


def check_packed(rows, size):
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.bin, []).append(r)
    assert all(sum(r.tokens for r in b) <= size and len({r.slot for r in b}) == len(b) for b in bins.values())
    return bins


def test_packing(docs):
    rows = packing.packed(docs).collect()
    bins = check_packed(rows, 2048)
    tokens = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    got: dict = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.first_token, r.tokens))
    assert {i: sum(n for _, n in p) for i, p in got.items()} == {i: n for i, n in tokens.items() if n}
    assert all([a for a, _ in sorted(p)] == [k * 2048 for k in range(len(p))] for p in got.values())
    assert sum(tokens.values()) / 2048 / len(bins) > 0.95


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 500), max_size=12))
def test_plan_places_all(count):
    made = packing.plan(dict(count), 32, 1)
    used: dict = {}
    for p, k in made:
        assert sum(p) <= 32 and k > 0
        for c in p:
            used[c] = used.get(c, 0) + k
    assert used == count


def test_nnls_against_grid():
    rng = np.random.default_rng(0)
    a, b = rng.random((6, 3)), rng.random(6)
    x = packing.nnls(a, b)
    best = min(((a @ np.array(g) - b) ** 2).sum() for g in itertools.product(np.linspace(0, 2, 41), repeat=3))
    assert (x >= 0).all() and ((a @ x - b) ** 2).sum() <= best + 1e-9


def test_packing_odd_rows(odd, none):
    rows = packing.packed(odd).collect()
    check_packed(rows, 2048)
    assert {r.doc_id for r in rows} == {1, 2, None, 6, 7, 8} and sum(r.tokens for r in rows if r.doc_id == 6) == 40_000 and sum(r.doc_id == 1 for r in rows) == 2
    assert packing.packed(none).count() == 0


# --- WARC


def pages(n, compress):
    rng = random.Random(n)
    return [warc.response(f"https://e.com/{i}", "<p>" + "".join(rng.choice("abc \n") for _ in range(rng.randint(0, 3000))) + f"{i}</p>", f"urn:page:{i}", compress) for i in range(n)]


def ids(found):
    return [int(f.headers["warc-record-id"].strip("<>").split(":")[-1]) for f in found if f.kind == "record"]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    parts = pages(30, compress)
    bad = {4, 5, 17, 29}
    hurt = [p[: len(p) // 2] + bytes(x ^ 0x5A for x in p[len(p) // 2 : len(p) // 2 + 9]) + p[len(p) // 2 + 9 :] if i in bad else p for i, p in enumerate(parts)]
    found = list(warc.salvage(b"".join(hurt)))
    assert ids(found) == [i for i in range(30) if i not in bad]
    at = np.cumsum([0] + [len(p) for p in hurt])
    assert [(f.start, f.end) for f in found if f.kind == "gap"] == [(at[4], at[6]), (at[17], at[18]), (at[29], at[30])]
    assert sum(f.end - f.start for f in found) == at[-1]


@pytest.mark.parametrize("compress", [True, False])
def test_truncated_and_junk(compress):
    parts = pages(5, compress)
    whole = b"".join(parts)
    assert ids(warc.salvage(b"junk\n" + whole)) == [0, 1, 2, 3, 4]
    assert ids(warc.salvage(whole[: len(whole) - len(parts[-1]) // 2])) == [0, 1, 2, 3]
    assert list(warc.salvage(b"")) == [] and [f.kind for f in warc.salvage(b"nothing here")] == ["gap"]
    assert ids(warc.salvage(whole)) == ids(warc.salvage(whole + b"")) and ids(warc.salvage(parts[1] * 3)) == [1, 1, 1]


def test_wrong_length():
    p = pages(3, False)
    p[1] = p[1].replace(b"Content-Length: ", b"Content-Length: 9", 1) if p[1].find(b"Content-Length") > 0 else p[1]
    found = list(warc.salvage(b"".join(p)))
    assert ids(found) == [0, 2] and [f.kind for f in found] == ["record", "gap", "record"]


@pytest.mark.parametrize("compress", [True, False])
def test_byte_ranges(spark, tmp_path, compress):
    parts = pages(60, compress)
    parts[11] = parts[11][: len(parts[11]) // 2]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.read_warc(spark, str(tmp_path), range_bytes=7000).collect()
    want = [f for f in warc.salvage(b"".join(parts))]
    assert sorted((r.kind, r.start, r.end) for r in rows) == sorted((f.kind, f.start, f.end) for f in want) and len(ids(want)) == 59


def test_other_types_are_skipped(spark):
    info = warc.record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<x>"}, b"software: y\r\n")
    df = spark.createDataFrame([("p", info + pages(1, True)[0]), ("q", None), ("r", gzip.compress(b"no record"))], "path string, content binary")
    got = warc.salvaged(df).collect()
    assert sorted((r.path, r.kind) for r in got) == [("p", "record"), ("r", "gap")] and warc.salvaged(df, ()).where("path = 'p'").count() == 2


def test_archive_skips_nulls(spark):
    df = spark.createDataFrame([(1, "u", "h"), (2, None, "h"), (3, "u", None), (None, "u", "")], "page_id bigint, url string, html string")
    got = warc.pages_of(warc.salvaged(warc.archived(df))).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "None"] and warc.salvaged(warc.archived(df.where("false"))).count() == 0


# --- HTML


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    for html in ("<div>a<p>b<a>c</a></p></div><p>d", "<ul><li>x<li>y</ul>"):
        t = htmlgraph.parse(html)
        f = htmlgraph.Forest.of([t])
        w, pair = rng.normal(size=htmlgraph.dimension()) * 0.3, rng.normal(size=(htmlgraph.KINDS, 2, 2))
        p, joint, z = htmlgraph.marginals(f, w, pair)
        n, u, total = len(t.tag), f.x @ w, 0.0
        one, two = np.zeros(n), np.zeros((n, 2, 2))
        for s in itertools.product((0, 1), repeat=n):
            e = np.exp(sum(u[i] * s[i] for i in range(n)) + sum(pair[f.kind[i], s[f.parent[i]], s[i]] for i in range(1, n)))
            total += e
            one += e * np.array(s)
            for i in range(1, n):
                two[i, s[f.parent[i]], s[i]] += e
        assert np.allclose(one / total, p) and np.allclose(two / total, joint) and np.isclose(np.log(total), z[0])


def test_extraction_held_out(spark):
    rows = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    model = htmlgraph.fit(rows[:150])
    texts, _, _ = htmlgraph.extract(rows[150:], model)
    trees = [htmlgraph.parse(h) for h in rows[150:]]
    want = [htmlgraph.text_of(t, htmlgraph.labels(t) == 1) for t in trees]
    assert np.mean([a == b for a, b in zip(texts, want, strict=True)]) > 0.95


def test_html_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no tags"), (4, "u", "<<p>a</b><!-- <p>x --><script>var p='<p>';</script></p>" + "<div>" * 3000 + "deep"), (None, "u", "<article><p>a b</p></article>")] * 2
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = htmlgraph.extracted(df).collect()
    assert len(got) == 10 and all(r.text is None for r in got if r.page_id == 1) and all(r.text == "" for r in got if r.page_id == 2)
    assert htmlgraph.extracted(df.where("false")).count() == 0


# --- NN-descent


def components(n, near):
    root = np.arange(n)
    while True:
        new = np.where(near, root[None, :], n).min(1)
        new = np.minimum(new, root)
        if (new == root).all():
            return root
        root = new


def against_all_pairs(spark, x, params=nndescent.Params()):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r for r in nndescent.near_duplicates(df, params).collect()}
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    same = np.array([[np.array_equal(a, b) for b in x] for a in x])
    near = s >= params.threshold
    root = components(len(x), near)
    pairs = [(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    assert set(got) == set(range(len(x))) and all(got[i].group_id >= root[i] and root[got[i].group_id] == root[i] for i in got)
    assert np.mean([got[a].group_id == got[b].group_id for a, b in pairs]) >= 0.9
    for i in got:
        links = {j for j in np.flatnonzero(near[i] & ~same[i]) if got[j].group_id == got[i].group_id}
        first = {min(np.flatnonzero(same[j])) for j in links}
        assert got[i].links == len(first) and got[i].copies == same[i].sum()
    return len(pairs), sum(got[i].group_id != i for i in got)


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 24))
    x[300:340] = x[0] + rng.normal(size=(40, 24)) * 0.05  # more than a list holds
    x[400:430] = x[100:130] + rng.normal(size=(30, 24)) * 0.08
    x[500:505] = x[10]
    n, gone = against_all_pairs(spark, x)
    assert n > 700 and gone >= 60


def test_saturated_lists_are_enlarged(spark):
    """A third of all vectors in one cluster of different near-duplicates, and a chain whose ends aren't near each other; groups larger than a block."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(450, 24))
    x[:150] = x[0] + rng.normal(size=(150, 24)) * 0.06
    for i in range(201, 240):
        x[i] = x[i - 1] + rng.normal(size=24) * 0.2
    n, _ = against_all_pairs(spark, x, nndescent.Params(neighbours=4, block=40))
    assert n > 10_000


def test_vector_odd_rows(spark):
    rows = [("1", [1.0, 0.0]), ("2", [2.0, 0.0]), ("3", None), ("4", []), ("5", [0.0, 0.0]), ("6", [float("nan"), 1.0]), (None, [1.0, 0.0]), ("7", [1.0, None]), ("8", [1.0]), ("1", [1.0, 0.0]), ("9", [0.0, 1.0]), ("x", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>").selectExpr("*", "1 as id", "2 as v", "3 as `a``b`")
    assert sorted(map(tuple, nndescent.near_duplicates(df).collect())) == [(1, 1, 0, 2), (2, 1, 0, 2), (9, 9, 0, 1)]
    assert nndescent.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("part", ["<script>", "<!--", "<svg>", "<a \"", "<div></x>", "<b><td></td>", "<td><div><b><td></td>", "<noscript", "<style>a</sty", "<p '>", "x < y "])
def test_parser_is_linear(part):
    htmlgraph.parse(part * 500)
    times = []
    for k in (4000, 64_000):
        began = time.process_time()
        htmlgraph.parse(part * k)
        times.append(time.process_time() - began)
    assert times[1] < 60 * times[0] + 0.5


def test_parser_passes_over_what_isnt_text():
    texts = lambda h: [x for x in htmlgraph.parse(h).text if x]
    assert texts("<p>ok</p><script>var a=1;<b>x</b>") == ["ok"] and texts("<style>a{}") == []
    assert texts("<p>a<!-- b --><SCRIPT src='x'>c</ScRiPt >d") == ["a", "d"]
    assert texts("a <! x>b<svg><g>c") == ["a", "b", "c"] and texts("1 < 2 & 3 <x") == ["1 < 2 & 3 <x"]
    assert texts('<a title="1 > 0" href=\'x\'>y</a> <a "b>c') == ["y", "c"]


@pytest.mark.parametrize("most", [1, 7, 50, 1_000_000])
def test_packing_in_parts(docs, most):
    """Classes numbered in many parts are packed as well as in one."""
    rows = packing.packed(docs, packing.Params(part_pieces=most)).collect()
    bins = check_packed(rows, 2048)
    assert sorted(bins) == list(range(len(bins))) and len(rows) == len({(r.doc_id, r.piece) for r in rows})
