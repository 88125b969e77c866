import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from silkmill.llm import editprint, linededup, simhash


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        c = [i + 1]
        for j, y in enumerate(b):
            c.append(min(p[j + 1] + 1, c[j] + 1, p[j] + (x != y)))
        p = c
    return p[-1]


# --- line dedup


@settings(max_examples=150, deadline=None)
@given(st.text("abé", max_size=40), st.text("abé", max_size=40), st.lists(st.tuples(st.integers(0, 40), st.sampled_from("abx"), st.booleans()), max_size=3))
def test_edit_distance(a, b, edits):
    c = list(a)
    for at, ch, insert in edits:
        at = min(at, len(c))
        c[at : at + (not insert)] = [ch]
    pairs = [(a, b), (a, "".join(c)), (b, a)]
    for most in (1, 2):
        got = linededup.edit_distances([x for x, _ in pairs], [y for _, y in pairs], most)
        assert got.tolist() == [min(most + 1, levenshtein(x, y)) for x, y in pairs]


def brute_lines(rows):
    """(doc_id, line_no) that go, by comparing every line with all before it."""
    lines = sorted({(i, k, x) for i, t in rows if i is not None and t is not None for k, x in enumerate(t.split("\n")) if x.strip(" ")})
    gone = set()
    for n, (i, k, x) in enumerate(lines):
        for j, m, y in lines[:n]:
            tau = int(linededup.threshold(np.array([min(len(x), len(y))]), linededup.Params())[0])
            if x == y or (tau and abs(len(x) - len(y)) <= tau and levenshtein(x, y) <= tau):
                if (i, k) != (j, m):
                    gone.add((i, k))
                    break
    return gone


def noisy(rng, x):
    x = list(x)
    for _ in range(rng.randint(0, 4)):
        at = rng.randint(0, len(x))
        x[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "é"])
    return "".join(x)


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([3, 10, 12, 23, 24, 25, 40, 90]))) for _ in range(25)]
    rows = [(i, "\n".join(noisy(rng, rng.choice(base)) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    rows += [(None, base[0]), (70, None), (71, ""), (72, " \n\n"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = linededup.dropped_lines(df).collect()
    want = brute_lines(rows)
    assert {(r.doc_id, r.line_no) for r in got} == want and len(got) == len(want) and {r.kind for r in got} == {"exact", "near"}
    kept = {r.doc_id: r.text for r in linededup.without_copies(df.where("doc_id is not null").dropDuplicates()).collect()}
    for i, t in rows:
        if i is not None and t:
            left = [x for k, x in enumerate(t.split("\n")) if (i, k) not in want]
            if any((i, k) in want for k in range(len(t.split("\n")))):
                assert (i in kept) == any(x.strip() for x in left) and (i not in kept or kept[i] == "\n".join(left))
            else:
                assert kept[i] == t


def test_lines_meet_one_way_round():
    """All pairs within the threshold are candidates, with eleven records a long line: those of one length need no probe at the same place, nor one each way."""
    rng = random.Random(14)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([11, 12, 13, 22, 23, 24, 25, 26, 40, 90]))) for _ in range(30)]
    lines = sorted({noisy(rng, rng.choice(base)) for _ in range(500)} - {""})
    r, key = linededup.keyed(lines + lines[:50], np.array([*range(len(lines)), *range(50)], np.int64))
    long_ = [x for x in lines if len(x) > 26]
    assert len(r) == len(key) and len(linededup.keyed(long_, np.arange(len(long_)))[0]) == 11 * len(long_)
    got = {tuple(x) for x in linededup.candidates(r).tolist()}
    assert all(a < b for a, b in got)
    for j, y in enumerate(lines):
        for i, x in enumerate(lines[:j]):
            tau = int(linededup.threshold(np.array([min(len(x), len(y))]), linededup.Params())[0])
            assert not tau or abs(len(x) - len(y)) > tau or levenshtein(x, y) > tau or (i, j) in got
    assert len(linededup.candidates(r[:0])) == 0


def test_places_of_lines():
    """The first place of each line, and the others once each, by all four columns; signs of ids and hashes count."""
    rng = np.random.default_rng(5)
    r = np.zeros(400, linededup.PLACE)
    for c in linededup.PLACE.names:
        r[c] = rng.integers(-2, 3, 400)
    r["line"] += 2
    want = {}
    for h, g, doc, text, line in r.tolist():
        want.setdefault((h, g), set()).add((doc, line, text))
    first, later, of = linededup.placed(r)
    assert {(h, g): (doc, line, text) for h, g, doc, text, line in first.tolist()} == {k: min(v) for k, v in want.items()} and len(first) == len(want)
    got = [((h, g), (doc, line, text)) for h, g, doc, text, line in later.tolist()]
    assert sorted(got) == sorted((k, x) for k, v in want.items() for x in v if x != min(v))
    assert [(k, min(want[k])) for k, _ in got] == [((h, g), (doc, line, text)) for h, g, doc, text, line in of.tolist()]
    assert [len(x) for x in linededup.placed(r[:0])] == [0, 0, 0]


def test_texts_of_one_id(spark):
    """Lines are taken out of the text that they are of, and not of another with the same id."""
    one = "a line that is long enough to be compared"
    rows = [(1, one), (2, f"own first line of two\n{one}"), (2, "quite another text\nwith a second line of its own"), (2, None)]
    got = linededup.without_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(str(r.text) for r in got) == sorted([one, "own first line of two", "quite another text\nwith a second line of its own", "None"])


def test_line_odd_rows(odd, none):
    got = linededup.without_copies(odd)
    rows = got.collect()
    assert got.columns == odd.columns and got.schema.fieldNames() == odd.schema.fieldNames()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, [1, 1, None, 3, 4, 5, 6, 7, 8]))
    assert linededup.without_copies(none).count() == 0 and linededup.dropped_lines(none).count() == 0


# --- SimHash


def test_golay_is_perfect():
    t = simhash.golay()
    assert np.bincount(t, minlength=4096).tolist() == [2048] * 4096
    v = np.random.default_rng(1).integers(0, 1 << 23, 3000).astype(np.uint32)
    n = (simhash.near_codewords(v) >= 0).sum(1)
    assert set(n.tolist()) <= {1, 6}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, (1 << 23) - 1), st.integers(0, 22), st.integers(0, 22))
def test_two_errors_share_a_codeword(v, i, j):
    k = simhash.near_codewords(np.array([v, v ^ (1 << i) ^ ((1 << j) if i != j else 0)], np.uint32))
    assert set(k[0][k[0] >= 0]) & set(k[1][k[1] >= 0])


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_recall_against_all_pairs(spark, docs):
    p = simhash.fingerprint_table(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    bits = np.unpackbits(np.ascontiguousarray(p[["a", "b", "c"]].to_numpy()).view(np.uint8).reshape(len(p), 24), axis=1).astype(np.float32)
    d = bits.sum(1)[:, None] + bits.sum(1)[None] - 2 * bits @ bits.T
    near = d <= simhash.Params().distance + 0.5
    root = components(len(p), zip(*np.nonzero(np.triu(near, 1)), strict=True))
    ids = p.doc_id.tolist()
    want = {ids[i]: ids[r] for i, r in enumerate(root)}
    got = {r.doc_id: r for r in simhash.groups(docs).collect()}
    assert set(got) == set(ids)
    gone = {i for i in ids if got[i].group_id != i}
    assert gone <= {i for i in ids if want[i] != i} and len(gone) >= 0.9 * sum(want[i] != i for i in ids) > 0
    for k, i in enumerate(ids):  # links are counted over all pairs of a group, of different fingerprints
        other = {tuple(p.loc[j, ["a", "b", "c"]]) for j in np.flatnonzero(near[k] & (d[k] > 0)) if got[ids[j]].group_id == got[i].group_id}
        assert got[i].links == len(other) and got[i].copies == (d[k] == 0).sum()


def flipped(rng, fp, count):
    """fp, as n x 24 bytes, with so many of the 184 bits of each changed."""
    bits = np.unpackbits(fp, axis=1, bitorder="little")
    for row in bits:
        row[rng.permutation(simhash.FINGERPRINT)[:count]] ^= 1
    return np.packbits(bits, axis=1, bitorder="little")


def test_every_pair_within_the_distance_is_connected(spark, monkeypatch):
    """Pairs at exactly the distance all meet, those one beyond it don't, in one block or in many."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, (300, 24), dtype=np.uint8)
    base[:, 23] = 0
    most = simhash.Params().distance
    fp = np.concatenate([base, flipped(rng, base[:200], most), flipped(rng, base[200:], most + 1)]).view("<i8")
    rows = [(i, *map(int, x)) for i, x in enumerate(fp)]
    prints = spark.createDataFrame(rows, "id bigint, a bigint, b bigint, c bigint")
    for block in (simhash.BLOCK, 150):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = components(600, [(r.a, r.b) for r in simhash.near_edges(prints).collect()])
        assert got == [*range(300), *range(200), *range(500, 600)]


def test_masks_cover_any_parts():
    """A crowd, chains and strangers have the components of all pairs, whatever parts and shares."""
    rng = np.random.default_rng(7)
    crowd = flipped(rng, np.repeat(rng.integers(0, 256, (1, 24), dtype=np.uint8), 900, 0), 14)
    chain = [rng.integers(0, 256, (1, 24), dtype=np.uint8)]
    for _ in range(150):
        chain.append(flipped(rng, chain[-1], 26))
    fp = np.concatenate([crowd, *chain, rng.integers(0, 256, (300, 24), dtype=np.uint8)])
    fp[:, 23] = 0
    fp = fp.view("<u8")
    most = simhash.Params().distance
    want = components(len(fp), np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None]).sum(-1) <= most).tolist())
    words = {c: np.ascontiguousarray(fp[:, k]) for k, c in enumerate("abc")}
    assert len(set(want)) < 400
    for parts in (3, 4, 5):
        assert simhash.roots_of(words, most, parts).tolist() == want
    shares = [simhash.roots_of(words, most, 3, k, 5).tolist() for k in range(5)]
    assert components(len(fp), [(i, r[i]) for r in shares for i in range(len(fp))]) == want


def test_simhash_equals_all_pairs(spark, docs):
    """Groups are the components of all pairs within the distance, and links all of them."""
    p = simhash.fingerprint_table(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    fp = np.ascontiguousarray(p[["a", "b", "c"]].to_numpy()).view("<u8")
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(-1)
    near = d <= simhash.Params().distance
    ids = p.doc_id.tolist()
    root = components(len(p), np.argwhere(near).tolist())
    got = {r.doc_id: (r.group_id, r.links) for r in simhash.groups(docs).collect()}
    for k, i in enumerate(ids):
        assert got[i] == (ids[root[k]], len({x.tobytes() for x in fp[near[k] & (d[k] > 0)]}))


def test_simhash_keeps_texts_of_one_id(spark):
    """Rows of one doc_id and different texts are documents of their own; a repeated row is one; a string id that isn't a number is left alone."""
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "a wholly different document with other words in it"
    df = spark.createDataFrame([("5", a), ("5", b), ("5", b), ("a-1", a), (None, a), ("7", a), ("8", None), ("9", "")], "doc_id string, text string")
    kept = sorted((str(r.doc_id), str(r.text)) for r in simhash.one_of_each(df).collect())
    assert kept == sorted([("5", a), ("5", b), ("a-1", a), ("None", a), ("8", "None"), ("9", "")])
    assert sorted((r.doc_id, r.group_id, r.copies) for r in simhash.groups(df).collect()) == [(5, 5, 1), (5, 5, 2), (7, 5, 2)]


def test_keys_that_many_share_stay_cheap():
    """25 strangers under a key, as at 30 GB: under 3 microseconds a record, and their near pairs are found."""
    import time

    rng = np.random.default_rng(5)
    n = 400_000
    r = np.zeros(n, simhash.RECORD)
    r["key"], r["id"] = rng.integers(0, n // 25, n), np.arange(n)
    for c in "abc":
        r[c] = rng.integers(0, 1 << 62, n)
    some = rng.choice(n - 1, 300, replace=False)
    for c in ("key", *"abc"):
        r[c][some + 1] = r[c][some]
    began = time.process_time()
    e = simhash.edges_of(r, 12)
    assert time.process_time() - began < 3e-6 * n
    root = components(n, e.tolist())
    assert all(root[i] == root[i + 1] for i in some.tolist()) and len(e) <= 300


def test_links_between_blocks(spark):
    """A group cut into many blocks has the links of all its pairs."""
    rng = np.random.default_rng(3)
    fp = np.zeros((150, 3), np.int64)
    fp[np.arange(150), 0] = (np.int64(1) << rng.integers(0, 60, 150)) | (np.int64(1) << rng.integers(0, 60, 150))
    fp[:, 1] = (np.int64(1) << rng.integers(0, 40, 150)) - 1
    rows = [(1 + i % 2, i, *map(int, fp[i])) for i in range(150)]
    members = spark.createDataFrame(rows, "root bigint, id bigint, a bigint, b bigint, c bigint")
    old = simhash.blocks_of_groups
    simhash.blocks_of_groups = lambda m: old(m, 20)
    try:
        got = {r.id: r.links for r in simhash.link_counts(members).collect()}
    finally:
        simhash.blocks_of_groups = old
    d = np.bitwise_count(fp[:, None, :] ^ fp[None, :, :]).sum(-1)
    for i in range(150):
        assert got.get(i, 0) == sum(d[i, j] <= simhash.Params().distance for j in range(150) if j != i and j % 2 == i % 2)


def test_big_groups_are_settled():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3).astype(np.uint64)
    r = np.zeros(3000, simhash.RECORD)
    r["id"] = np.arange(3000)
    r["key"] = 5
    for f, b in zip("abc", base, strict=True):
        r[f] = b ^ (np.uint64(1) << rng.integers(0, 60, 3000).astype(np.uint64))
    e = simhash.edges_of(r, 12)
    assert set(components(3000, e.tolist())) == {0} and len(e) < 6000
    r["key"] = np.arange(3000) // 1500  # two crowds and, under each, clusters that only members other than the first link
    for f in "abc":
        r[f][1500:] ^= np.uint64((1 << 60) - 1) * (np.arange(1500) % 2 == 1)
    d = lambda i: sum(np.bitwise_count(r[f][i] ^ r[f]) for f in "abc")
    want = components(3000, [(i, int(j)) for i in range(3000) for j in np.flatnonzero((d(i) <= 12) & (r["key"] == r["key"][i]))])
    assert components(3000, simhash.edges_of(r, 12).tolist()) == want


def test_simhash_odd_rows(odd, none):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, None, 3, 4, 5, 6, 7, 8]))
    assert simhash.one_of_each(none).count() == 0 and simhash.groups(none).count() == 0


# --- fingerprints


def test_fingerprints_recall(docs):
    """Against all pairs of sketches of one class, and against edits planted in a text."""
    rows = {}
    for r in editprint.sketch_table(docs).collect():
        rows.setdefault(r.doc_id, []).append((np.frombuffer(r.sketch, "<u8"), r["keys"]))
    ids = sorted(rows)
    group = {r.doc_id: r.group_id for r in editprint.copies(docs).collect()}
    flat = [(i, s, np.frombuffer(k, "<u8")) for i in ids for s, k in rows[i]]
    s = np.unpackbits(np.ascontiguousarray(np.stack([x for _, x, _ in flat])).view(np.uint8), axis=1).astype(np.float32)
    d = s.sum(1)[:, None] + s.sum(1)[None] - 2 * s @ s.T
    n_class = [len(next(iter(rows[i]))) for i in ids]
    assert n_class
    a, b = np.nonzero(np.triu(d <= editprint.Params().distance + 0.5, 1))
    at = {i: k for k, i in enumerate(ids)}
    text = {r.doc_id: len(r.text) for r in docs.collect() if r.text}
    same = lambda i, j: set(editprint.length_classes(text[i])) & set(editprint.length_classes(text[j]))
    true = {tuple(sorted((flat[x][0], flat[y][0]))) for x, y in zip(a, b, strict=True) if flat[x][0] != flat[y][0] and same(flat[x][0], flat[y][0])}
    assert len(at) == len(group) and np.mean([group[i] == group[j] for i, j in true]) >= 0.9


def test_few_edits_stay_near():
    rng = random.Random(8)
    near = []
    for _ in range(40):
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(1500))
        b = list(a)
        for _ in range(6):
            b[rng.randrange(len(b))] = rng.choice(["", "z", "zz"])
        rows, sk, keys = editprint.sketches([a, "".join(b)])
        x, y = np.flatnonzero(rows == 0)[0], np.flatnonzero(rows == 1)[0]
        near.append(np.bitwise_count(sk[x] ^ sk[y]).sum() <= editprint.Params().distance and (keys[x] == keys[y]).any())
    assert np.mean(near) >= 0.9


def test_sketch_reads_the_whole_text():
    """Texts of a class that differ in the last third only, longest of the class or not, and of any length, are not alike in the sketch."""
    rng = random.Random(9)
    for n in (350, 500, 1600, 2100, 2250, 27_000, 38_000):
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
        b = a[: n * 2 // 3] + "".join(rng.choice("abcdefghijklmnop ") for _ in range(n - n * 2 // 3))
        rows, sk, _ = editprint.sketches([a, b])
        x, y = (sk[np.flatnonzero(rows == i)[0]] for i in (0, 1))
        assert np.bitwise_count(x ^ y).sum() >= 15
    for c in range(editprint.length_classes(100_000)[0]):
        longest = int(editprint.FACTOR ** (c + 1))
        sketch, bands, _ = editprint.sampled_steps(c)
        assert sketch.max() >= 1.9 * longest and (c < 10 or bands.max() >= 1.6 * longest)
    assert editprint.windows(editprint.length_classes(27_000)[0]) > editprint.windows(editprint.length_classes(1000)[0])


@settings(max_examples=100, deadline=None)
@given(st.text("abé", max_size=90), st.text("abé", max_size=90))
def test_whole_edit_distance(a, b):
    assert editprint.edit_distance(a, b) == levenshtein(a, b)


def test_copies_by_edits(spark):
    """Copies with 2 to 8 per cent of edits are found, against the edit distance; texts that share the first two thirds only are none."""
    rng = random.Random(10)
    rows, want = [], {}
    for k in range(60):
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(300, 2500)))
        b = list(a)
        for _ in range(int(len(a) * rng.uniform(0.02, 0.08))):
            b[rng.randrange(len(b))] = rng.choice(["", "z", "zz"])
        c = a[: len(a) * 2 // 3] + "".join(rng.choice("qrstuvwxy") for _ in range(len(a) - len(a) * 2 // 3))
        rows += [(3 * k, a), (3 * k + 1, "".join(b)), (3 * k + 2, c)]
        want[3 * k, 3 * k + 1] = editprint.edit_distance(a, "".join(b))
    rows += [(1000, rows[0][1]), (1000, rows[0][1]), (1001, "")]
    got = {r.doc_id: r for r in editprint.copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    tied = {(a, b) for a, b in want if got[a].group_id == got[b].group_id == a}
    assert len(tied) >= 0.9 * len(want) and all(got[x].distance == want[a, b] and got[x].links == 1 for a, b in tied for x in (a, b))
    assert all(got[a + 2].group_id == a + 2 and got[a + 2].links == 0 and got[a + 2].distance is None for a, _ in want)
    assert got[1000].group_id == 0 and got[0].copies == got[1000].copies == 2 and 1001 not in got and len(got) == 181


@settings(max_examples=150, deadline=None)
@given(st.text("abé", max_size=150), st.text("abé", max_size=150), st.integers(0, 60))
def test_edit_distance_stops_only_beyond(a, b, most):
    assert min(editprint.edit_distance(a, b, most), most + 1) == min(levenshtein(a, b), most + 1)


def test_edits_of_many_pairs():
    """Batches give what each pair by itself gives, over the ends of words, for signs that one text lacks, and whatever share is left open first."""
    rng = random.Random(15)
    params = editprint.Params()
    texts = []
    for n in [1, 3, 20, 63, 64, 65, 127, 128, 200, 400] * 3:
        x = "".join(rng.choice("abcdé😀 ") for _ in range(n))
        texts.append(x)
        for share in (0.02, 0.1, 0.19, 0.25):
            y = list(x)
            for _ in range(int(n * share)):
                y[rng.randrange(len(y))] = rng.choice(["", "z", "zz", "a"])
            texts.append("".join(y) or "q")
    a, b = np.triu_indices(len(texts), 1)
    want = np.array([editprint.edits_apart(texts[i], texts[j], params) for i, j in zip(a, b, strict=True)])
    assert (editprint.edits_of_pairs(texts, a, b, params) == want).all() and (want >= 0).sum() > 150
    size = np.array(list(map(len, texts)))
    a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    most = (params.edits * size[b]).astype(int)
    ok = size[b] - size[a] <= most
    a, b, most, want = a[ok], b[ok], most[ok], want[ok]
    assert (editprint.banded(texts, a, b, size, most) == want).all()
    some = editprint.banded(texts, a, b, size, most, 0.5)
    assert (some == editprint.OPEN).any() and ((some == want) | (some == editprint.OPEN)).all()
    assert editprint.banded(texts, a, b, size, most, signs=3) is None
    assert len(editprint.edits_of_pairs([], a[:0], b[:0], params)) == 0


def test_texts_of_a_band_have_one_home():
    """The home of a text is the key that most texts share with it, so that those compared under it meet in one part."""
    r = np.zeros(26, editprint.RECORD)
    r["id"] = [*range(10), *range(10), 0, 1, 20, 21, 22, 23]
    r["key"] = np.array([1] * 10 + [2, 2, 2, 3, 3, 3, 4, 5, 6, 7] + [8, 8, 9, 9, 10, 11], np.uint64) << np.uint64(40)
    got = dict(editprint.homes(r).tolist())
    assert set(got) == {*range(10), 20, 21} and len({got[i] for i in range(10)}) == 1 and got[20] == got[21] != got[0]
    assert got[0] >> 38 == 10 and got[20] >> 38 == 2 and len(editprint.homes(r[:0])) == 0


def test_all_candidates_of_a_key():
    """All pairs within the distance, under keys of few records and of more than once made a crowd, whatever crowd is."""
    rng = np.random.default_rng(3)
    params = editprint.Params(crowd=100)
    r = np.zeros(505, editprint.RECORD)
    r["id"], r["key"], r["size"] = np.arange(505) % 500, np.arange(505) < 5, rng.integers(80, 120, 505)
    r["s"] = rng.integers(0, 1 << 63, (1, 4)).astype(np.uint64) ^ (rng.integers(0, 1 << 63, (505, 4)) & rng.integers(0, 1 << 63, (505, 4))).astype(np.uint64)
    want = set()
    for i in range(505):
        for j in range(i):
            near = np.bitwise_count(r["s"][i] ^ r["s"][j]).sum() <= params.candidate and abs(int(r["size"][i]) - int(r["size"][j])) <= 0.2 * max(r["size"][i], r["size"][j])
            if r["key"][i] == r["key"][j] and r["id"][i] != r["id"][j] and near:
                want.add((min(int(r["id"][i]), int(r["id"][j])), max(int(r["id"][i]), int(r["id"][j]))))
    got = editprint.candidates(r, params)
    assert {tuple(x) for x in got.tolist()} == want and len(got) == len(want) > 10_000


def test_links_are_of_all_copies(spark):
    """Copies of one text, more than four and each a few edits from the others, are all linked to each other."""
    rng = random.Random(12)
    a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(900))
    rows = [(k, a[: 20 * k + 5] + "z" + a[20 * k + 6 :]) for k in range(40)]
    got = editprint.copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 40 and all(r.group_id == 0 and r.links == 39 and r.distance in (1, 2) for r in got)


def test_a_crowd_is_tied():
    rng = np.random.default_rng(2)
    r = np.zeros(300, editprint.RECORD)
    r["id"] = np.arange(300)
    r["s"] = rng.integers(0, 1 << 63, (1, 4)).astype(np.uint64) ^ (np.uint64(1) << rng.integers(0, 60, (300, 4)).astype(np.uint64))
    for crowd in (100, 4096):
        e = editprint.edges_of(r, editprint.Params(crowd=crowd))
        assert set(components(300, e[:, :2].tolist())) == {0} and len(e) == 299


def test_walks_by_single_steps():
    table = editprint.runs().reshape(editprint.WALKS, editprint.CLASSES, -1)
    cp = np.array([97, 98, 98, 99] * 40, np.uint32)
    at = editprint.walks(cp, np.array([0]), np.array([len(cp)]))
    cls = (editprint.mix(cp.astype(np.uint64)) % np.uint64(editprint.CLASSES)).astype(int)
    for w in range(editprint.WALKS):
        j = 0
        for i, c in enumerate(cls):
            assert at[w, i] == j
            j += int(table[w, c, j % editprint.PERIOD])


def test_fingerprint_odd_rows(odd, none):
    got = editprint.copies(odd).collect()
    assert sorted((r.doc_id, r.group_id, r.links, r.copies) for r in got) == [(1, 1, 0, 2), (2, 1, 0, 2), (5, 5, 0, 1), (6, 6, 0, 1), (7, 7, 0, 1), (8, 8, 0, 1)]
    assert editprint.copies(none).count() == 0


def test_candidates_of_a_crowd_come_in_runs():
    """A band of thousands is all pairs, never at once."""
    r = np.zeros(3000, editprint.RECORD)
    r["key"], r["id"], r["size"] = 7, np.arange(3000) * 5, 100
    runs = [len(x) for x in editprint.candidate_runs(r, most=600_000)]
    assert sum(runs) == 3000 * 2999 // 2 and len(runs) > 5 and max(runs) <= 900_000


def test_few_texts_are_held_and_all_pairs_verified(spark, monkeypatch):
    """With parts of little text, and so many of them, the same pairs."""
    g = np.random.default_rng(12)
    base = "".join(g.choice(list("abcdefgh "), 900))
    rows = []
    for i in range(60):
        x = list(base)
        for at in g.integers(0, 900, i % 12):
            x[at] = "z"
        rows.append((i, "".join(x)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(map(tuple, editprint.copies(docs).collect()))
    monkeypatch.setattr(editprint, "PART_CHARS", 5000)
    monkeypatch.setattr(editprint, "PART_RECORDS", 100)
    monkeypatch.setattr(editprint, "HOME", 8)
    assert sorted(map(tuple, editprint.copies(docs).collect())) == want and max(x[2] for x in want) > 10
