"""Vector search, page extraction, archives, Jaccard join and the pipeline."""

import io
import itertools
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from widen.llm import html_extract, jaccard, vector_search, warc
from widen.llm.components import components

SF = "/root/testdata/sf0.001"


# -- vectors ----------------------------------------------------------------

def test_search_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vector_search.nearest(df, F.col("id") % 20 == 0).collect()
    data = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect()}
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r)
        assert r.vec_id != r.query_id
        assert abs(r.score - np.linalg.norm(data[r.query_id] - data[r.vec_id])) < 1e-12
    hit = 0
    for q, v in got.items():
        want = sorted((np.linalg.norm(data[q] - x), k) for k, x in data.items() if k != q)[:10]
        hit += len({k for _, k in want} & {r.vec_id for r in v})
        assert [r.rank for r in sorted(v, key=lambda r: (r.score, r.vec_id))] == list(range(1, 11))
    assert len(got) == 25 and hit >= 0.9 * 250


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]),
            (7, [1.0]), (8, [0.0, 1.0]), (None, [0.5, 0.5]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine"))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in vector_search.nearest(df, F.col("id") < 9).collect())
    assert got == [(0, 1, 1), (0, 2, 8), (1, 1, 0), (1, 2, 8), (8, 1, 0), (8, 2, 1)]
    assert vector_search.nearest(df.where("false"), F.lit(True)).count() == 0
    # many copies of one vector: ties go to the least ids
    many = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    got = {}
    for r in vector_search.nearest(many, F.col("id") % 100 == 0, k=3).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: sorted(v) for q, v in got.items()} == {0: [1, 2, 3], 100: [0, 1, 2], 200: [0, 1, 2]}


def test_search_ties_and_large_values(spark):
    one_hot = [(i, [float(i == j) for j in range(1, 65)]) for i in range(1, 65)]
    df = spark.createDataFrame(one_hot, "vec_id long, embedding array<float>")
    got = {}
    for r in vector_search.nearest(df, F.col("id") % 16 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {16: list(range(1, 11)), 32: list(range(1, 11)), 48: list(range(1, 11)), 64: list(range(1, 11))}
    # squares beyond single precision
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 8)) * 1e20).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = vector_search.nearest(df, F.col("id") % 10 == 0).collect()
    assert len(rows) == 300
    hit = 0
    for q in range(0, 300, 10):
        d = np.linalg.norm(x.astype(np.float64) - x[q].astype(np.float64), axis=1)
        hit += len({r.vec_id for r in rows if r.query_id == q} & set(np.argsort(d)[1:11].tolist()))
    assert hit >= 0.9 * 300


def test_graph_walk_finds_the_nearest_centres():
    rng = np.random.default_rng(1)
    c = vector_search.train_centroids(rng.normal(size=(2000, 16)), 100)
    x = rng.normal(size=(50, 16)).astype(np.float32)
    d = c.distances(x, 0.2, 16)
    full = np.linalg.norm(x[:, None] - c.points, axis=2)
    assert np.mean(d.argmin(1) == full.argmin(1)) > 0.95
    assert np.allclose(d[np.isfinite(d)], full[np.isfinite(d)], atol=1e-3)


# -- pages ------------------------------------------------------------------

PAGE = ('<html><body><div class="top-menu"><a href=#>Home</a> <a>News</a></div><div id="cookieNotice"><p>We use cookies to '
        'improve things. Accept them, please.</p></div><div id="main"><h1>A title</h1><p>The first paragraph is long enough, '
        'and it has sentences.<p>The second   one &amp; more. It is long enough too, surely.</div><div id="comments"><div '
        'class="comment"><p>I like this article, it was great. Thanks for it.</p></div></div><script>var a="<p>x</p>"</script>'
        '<div class="footer">(c) 2020</div></body></html>')


def test_extraction_of_pages_and_other_layouts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    extra = spark.createDataFrame([(-1, "u", PAGE), (-2, None, None), (-3, "u", ""), (-3, "u", ""),
                                   (-4, "u", "<div>" * 3000 + "x")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in html_extract.extract(pages.union(extra).withColumn("text", F.lit("mine"))).collect()}
    assert rows[-1].text == ("A title\n\nThe first paragraph is long enough, and it has sentences.\n\n"
                             "The second one & more. It is long enough too, surely.")
    assert rows[-2].text == "" and rows[-3].n_chars == 0
    for r in pages.limit(40).collect():
        body = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        nodes = html_extract.parse(body)
        assert rows[r.page_id].text == html_extract.kept_text(nodes, [True] * len(nodes))
    assert html_extract.extract(pages.where("false")).count() == 0


def test_extraction_past_elements_without_end(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    body, main = PAGE[6:], '<div id="main">'
    variants = [
        PAGE.replace("Home</a>", '<svg class="icon"/><math/>Home</a>'),
        "<html><head><title>Site</title><meta charset=utf-8><script src=a.js></script><link href=b>" + body,
        "<html><head><title>Site</title><style>p {}</style>" + body.replace("<body>", ""),
        PAGE.replace(main, '<iframe src="x"/><script src="y"/>' + main),
        PAGE.replace(main, '<video src="x"><svg><path d="M0">' + main),
        PAGE.replace(main, '<select><option>One<option>Two</select><svg><svg/><text>no</text></svg>' + main),
    ]
    rows = [(-k, "u", h) for k, h in enumerate([PAGE, *variants], 1)]
    more = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages.union(more)).where("page_id < 0").collect()}
    assert "The first paragraph" in got[-1] and set(got.values()) == {got[-1]}
    # a text in the body ends a head too; an open script has no tags
    assert text_of("<head><title>t</title>one<p>two") == "one\n\ntwo"
    assert text_of("<p>one</p><script>a <p>two</p>") == "one"
    assert text_of("<button>" * 2000 + "<p>one") == "one"


def text_of(html):
    nodes = html_extract.parse(html)
    return html_extract.kept_text(nodes, [True] * len(nodes))


def test_decoding_never_contradicts():
    rnd = random.Random(5)
    nodes = html_extract.parse(html_extract.build_layout(["one two", "three four"], ["five six", "seven"], rnd))
    rng = np.random.default_rng(0)
    for _ in range(20):
        margin = rng.normal(size=len(nodes))
        kept = html_extract.decode(nodes, margin)
        assert all(not k or n.parent is None or kept[n.parent.row] for k, n in zip(kept, nodes))


# -- archives ---------------------------------------------------------------

@pytest.mark.parametrize("limit", [0xFFFFFFFF, 10])
def test_packages_are_zip_files(limit):
    b = io.BytesIO()
    w = warc.PackageWriter(b, limit)  # a small limit makes ZIP64 records
    w.member("a.txt", [b"hello ", b"world"])
    w.member("b/ü.txt", [b""])
    w.close()
    z = zipfile.ZipFile(io.BytesIO(b.getvalue()))
    assert z.testzip() is None and z.read("a.txt") == b"hello world" and z.namelist() == ["a.txt", "b/ü.txt"]
    r = warc.PackageReader(pa.BufferReader(b.getvalue()))
    assert r.read(*r.place("a.txt")) == b"hello world" and r.place("b/ü.txt")[1] == 0


def test_reader_of_foreign_packages():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for i in range(66_000):  # more members than the short end record can count
            z.writestr(str(i), str(i))
        z.comment = b"a comment"
    r = warc.PackageReader(pa.BufferReader(b.getvalue()))
    assert len(r.members) == 66_000 and r.read(*r.place("65999")) == b"65999"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", "y" * 100)
    with pytest.raises(ValueError):
        warc.PackageReader(pa.BufferReader(b.getvalue())).place("x")


def test_records_round_trip(spark, tmp_path):
    rows = [(3, "u", "same"), (1, "u\r\nX: y", "same"), (2, None, None), (5, "u", ""), (4, "v", "é\r\n\r\n日"), (None, "w", "same"),
            (1, "u", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(2)
    df.write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    packages = warc.write_packages(df, str(tmp_path / "out")).checkpoint()
    got = warc.read_packages(packages, str(tmp_path / "out")).collect()
    assert sorted((r.id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got) == sorted(
        [(3, "revisit", 1, 4), (1, "response", 0, 4), (1, "revisit", 1, 4), (0, "revisit", 1, 4), (2, "response", 0, 0),
         (5, "revisit", 2, 0), (4, "response", 0, len("é\r\n\r\n日".encode()))])
    assert {r.payload for r in got if r.id == 4} == {"é\r\n\r\n日"}
    none = warc.write_packages(df.where("false"), str(tmp_path / "none"))
    assert warc.read_packages(none, str(tmp_path / "none")).count() == 0


# -- links ------------------------------------------------------------------

def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1), (2, 5)], "a long, b long")
    assert {r.node: r.component for r in components(e).collect()} == {5: 2, 4: 2, 3: 2, 2: 2, 9: 8, 8: 8, 7: 7}
    assert components(e.where("false")).count() == 0


def test_multiply():
    rng = np.random.default_rng(0)
    a, b = ([np.unique(rng.integers(0, 300, rng.integers(0, 120))) for _ in range(9)] for _ in range(2))
    got = jaccard.multiply(a, b, columns=16)
    assert all(got[i, j] == len(np.intersect1d(x, y)) for i, x in enumerate(a) for j, y in enumerate(b))


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("n, num, block, mask", [(3, 90, 200_000, 2**64 - 1), (5, 80, 300, 2**64 - 1), (3, 90, 200_000, 15)])
def test_jaccard_components_match_brute_force(spark, monkeypatch, n, num, block, mask):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # small blocks: bands, many block pairs
    monkeypatch.setattr(jaccard, "KEY_MASK", mask)  # few bits: different sets with one key
    rnd = random.Random(num)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 4, 20, 60, 150]))] for _ in range(10)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    docs = [(500, None), (501, ""), (502, " \n"), (503, "One TWO"), (504, "one two"), (504, "one two")]
    for i in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 9])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        if rnd.random() < 0.2:
            w = passage + [rnd.choice(vocab) for _ in range(30)]
        docs.append((i, " ".join(w)))
    sets = {i: shingles(t, n) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*docs, (None, "one two")], "doc_id long, text string").withColumn("size", F.lit("mine"))
    rows = jaccard.jaccard_components(df, n=n, num=num).collect()
    assert len(rows) == len(docs) + 1
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == 1
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root(r.doc_id))


def test_shingle_sets_of_odd_words(monkeypatch):
    monkeypatch.setattr(jaccard, "LONG", 20)  # words of 9 to 20 bytes by eights, longer ones by themselves
    rnd = random.Random(8)
    texts = [None, "", " \n", "x", "\x00", "\x00\x00", "a b", "A\tB", "a  b\x0bc", "a\x1cb c", "a\u00a0b c", "\u0130 \u00c4 \u00e4"]
    texts += ["y" * k for k in range(1, 30)] + ["y" * k + "\x00" for k in range(1, 30)] + ["Y" * 17 + z for z in "abA"]
    vocab = ["y" * k + z for k in (0, 1, 7, 8, 15, 16, 19, 20, 40) for z in ("a", "b", "B", "\x00", "\u00e9", "\U0001f600")]
    texts += [rnd.choice(" \t\r").join(rnd.choices(vocab, k=rnd.randrange(12))) + rnd.choice(["", "\n", " "]) for _ in range(400)]
    for n in (1, 3, 5):
        gram, size = jaccard.shingle_sets(texts, n)
        want = [shingles(t, n) for t in texts]
        assert size.tolist() == [len(x) for x in want]
        sets = [x.tolist() for x in np.split(gram, np.cumsum(size)[:-1])]
        assert all(x == sorted(x) for x in sets)
        for (x, a), (y, b) in itertools.combinations(zip(sets, want), 2):
            assert len(set(x) & set(y)) == len(a & b)


def test_words_are_hashed_many_at_a_time(monkeypatch):
    import types

    calls = []

    def digest(raw, *seed):
        calls.append(raw)
        return xxhash.xxh3_64_intdigest(raw, *seed)

    monkeypatch.setattr(jaccard, "xxhash", types.SimpleNamespace(xxh3_64_intdigest=digest, xxh64_intdigest=digest))
    gram, size = jaccard.shingle_sets([" ".join(f"unseen{j}x{k}" for j in range(1000)) for k in range(20)], 3)
    assert size.tolist() == [998] * 20 and len(set(gram.tolist())) == 20 * 998
    assert not calls  # one for each of 20,000 words before


def test_block_of_many_small_sets_in_strips(monkeypatch):
    import tracemalloc

    # 12 words that differ in the first: 9 of 11 grams shared, no link; some of these texts have near copies
    n = 6000
    texts = [f"x{k} " + " ".join(f"t{j}" for j in range(11)) for k in range(n)]
    chain = [" ".join(f"c{j}" for j in range(k, k + 60)) for k in range(0, 40)]  # each links with the next ones only
    gram, size = jaccard.shingle_sets(texts + chain, 3)
    sets = np.split(gram, np.cumsum(size)[:-1])
    bound = jaccard.Bound(90, 100)
    tracemalloc.start()
    found = jaccard._block_links(list(range(len(sets))), size.tolist(), [2] * len(sets), sets, bound)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n * n  # one array of all pairs is more than that
    up = list(range(len(sets)))
    for a, b in found:
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        assert a != b  # a forest
        up[max(a, b)] = min(a, b)
    assert len(found) == len(chain) - 1 and all(a >= n and b >= n for a, b in found)
    monkeypatch.setattr(jaccard, "PAIRS", 50)  # strips of one row
    rnd = random.Random(1)
    small = [np.unique(np.array([rnd.randrange(12) for _ in range(10)], np.uint64)) for _ in range(70)]
    links = {(i, j) for i, j in itertools.combinations(range(70), 2)
             if bound.linked(len(np.intersect1d(small[i], small[j])), len(small[i]), len(small[j]))}
    keys = list(range(70))
    forest = jaccard._block_links(keys, [len(x) for x in small], [2] * 70, small, bound)
    assert {tuple(sorted(e)) for e in forest} <= links and groups(70, forest) == groups(70, links)


def groups(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_jaccard_keeps_little_of_sets_without_partner(spark):
    import pathlib

    from widen.session import checkpoint_dir

    rnd = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [passage + " " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(600)) for _ in range(300)]
    texts.append(texts[7] + " more")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = pathlib.Path(checkpoint_dir(spark))
    before = set(kept.rglob("part-*"))
    rows = jaccard.jaccard_components(df, n=5, num=80).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: 7 if i == 300 else i for i in range(301)}
    assert sum(f.stat().st_size for f in set(kept.rglob("part-*")) - before) < 0.1 * sum(map(len, texts))


@pytest.mark.parametrize("every, run", [(1, 2_000_000), (1, 60), (3, 60)])
def test_own_members(spark, monkeypatch, every, run):
    import collections

    monkeypatch.setattr(jaccard, "RUN", run)  # few members: many chunks and buckets
    rnd = np.random.default_rng(every + run)
    sets = [np.unique(rnd.integers(0, 400, 12)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(80)]
    df = spark.createDataFrame([(k, x.view(np.int64).tolist()) for k, x in enumerate(sets)], "key long, m array<long>").repartition(3)

    def read(b):
        keys = b.column(0).to_numpy().view(np.uint64)
        found = [np.array(x, np.int64).view(np.uint64) for x in b.column(1).to_pylist()]
        yield np.concatenate(found), np.array([len(x) for x in found]), keys, keys

    holders = collections.Counter(m for x in sets for m in x.tolist())
    own = {k: sum(holders[m] == 1 and m % every == 0 for m in x.tolist()) for k, x in enumerate(sets)}
    got = jaccard._own_members(df, read, every, sum(map(len, sets))).collect()
    assert {r.key: r.own for r in got} == {k: v for k, v in own.items() if v} and all(r.key == r.check for r in got)


def test_jaccard_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(df).count() == 0


# -- pipeline ---------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "line_dedup", "jaccard_join",
                                                      "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, last = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == columns and 0 < out.count() <= last
            last = out.count()
        else:
            assert out.where("piece = 0").count() == last
        docs = out


def test_near_duplicates_by_row(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, a, "x"), (2, b, "x"), (2, b, "y"),  # id and text twice
            (3, a + " more", "x"), (3, c, "x"),  # one id, two texts: only one is a near copy
            (None, d, "x"), (None, d + " more", "x"), (7, d, "x"), (None, None, "x"), (8, "", "x"), (8, "", "x"), (9, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    null = [x for x in got if x[0] is None and x[1]]
    assert len(null) == 1 and null[0][1] in (d, d + " more")  # null ids come first, the least key stays
    assert sorted((x for x in got if x not in null), key=str) == sorted(
        [(1, a), (2, b), (3, c), (None, None), (8, ""), (8, ""), (9, " ")], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), SF).count() == 0
