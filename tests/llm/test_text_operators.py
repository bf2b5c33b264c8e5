"""Quality rules, classifier, language, tokenizers, packing, line dedup: brute
force, exact round trips and the edge cases that every operator defines."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from widen.llm import classifier, language_crf, line_dedup, packing, quality_rules, sentencepieces
from widen.llm.common import Recent, slices

SF = "/root/testdata/sf0.001"
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two three one two three"), (5, "one two three one two three"),
        (None, "a b c a b c"), (6, "word " * 30_000), (7, "x" * 50_000), (8, "é 日本 𝕏 \x0b b"), (9, "a\n\na\n b \na")]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string")
    # names that clash with results
    return df.withColumn("kept", F.lit("mine")).withColumn("N_WORDS", F.lit("mine")).withColumn("score", F.lit("mine"))


@pytest.fixture(scope="module")
def nothing(edge):
    return edge.where("false")


def words(t):
    return (t or "").encode().split()


def repeated(w):
    c = Counter(zip(w, w[1:], w[2:]))
    return len({i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for k in range(3)})


# -- quality rules ----------------------------------------------------------

def test_rules_match_brute_force(spark, edge):
    rows = quality_rules.quality_rules(edge).collect()
    assert sorted(r.n_words for r in rows) == sorted(len(words(t)) for _, t in EDGE)
    random.seed(0)
    texts = [" ".join(random.choice(["a", "b", "c#", "d|", "e!!"]) for _ in range(random.randint(0, 80))) +
             random.choice(["", "\nx\nx\n", "\n"]) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.quality_rules(df).collect():
        t, w = texts[r.doc_id], words(texts[r.doc_id])
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeated(w))
        assert r.base_failed == (len(w) < 50 or 100 * repeated(w) > 50 * len(w))
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_rules_filter_after_and_empty(edge, nothing):
    out = quality_rules.quality_rules(edge)
    assert out.where("kept").count() == 0 and out.where("base_failed").count() == len(EDGE)
    assert quality_rules.quality_rules(nothing).count() == 0
    assert quality_rules.quality_rules(edge, rules=()).where("size(failed_rules) > 0").count() == 0


# -- classifier -------------------------------------------------------------

def test_classifier_held_out(spark):
    from widen.llm.classifier import op3_quality_classifier

    got = {r.doc_id: r for r in op3_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    test = [(got[r.doc_id].score, r.quality) for r in labels if got[r.doc_id].held_out]
    good, bad = ([s for s, q in test if q == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)
               for k, r in got.items())


def test_classifier_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (5, 1), (6, 0), (9, 1)], "doc_id long, quality int")
    rows = classifier.classify_quality(edge, labels, F.lit(True)).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    same = [r.score for r in rows if r.doc_id == 5]
    assert same[0] == same[1]
    one = classifier.classify_quality(edge, labels.where("quality = 1"), F.lit(True)).collect()
    assert {r.score for r in one} == {1.0}
    none = classifier.classify_quality(edge, labels.where("false"), F.lit(True)).collect()
    assert {r.score for r in none} == {0.5}
    assert classifier.classify_quality(nothing, labels, F.lit(True)).count() == 0


# -- language ---------------------------------------------------------------

def test_forward_backward_is_that_of_the_whole_chain():
    rng, k = np.random.default_rng(0), 3
    lengths = np.array([5, 1, 70, 33])
    s, moves = rng.normal(size=(lengths.sum(), k)), rng.normal(size=(k, k))
    got, expected = language_crf.forward_backward(s, lengths, moves, chunk=8)
    at, t, total = 0, np.exp(moves), np.zeros((k, k))
    for n in lengths:
        e = np.exp(s[at:at + n])
        a, b, p = np.zeros((n, k)), np.ones((n, k)), np.full(k, 1 / k)
        before = []
        for i in range(n):
            before.append(p)
            a[i] = (p @ t) * e[i]
            p = a[i] = a[i] / a[i].sum()
        for i in range(n - 2, -1, -1):
            b[i] = t @ (e[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        g = a * b
        assert np.allclose(got[at:at + n], g / g.sum(1, keepdims=True))
        for i in range(n):
            x = before[i][:, None] * t * (e[i] * b[i])
            total += x / x.sum()
        at += n
    assert np.allclose(expected, total)


def test_language_held_out_and_edges(spark, edge, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_crf.fit(docs, ~language_crf.held_out(), sample=60)
    got = language_crf.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language_crf.held_out())
    assert got.where("lang = lang_pred").count() / got.count() > 0.95
    rows = language_crf.identify(edge, model).collect()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == len(EDGE)
    assert language_crf.identify(nothing, model).count() == 0
    blank = language_crf.fit(docs.where("false"), F.lit(True))
    assert {r.lang_pred for r in language_crf.identify(edge, blank).collect()} == {"und"}


def test_language_runs_of_spliced_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL")
    model = language_crf.fit(docs, ~language_crf.held_out(), sample=60)
    pure = language_crf.identify(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").where(
        language_crf.held_out()).where("lang = lang_pred AND size(runs) = 1").orderBy("doc_id").collect()
    by = defaultdict(list)
    for r in pure:
        if len(language_crf.words_of(r.text)) >= 40:
            by[r.lang].append(" ".join(r.text.split()[:60]))
    langs = sorted(k for k, v in by.items() if len(v) > 2)
    spliced, truth = [], {}
    for k, (a, b) in enumerate((a, b) for a in langs for b in langs if a != b):
        parts = [(by[a][0], a), (by[b][1], b), (by[a][2], a)]
        text = " ".join(t for t, _ in parts)
        spliced.append((k, "\u0130 " * (k % 2) + text))  # a capital of two characters in lower case
        truth[k] = [g for t, g in parts for _ in language_crf.words_of(t)]
    assert len(spliced) > 2
    right = total = 0
    for r in language_crf.identify(spark.createDataFrame(spliced, "doc_id long, text string"), model).collect():
        text = spliced[r.doc_id][1]
        assert all(x.end <= y.start and x.lang != y.lang for x, y in zip(r.runs, r.runs[1:]))
        got = [x.lang for x in r.runs for _ in language_crf.words_of(text[x.start:x.end])]
        assert len(got) == len(language_crf.words_of(text)) and text[r.runs[-1].end - 1:r.runs[-1].end].isalpha()
        got = got[len(got) - len(truth[r.doc_id]):]
        right += sum(x == y for x, y in zip(got, truth[r.doc_id]))
        total += len(got)
    assert right > 0.95 * total
    assert language_crf.places_of("\u0130a b") == [(0, 1), (1, 2), (3, 4)]
    rows = language_crf.identify(spark.createDataFrame([(1, None), (2, ""), (3, "1 2")], "doc_id long, text string"), model)
    assert [r.runs for r in rows.collect()] == [[], [], []]


def test_language_sample_is_bounded_by_texts(spark, monkeypatch):
    rows = [(7, f"word{k} here", "en") for k in range(200)] + [(7, "ein wort", "de")] + [
        (i, f"text {i}", "en") for i in range(100, 110)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {}
    monkeypatch.setattr(language_crf, "train", lambda texts, langs: got.update(texts=texts, langs=langs))
    for sample in (1, 5, 50):  # a repeated id takes one place, with one text
        language_crf.fit(docs, F.lit(True), sample=sample)
        assert got["langs"].count("en") == min(sample, 11) and got["langs"].count("de") == 1
        assert sum(t.startswith("word") for t in got["texts"]) <= 1


# -- sentencepiece ----------------------------------------------------------

def test_sentencepiece_equals_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m, sp = sentencepieces.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    random.seed(2)
    parts = ["a", "word", " ", "  ", "\n", "\t", "é", "!", "12", " the", "'s", " ", "　", "日", "<s>", ".", "▁", "𝕏",
             "\x00", "ing", "①", "▁▁", " " * 9, "x" * 250]
    for _ in range(1500):
        t = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        ids, starts, ends = m.encode(t)
        assert ids.tolist() == sp.encode(t, add_eos=True)
        assert m.decode(ids.tolist()) == sp.decode(ids.tolist())
        assert starts[0] == 0 and ends[-1] == len(t.encode()) and (starts[1:] == ends[:-1]).all()
    for _ in range(500):
        ids = [random.randint(0, random.choice([258, 31999])) for _ in range(random.randint(0, 8))]
        assert m.decode(ids) == sp.decode(ids)


@pytest.mark.parametrize("strip", [False, True])
def test_normaliser_equals_the_library(strip):
    import sentencepiece

    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, remove_extra_whitespaces=strip,
                                              escape_whitespaces=False)
    blob = next(dict(sentencepieces._fields(v)).get(2, b"") for k, v in sentencepieces._fields(n.serialized_model_proto())
                if k == 3)
    m = sentencepieces.Model(public_tokenizers.path("piece_bpe_32k.model"))
    m.map, m.escape, m.dummy_prefix, m.strip_blanks = sentencepieces.CharacterMap(blob), False, False, strip
    random.seed(3)
    for _ in range(1000):
        t = "".join(random.choice(["ﬁ", "①", "é", "é", "　", " ", "  ", "ａ", "日", "a", "\n", "½"])
                    for _ in range(random.randint(0, 8)))
        text, align = m.normalise(t)
        assert text == n.normalize(t) and len(align) == len(text.encode()) + 1 and align == sorted(align)


def test_sentencepiece_edges(edge, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = edge.withColumn("ids", F.lit("mine"))
    rows = sentencepieces.encode_pieces(df, path).collect()
    assert len(rows) == len(EDGE) and rows[0].ids == [2] and rows[1].decoded == ""
    assert {r.decoded for r in rows} == {t or "" for _, t in EDGE}
    assert sentencepieces.encode_pieces(nothing, path).count() == 0


def test_signs_that_are_no_letters_have_no_language():
    for t in ("½ ² ①", "ⅷ", "12 _ ½a½"):
        assert language_crf.words_of(t) == (["½a½"] if "a" in t else [])
        assert len(language_crf.places_of(t)) == len(language_crf.words_of(t))


def test_texts_are_drawn_by_hash_whatever_the_share(spark):
    # one language has most rows, many of them with one id
    rows = [(i % 4000, f"alpha beta {i % 7}", "big") for i in range(6000)] + [(9000 + i, "gamma delta", "small") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_crf.fit(df, F.lit(True), sample=40)
    got = {r.lang_pred for r in language_crf.identify(spark.createDataFrame([(1, "beta"), (2, "gamma")], "doc_id long, text string"), model).collect()}
    assert sorted(model.labels) == ["big", "small"] and got == {"big", "small"}


# -- packing ----------------------------------------------------------------

def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, t = packing.WordEncoder(path), Tokenizer.from_file(path)
    random.seed(1)
    parts = ["a", "word", " ", "  ", "\n", "\t", " ", "é", "!", "12", " the", "'s", "日", "<|endoftext|>", "\r\n", "'ll",
             "\x1c", "ª", "²", "Ü!!"]
    for _ in range(3000):
        x = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        assert e.encode([x])[0].tolist() == t.encode(x, add_special_tokens=False).ids


def test_pieces_equal_the_library(spark, edge):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [t for _, t in EDGE] + [" " * 400_000 + "a", "<|endoftext|> x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in packing.pack_documents(df, path, size=64, end_id=0).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in enumerate(texts):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 64 if len(ids) > 64 else len(ids)
        cuts = ([(0, head)] if head else []) + [(s, 64) for s in range(head, len(ids), 64)]
        assert sorted(got[i]) == [(k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())) for k, (s, n) in enumerate(cuts)]


def test_bounds_and_best_fit():
    rng = np.random.default_rng(4)
    for _ in range(60):
        x = np.sort(rng.integers(1, 21, rng.integers(0, 30)))[::-1]
        bins, offsets, n = packing.best_fit_decreasing(x, 20)
        room = defaultdict(list)
        for b, o, s in zip(bins, offsets, x):
            room[b].append((o, s))
        assert len(room) == n and packing.lower_bound(x, 20) <= n
        for v in room.values():
            at = 0
            for o, s in sorted(v):
                assert o == at
                at += s
            assert at <= 20
    # seven items over half the size need a bin each, which their sum does not show
    assert packing.lower_bound(np.array([11] * 7), 20) == 7
    assert packing.piece_bounds(5, 2) == [(0, 1), (1, 2), (3, 2)] and packing.piece_bounds(2, 2) == [(0, 2)]


def test_packing_places_everything_once(spark, edge, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(edge.select("doc_id", "text"))
    rows = packing.pack_documents(docs, path, part_pieces=50).collect()
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(seqs) <= -(-total // 2048) * 1.02 + 2
    assert sum(r.piece == 0 for r in rows) == docs.count()
    assert packing.pack_documents(nothing, path).count() == 0


# -- line dedup -------------------------------------------------------------

def brute_deleted(docs, gram, window):
    tables = {i: line_dedup.line_table(t) for i, t in docs}
    marks = [(h, i, s) for i, _ in docs for h, s in line_dedup.fingerprints(*tables[i], gram, window)]
    first, out = {}, defaultdict(set)
    for h, i, s in marks:
        first[h] = min(first.get(h, (i, s)), (i, s))
    for h, i, s in marks:
        j, r = first[h]
        if (j, r) != (i, s):
            a, b = tables[i][0], tables[j][0]
            lo = hi = s
            while lo > 0 and lo - 1 - s + r >= 0 and a[lo - 1] == b[lo - 1 - s + r]:
                lo -= 1
            while hi < len(a) and hi - s + r < len(b) and a[hi] == b[hi - s + r]:
                hi += 1
            out[i] |= set(range(lo, hi))
    return out


def test_line_dedup_matches_brute_force(spark):
    random.seed(3)
    pool = [" ".join(random.choice("abcdefgh") for _ in range(random.choice([3, 8, 12, 30, 60]))) for _ in range(40)]
    docs = [(i, "\n".join(random.choice([*pool, " "]) for _ in range(random.randint(0, 12)))) for i in range(100)]
    passage = ["p " * 20, "q " * 20, "r " * 20]
    for i in range(0, 100, 7):
        d = docs[i][1].split("\n")
        docs[i] = (i, "\n".join(d[:2] + passage + d[2:]))
    want = brute_deleted(docs, 25, 50)
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        assert (got[i].text, got[i].n_deleted) == line_dedup.delete_lines(t, [(k, k + 1) for k in want.get(i, ())])
    # the guarantee: a passage of 60 words stays in its first document only
    assert [i for i in range(0, 100, 7) if passage[0].strip() in got[i].text] == [0]


def later_copies(docs, least):
    """Lines in a run of ``least`` words or more that equals an earlier run: all
    runs of all documents, without marks or windows."""
    seen, out = set(), defaultdict(set)
    for i, t in docs:
        lines = [x.strip() for x in t.split("\n") if x.strip()]
        for a in range(len(lines)):
            runs = [tuple(lines[a:b]) for b in range(a + 1, len(lines) + 1)]
            for r in runs:
                if sum(len(x.split()) for x in r) >= least:
                    if r in seen:
                        out[i] |= set(range(a, a + len(r)))
                    seen.add(r)
    return out


def test_line_dedup_finds_every_long_run(spark):
    def line(name, n):
        return " ".join(f"{name}{k}" for k in range(n))

    docs = []
    for g in range(12):  # each line G stands first in a document that has nothing else of the others
        base, run = 10 * g, [line(f"x{g}", 10), line(f"g{g}", 30), line(f"y{g}", 15)]
        docs += [(base, "\n".join([line(f"a{g}", 40), run[1], line(f"b{g}", 40)])),
                 (base + 1, "\n".join([line(f"c{g}", 40), *run, line(f"d{g}", 40)])),
                 (base + 2, "\n".join([line(f"e{g}", 40), *run, line(f"f{g}", 40)]))]
        # less than a window behind and before a long line whose first copy stands alone
        long, beside = line(f"l{g}", 60), [line(f"u{g}", 5), line(f"v{g}", 5)]
        docs += [(base + 3, long), (base + 4, "\n".join([beside[0], long, beside[1], line(f"h{g}", 40)])),
                 (base + 5, "\n".join([line(f"i{g}", 40), beside[0], long, beside[1]]))]
    rnd = random.Random(4)
    pool = [line(f"p{k}_", rnd.choice([3, 8, 12, 30, 60])) for k in range(25)]
    docs += [(200 + i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))) for i in range(80)]
    rows = line_dedup.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")).join(
        spark.createDataFrame(docs, "id long, text string").select("id", line_dedup._key("id", "text").alias("doc")), "doc")
    got = {r.id: {k for a, b in r.runs for k in range(a, b)} for r in rows.collect()}
    want, short = later_copies(docs, 50), later_copies(docs, 25)
    assert want[2] == {1, 2, 3} and want[5] == {1, 2, 3}
    for i, _ in docs:
        assert want[i] <= got.get(i, set()) <= short[i]


def test_line_dedup_edges(spark, edge, nothing):
    long = "w " * 60
    more = spark.createDataFrame([(20, long + "\n" + long), (21, long), (None, long + "\nz")], "doc_id long, text string")
    rows = {(r.doc_id, r.text): r.n_deleted for r in line_dedup.line_dedup(edge.select("doc_id", "text").union(more)).collect()}
    assert rows[(1, None)] == 0 and rows[(None, long + "\nz")] == 0  # null ids come first
    assert rows[(20, "")] == 2 and rows[(21, "")] == 1
    assert line_dedup.line_dedup(nothing).count() == 0
    assert "kept" in line_dedup.line_dedup(edge).columns


# -- helpers ----------------------------------------------------------------

def test_slices_and_recent():
    assert list(slices(["aa", None, "bbb", "c"], 3)) == [(0, 3), (3, 4)] and list(slices([], 3)) == []
    seen = []
    r = Recent(2)

    def learn(keys):
        seen.extend(keys)
        return [k * 2 for k in keys]

    for keys in ({1, 2, 3}, {1, 4}, {5, 6}, {1}):
        got = r.known(keys, learn)
        assert all(got[k] == 2 * k for k in keys)
    assert seen.count(1) == 1  # it returned from the old generation


def test_equal_lines_take_linear_work(spark):
    import time

    text = "\n".join(["one two three four five"] * 20_000)
    start = time.time()
    rows = line_dedup.line_dedup(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert time.time() - start < 60
    first, second = sorted(rows)
    assert second.text == "" and second.n_deleted == 20_000
    assert first.n_deleted == 20_000 - 1 and first.text == "one two three four five"


INTERNAL = ("x", "t", "doc", "runs", "__w", "__l", "__m", "__s", "__p", "__doc", "lines", "mark", "id", "key", "__n",
            "__later", "__row", "row", "n", "later", "a.b")


def test_input_columns_of_any_name_are_kept(spark):
    df = spark.createDataFrame([(1, "word " * 60 + "\nb"), (2, "word " * 60 + "\nb"), (3, None)], "doc_id long, text string")
    for c in INTERNAL:
        df = df.withColumn(c, F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")))
    for out in (quality_rules.quality_rules(df), line_dedup.line_dedup(df)):
        rows = out.collect()
        assert len(rows) == 3 and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in INTERNAL)
