"""Token alignment and source divergence: brute force over whole texts, edge
cases, both ways of joining counts, chunks and blocks of every size."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from widen.llm import divergence, token_alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EDGE = [(1, None), (2, ""), (3, " "), (4, "  "), (5, "one two three"), (5, "one two three"), (None, "one two"),
        (6, "word " * 3_000), (7, "x" * 3_000), (8, "é 日本 𝕏 \x0b b"), (9, "a\n\n a\n  b \na  "), (10, "a▁b c"),
        (11, "<|endoftext|> </s> <0x0A>"), (12, "a \x00 b"), (13, "\x1c a\x1c  b \x85 c　 d"), (14, "it's  'x")]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string")
    for name in ("N_A", "groups", "row", "pair", "pairs", "x", "term", "n", "cells", "p.q"):
        df = df.withColumn(name, F.lit("mine"))
    return df


# -- alignment --------------------------------------------------------------

def plain_alignment(texts):
    """Per text (ids A, ids B, links, groups) over the whole text, by definition."""
    al, own = token_alignment.Aligner(*PATHS), Tokenizer.from_file(PATHS[0])
    own.encode_special_tokens = True
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        a = own.encode(" " + t, add_special_tokens=False).ids
        b = al.b.encode(t)
        raw = (" " + t).encode()
        pa, pb = [al.bytes_a[i] for i in a], [al.bytes_b[i] for i in b]
        if b"".join(pa) != raw or b"".join(pb) != raw:
            out.append(None)
            continue

        def spans(parts):
            at, s = 0, []
            for p in parts:
                s.append((at, at + len(p)))
                at += len(p)
            return s

        sa, sb = spans(pa), spans(pb)
        links, low = [], 0
        for i, (s, e) in enumerate(sa):
            while sb[low][1] <= s:
                low += 1
            j = low
            while j < len(sb) and sb[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e in sa} & {e for _, e in sb}):
            ga, gb = [], []
            while i < len(sa) and sa[i][1] <= end:
                ga.append(str(a[i]))
                i += 1
            while j < len(sb) and sb[j][1] <= end:
                gb.append(str(b[j]))
                j += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        out.append((a, b, links, groups))
    return out


def expected(texts):
    found = plain_alignment(texts)
    count = Counter(p for f in found if f for p in set(f[2]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for f in found:
        if f is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            a, b, links, groups = f
            yield (len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links),
                   sum(count[p] for p in links), ";".join(groups))


def aligned(df, **options):
    out = token_alignment.align_tokens(df, *PATHS, **options)
    return sorted((r.doc_id is not None, r.doc_id or 0, *(r[c] for c in token_alignment.COUNTS), r.groups)
                  for r in out.collect())


@pytest.mark.parametrize("broadcast_pairs", [1_000_000, 0])
def test_alignment_edge_rows_by_either_join(edge, broadcast_pairs):
    want = sorted((i is not None, i or 0, *w) for (i, _), w in zip(EDGE, expected([t for _, t in EDGE])))
    assert aligned(edge, broadcast_pairs=broadcast_pairs, batch_chars=200) == want


def test_alignment_matches_whole_text_brute_force(spark):
    random.seed(4)
    parts = ["the", "Über", "naïve", "x1", "'s", "...", " ", "  ", "\n", "\t", "日本", "🙂", "é", "--", " ", "\x1f",
             "https://a.b/c", "ﬁ", "½", "1234567", "ALL CAPS", "a_b"]
    texts = ["".join(random.choice(parts) + random.choice(["", " ", " "]) for _ in range(random.randint(1, 60)))
             for _ in range(400)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = sorted((True, i, *w) for i, w in enumerate(expected(texts)))
    assert aligned(df) == want


def test_alignment_keeps_columns_and_empty_tables(edge, spark):
    out = token_alignment.align_tokens(edge, *PATHS)
    assert out.columns == ["doc_id", "row", "pair", "pairs", "x", "term", "n", "cells", "p.q", *token_alignment.COUNTS, "groups"]
    assert {r.pairs for r in out.collect()} == {"mine"}
    assert token_alignment.align_tokens(edge.where("false"), *PATHS).count() == 0
    assert token_alignment.align_tokens(edge.where("false"), *PATHS, broadcast_pairs=-1).count() == 0
    only = token_alignment.align_tokens(edge.select("text"), *PATHS)
    assert only.columns == [*token_alignment.COUNTS, "groups"] and only.count() == len(EDGE)


def test_alignment_query_digest(spark):
    got = {r.doc_id: r for r in token_alignment.op13_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    for d, w in zip(docs, expected([d.text for d in docs])):
        assert tuple(got[d.doc_id][c] for c in token_alignment.COUNTS) == w[:6]
        assert got[d.doc_id].groups_sha256 == hashlib.sha256(w[6].encode()).hexdigest()


def test_gallop_against_scan():
    random.seed(5)
    for _ in range(300):
        n = random.randint(1, 60)
        a, b = (sorted({*random.sample(range(1, n + 1), random.randint(1, n)), n}) for _ in range(2))
        # two stretches one after the other
        aa, bb = (np.array(x + [n + e for e in x]) for x in (a, b))
        left, right, common, rank = token_alignment.align_ends(
            aa, np.array([0, len(a), len(aa)]), bb, np.array([0, len(b), len(bb)]))
        assert rank.tolist() == [next(i for i, x in enumerate(bb) if x >= e) for e in aa]
        spans_a, spans_b = (list(zip([0, *x], x)) for x in (aa.tolist(), bb.tolist()))
        assert list(zip(left, right)) == [(i, j) for i, (s, e) in enumerate(spans_a) for j, (u, v) in enumerate(spans_b)
                                          if s < v and u < e]
        assert common.tolist() == [e in bb for e in aa]


# -- divergence -------------------------------------------------------------

def plain_divergence(rows, min_docs, top):
    import re

    term = re.compile(rb"[a-z\x80-\xff]+")
    docs = [(lang or "", source or "", term.findall((text or "").encode().lower())) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        v = len(kept)

        def share(ds):
            c = Counter(t for d in ds for t in d[2] if df[t] >= min_docs)
            n = sum(c.values())
            return c, {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        _, q = share(own)
        groups = {s: share([d for d in own if d[1] == s]) for s in {d[1] for d in own}}
        for s, (c, p) in groups.items():
            pairs = sorted((-sum(f(p[t], o[t]) for t in kept), x.encode()) for x, (_, o) in groups.items() if x != s)
            out |= {(lang, s, "pair", x.decode(), -n, r) for r, (n, x) in enumerate(pairs, 1)}
            terms = sorted((-f(p[t], q[t]), t) for t in kept if c[t] and p[t] > q[t])[:top]
            out |= {(lang, s, "term", t.decode(), -n, r) for r, (n, t) in enumerate(terms, 1)}
    return out


@pytest.mark.parametrize("cells,block", [(1, 1), (40, 2), (2_000_000, 256)])
def test_divergence_matches_brute_force(spark, cells, block):
    random.seed(6)
    words = ["a", "B", "bb", "É", "é", "ßx", "日", "zz9zz", "c\x7fd", "K", "it's", "𝕏"]
    rows = [(random.choice(["en", "de", None, ""]), random.choice(["s1", "s2", "é", None, "z"]),
             random.choice([None, "", *[" ".join(random.choices(words, k=random.randint(0, 30))) for _ in range(6)]]))
            for _ in range(150)]
    rows += [("solo", "only", "a a"), ("none", "u", "q"), ("none", "v", None)] + rows[:20]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("n", F.lit(1)).withColumn(
        "term", F.lit("mine")).repartition(3)
    out = divergence.source_divergence(df, min_docs=3, top=4, chunk_cells=cells, block=block)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows, 3, 4)


def test_divergence_large_counts_long_texts_and_empty(spark, monkeypatch, edge):
    # beyond 64 bits for 10^9 times a count
    import numpy as np

    counts = np.array([0, 5, 40 * 10**9])
    assert divergence.shares(counts, 10**12, 3).tolist() == [1 + 10**9 * (c + 2) // (10**12 + 6) for c in counts.tolist()]
    for size in (1, 3, 7, 100):
        monkeypatch.setattr(divergence, "TEXT_BYTES", size)
        for t in ("", "abc", "ab cd  efghijk l", " x", "é日 Q.", "a" * 20, "a b " * 9):
            raw = t.encode()
            assert [w for p in divergence.text_terms(raw) for w in p] == raw.translate(divergence._TERM_BYTES).split()
    df = edge.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    assert divergence.source_divergence(df.where("false")).count() == 0
    assert divergence.source_divergence(df, min_docs=2).where("part = 'term'").count() == 0


def test_divergence_held_terms_are_handed_on(spark, monkeypatch):
    rows = [("l", f"s{i % 3}", " ".join("abcdefgh"[(i * k) % 8] * (k % 3 + 1) for k in range(9))) for i in range(60)]
    batch = [__import__("pyarrow").RecordBatch.from_arrays(
        [__import__("pyarrow").array(c) for c in zip(*[(a, b, t.encode()) for a, b, t in rows])], ["lang", "source", "text"])]
    total = Counter()
    for limit in (5, 10**6):
        monkeypatch.setattr(divergence, "HELD_TERMS", limit)
        sums = Counter()
        for out in divergence._counted(iter(batch)):
            for r in out.to_pylist():
                sums[r["source"], r["term"], "n"] += r["n"]
                sums[r["source"], r["term"], "docs"] += r["docs"]
        total = total or sums
        assert sums == total
