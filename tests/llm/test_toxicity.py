"""Toxicity: the kernel against its definition, held-out texts, tolerance of
inserted characters, edge rows, clashing names."""

import math
import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from widen.llm import toxicity

EDGE = [(1, None), (2, ""), (3, " \n"), (4, "ab"), (5, "a mild text. Another one"), (5, "a mild text. Another one"), (None, "some words"),
        (6, "word " * 30_000), (7, "x" * 50_000), (8, "é 日本語 𝕏 \x0b b"), (9, "a b c d e f g")]


def plain_kernel(a, b):
    def weights(w):
        out = defaultdict(float)
        w = w.lower()
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN and all(w[x].isalnum() for x in (i, j, k)):
                out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = weights(a), weights(b)
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return (sum(v * y[k] for k, v in x.items()) / norm) ** toxicity.POWER if norm else 0.0


def test_kernel_matches_its_definition():
    random.seed(1)
    words = ["".join(random.choice("abcdE.-9é") for _ in range(random.randint(0, 14))) for _ in range(60)] + ["idiot", "i.d.i.o.t"]
    marks = toxicity.Landmarks(words[:30])
    got = defaultdict(float, {(i, j): k for i, j, k in zip(*(x.tolist() for x in marks.kernels(words)))})
    for i, a in enumerate(words):
        for j, b in enumerate(words[:30]):
            assert got[i, j] == pytest.approx(plain_kernel(a, b), abs=1e-9)
    assert plain_kernel("i.d.i.o.t", "idiot") > 0.5 > 0.05 > plain_kernel("other", "idiot")


def test_machine_meets_its_conditions():
    rng = np.random.default_rng(0)
    x = np.c_[rng.normal(size=(400, 5)), np.ones(400)]
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=400) > 0, 1.0, -1.0)
    w, b = toxicity._machine(x.astype(np.float32), y, np.ones(400), 2.0)
    v = np.r_[w, b]
    slack = np.maximum(0, 1 - y * (x.astype(np.float32) @ v))
    ridge = np.r_[np.ones(5), 1e-3]
    assert abs(ridge * v - 4.0 * x.T @ (slack * y)).max() < 0.05  # the gradient vanishes


def sentences(text):
    return toxicity.text_sentences(text)


def made_texts(n, seed=3):
    random.seed(seed)
    syllables = ["ba", "ti", "on", "re", "lu", "mek", "sor", "and", "ith", "pe"]
    insults = ["grobnik", "schlumpf"]
    rows = []
    for i in range(n):
        words = ["".join(random.choices(syllables, k=random.randint(1, 4))) for _ in range(random.randint(20, 120))]
        toxic = int(i % 5 == 0)
        for _ in range(toxic * random.randint(1, 3)):
            words.insert(random.randrange(len(words)), random.choice(insults))
        rows.append((i, " ".join(w + random.choice(["", "", "", ".", ","]) for w in words), toxic))
    return rows


def test_gapped_and_spaced_insults_are_found(spark):
    rows = made_texts(300)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    tricks = ["the g.r.o.b.n.i.k one", "a g-r-o-b-n-i-k", "you g r o b n i k", "Schlumpf!", "schl_umpf here", "schlumpfs are"]
    clean = ["the balu one", "a mek tion", "you re lu sor", "sorlu here"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(tricks + clean)], "doc_id long, text string")
    out = toxicity.classify_toxicity(df.select("doc_id", "text").unionByName(more), labels, F.col("doc_id") % 2 == 0)
    got = {r.doc_id: r for r in out.collect()}
    odd = [(got[i].predicted, t) for i, _, t in rows if i % 2]
    assert sum(p == t for p, t in odd) / len(odd) > 0.97
    assert [got[1000 + i].predicted for i in range(len(tricks + clean))] == [1] * len(tricks) + [0] * len(clean)
    assert "grobnik" in got[0].worst or "schlumpf" in got[0].worst


def test_query_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.op11_toxicity(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
               for k, r in got.items())
    # of the labelled texts here, only English ones differ by what they say, and not all of these
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [(got[r.doc_id], r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    toxic, clean = ([r.score for r, t in rows if r.held_out and t == k and lang[r.doc_id] == "en"] for k in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.9
    assert np.mean([s >= 0.5 for s in toxic]) > 0.85
    assert np.mean([r.predicted for r, t in rows if r.held_out and t == 0]) < 0.05


def test_edge_rows_names_and_empty_tables(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string")
    for name in ("score", "WORST", "x", "id", "label", "sentences", "p.q"):
        df = df.withColumn(name, F.lit("mine"))
    labels = spark.createDataFrame([(4, 0), (5, 1), (6, 0), (8, None), (9, 1), (None, 1), (7, 3)], "doc_id long, toxic int")
    out = toxicity.classify_toxicity(df, labels, F.lit(True))
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "x", "id", "label", "sentences", "p.q", *toxicity.RESULT]
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 and r["p.q"] == "mine" for r in rows)
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.text].add(r.score)
    assert all(len(s) == 1 for s in by_text.values()) and by_text[None] == by_text[""] == by_text[" \n"]
    for own, share in ((labels.where("false"), 0.5), (labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1"), 1.0)):
        assert {r.score for r in toxicity.classify_toxicity(df, own, F.lit(True)).collect()} == {share}
    assert toxicity.classify_toxicity(df.where("false"), labels, F.lit(True)).count() == 0


def test_sentences_are_cut_and_lone_letters_joined():
    assert sentences("One two. Three four! five") == [["One", "two."], ["Three", "four!"], ["five"]]
    assert [len(s) for s in sentences("word " * 50)] == [24, 24, 2]
    assert sentences("so a b c d now") == [["so", "a", "b", "c", "d", "now", "a b c d"]]
    values, starts = np.array([1.0, 1.0, 2.0, 1.0]), np.array([0, 3])
    assert toxicity.distinct_sums(values, starts).tolist() == [3.0, 1.0]
