"""Language of texts by a linear-chain conditional random field over words.

Every word has a score per language from its affixes and inner n-grams (hashed)
and from a learned lexicon; learned transitions tie neighbouring words, so that
a stretch of another language inside a text is labelled as such. Labels of words
come from forward-backward: each word has the label of the greatest marginal, and
neighbouring words of one label are a run (start, one past the end, language), in
characters of the text. The language of a text is the one with the greatest
expected number of letters, where a letter at share x of the text counts
(1 - x) ** fall: training chooses ``fall`` from 0 to 2 on texts set aside, so at
2 the second half of a text counts for an eighth. It is summed from the marginals
themselves, as the runs no longer say how sure each word is.

Training needs only languages of whole texts: words first take their text's
language, and are relabelled by the field itself as it learns, so that stretches
of other languages stop counting for the wrong one.

Defined results: a null text, an empty one and one without a letter are ``und``
with score 0 and have no runs; repeated rows get equal results; an empty table gives an empty
result; without a labelled text every text is ``und`` without runs; null languages are not
learned from; only the id, text and language columns are read.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widen.llm.common import slices

UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")
#: Bound of the word cache of a task, in entries.
CACHE = 500_000


@dataclass
class Field:
    """Parameters: bounded by 2**bits hashed features and the lexicon."""

    labels: list[str]
    bits: int = 16
    grams: np.ndarray | None = None  # 2**bits x label
    lexicon: dict[str, int] = field(default_factory=dict)
    words: np.ndarray | None = None  # lexicon + 1 x label
    moves: np.ndarray | None = None  # label x label, log
    fall: float = 0.0  # how much less the end of a text counts than its start
    key: str = ""

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashed features of all words, one after the other, and owners.

        Grams of 2 to 4 characters of ``^word$``: those with an end mark are the
        affixes.
        """
        marked = [f"^{w}$" for w in words]
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, marked), np.int64, len(words)))
        rows, owners = [], []
        h = codes.copy()
        for n in (2, 3, 4):
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:] + np.uint64(n)
            inside = owner[:len(h)] == owner[n - 1:]
            mixed = h[inside] * np.uint64(0xD6E8FEB86659FD93)
            rows.append((mixed >> np.uint64(64 - self.bits)).astype(np.int64))
            owners.append(owner[:len(h)][inside])
        return np.concatenate(rows), np.concatenate(owners)

    def scores(self, words: list[str]) -> np.ndarray:
        rows, owners = self.features(words)
        k = len(self.labels)
        out = np.stack([np.bincount(owners, self.grams[rows, j], len(words)) for j in range(k)], 1)
        return out + self.words[[self.lexicon.get(w, len(self.lexicon)) for w in words]]


    def marginals(self, docs: list[list[str]]):
        """Marginals and letters of all words, and words of each text."""
        place = {w: i for i, w in enumerate({w for d in docs for w in d})}
        table = self.scores(list(place))
        lengths = np.array([len(d) for d in docs])
        gamma, _ = forward_backward(table[[place[w] for d in docs for w in d]], lengths, self.moves)
        return gamma, np.array([len(w) for d in docs for w in d], float), lengths


def _layout(lengths: np.ndarray, chunk: int):
    """Tokens of sequences, cut into chunks and laid out step by step.

    Returns the place of every token, the number of chunks at each step, the
    sequence and number of every chunk (longest chunks first) and their ranks.
    """
    per = -(-lengths // chunk)
    seq = np.repeat(np.arange(len(lengths)), per)
    number = np.arange(len(seq)) - np.repeat(np.cumsum(per) - per, per)
    size = np.minimum(chunk, lengths[seq] - number * chunk)
    order = np.argsort(-size, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    active = np.searchsorted(-size[order], -np.arange(1, size.max() + 1), side="right")
    start = np.cumsum(active) - active
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return start[step] + np.repeat(rank, size), active, start, seq, number, rank


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, chunk: int = 512):
    """Marginals of every token and expected moves, over all sequences at once.

    ``scores`` holds the log scores of the tokens of all sequences, one after
    the other; every length is positive. A sequence is cut into chunks whose
    transfer matrices are multiplied first; from them come the messages at
    chunk bounds, and then all chunks run side by side. The result is that of
    the whole chain, however long it is.
    """
    k = scores.shape[1]
    t = np.exp(moves)
    at, active, start, seq, number, rank = _layout(lengths, chunk)
    e = np.empty_like(scores)
    e[at] = np.exp(scores - scores.max(1, keepdims=True))
    n = len(seq)
    m = np.tile(np.eye(k), (n, 1, 1))
    many = np.bincount(seq)[seq] > 1  # only chains of several chunks need matrices
    by_rank = np.empty(n, bool)
    by_rank[rank] = many
    for s, a in zip(start, active) if many.any() else ():
        own = np.flatnonzero(by_rank[:a])
        x = (m[own].reshape(-1, k) @ t).reshape(-1, k, k) * e[s + own, None, :]
        m[own] = x / x.sum((1, 2), keepdims=True)
    m = m[rank]  # by chunk
    first, last = np.full((n, k), 1.0 / k), np.ones((n, k))
    for j in range(1, int(number.max()) + 1):
        c = np.flatnonzero(number == j)
        x = np.einsum("ci,cij->cj", first[c - 1], m[c - 1])
        first[c] = x / x.sum(1, keepdims=True)
    ends = number[np.r_[np.flatnonzero(seq[1:] != seq[:-1]), n - 1]][seq] - number
    for j in range(1, int(number.max()) + 1):
        c = np.flatnonzero(ends == j)
        x = np.einsum("cij,cj->ci", m[c + 1], last[c + 1])
        last[c] = x / x.sum(1, keepdims=True)
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    alpha[rank], beta[rank] = first, last
    forward = np.empty_like(e)
    before = np.empty_like(e)
    for s, a in zip(start, active):
        before[s:s + a] = alpha[:a]
        x = (alpha[:a] @ t) * e[s:s + a]
        alpha[:a] = forward[s:s + a] = x / x.sum(1, keepdims=True)
    expected = np.zeros((k, k))
    for s, a in zip(start[::-1], active[::-1]):
        forward[s:s + a] *= beta[:a]
        w = e[s:s + a] * beta[:a]
        x = w @ t.T
        expected += before[s:s + a].T @ (w / (before[s:s + a] * x).sum(1, keepdims=True))
        beta[:a] = x / x.sum(1, keepdims=True)
    forward /= forward.sum(1, keepdims=True)
    return forward[at], expected * t


def shares(gamma: np.ndarray, letters: np.ndarray, lengths: np.ndarray, fall: float) -> np.ndarray:
    """Share of each label in the expected letters of each text. A letter at
    share x of its text counts (1 - x) ** fall."""
    first = np.r_[0, np.cumsum(lengths)[:-1]]
    upto = np.cumsum(letters) - letters / 2
    begun = np.repeat(upto[first] - letters[first] / 2, lengths)
    total = np.repeat(np.add.reduceat(letters, first), lengths)
    weight = letters * (1 - (upto - begun) / total) ** fall
    mass = np.add.reduceat(gamma * weight[:, None], first)
    return mass / mass.sum(1, keepdims=True)


def words_of(text: str | None) -> list[str]:
    return [w for w in _WORDS.findall((text or "").lower()) if w.isalpha() or _has_letter(w)]


def _has_letter(word: str) -> bool:
    """Not a fraction, a raised figure or a figure in a circle alone."""
    return any(map(str.isalpha, word))


def places_of(text: str) -> list[tuple[int, int]]:
    """(start, one past the end) in ``text`` of each of its words."""
    low = text.lower()
    spans = [m.span() for m in _WORDS.finditer(low) if _has_letter(m.group())]
    if len(low) != len(text):  # a few capitals are two characters in lower case
        at = [i for i, c in enumerate(text) for _ in c.lower()]
        spans = [(at[a], at[b - 1] + 1) for a, b in spans]
    return spans


def train(texts: list[str], langs: list[str], rounds: int = 20, relabel_from: int = 5, lexicon: int = 20_000,
          rate: float = 0.3, bits: int = 16, seed: str = "") -> Field:
    """Gradient ascent on the likelihood of word labels, with the adaptive step
    sizes of each parameter."""
    labels = sorted(set(langs))
    k = len(labels)
    docs = [words_of(t) for t in texts]
    every = [(d, labels.index(g)) for d, g in zip(docs, langs) if d]
    aside = every[::5] if len(every) >= 20 else []  # for the choice of ``fall`` below
    pairs = [p for i, p in enumerate(every) if not aside or i % 5]
    counts: dict[str, int] = {}
    for d, _ in pairs:
        for w in d:
            counts[w] = counts.get(w, 0) + 1
    frequent = sorted((w for w, c in counts.items() if c > 2), key=lambda w: (-counts[w], w))[:lexicon]
    f = Field(labels, bits, np.zeros((2 ** bits, k)), {w: i for i, w in enumerate(frequent)},
              np.zeros((len(frequent) + 1, k)), np.where(np.eye(k) > 0, 2.0, -2.0), 0.0, seed or uuid.uuid4().hex)
    if not pairs:
        return f
    types = {w: i for i, w in enumerate(counts)}
    tokens = np.array([types[w] for d, _ in pairs for w in d])
    lengths = np.array([len(d) for d, _ in pairs])
    label = np.repeat([g for _, g in pairs], lengths)
    own = label.copy()
    rows, owners = f.features(list(types))
    lex = np.array([f.lexicon.get(w, len(f.lexicon)) for w in types])
    first = np.r_[0, np.cumsum(lengths)[:-1]]
    inside = np.ones(len(tokens), bool)
    inside[first] = False
    sums = [np.full_like(p, 1e-2) for p in (f.grams, f.words, f.moves)]
    for r in range(rounds):
        score = np.stack([np.bincount(owners, f.grams[rows, j], len(types)) for j in range(k)], 1) + f.words[lex]
        gamma, moved = forward_backward(score[tokens], lengths, f.moves)
        if r >= relabel_from and r % 5 == 0:
            best = gamma.argmax(1)
            own = np.where(gamma[np.arange(len(best)), best] > 0.9, best, label)
        hit = np.eye(k)[own]
        diff = np.stack([np.bincount(tokens, (hit - gamma)[:, j], len(types)) for j in range(k)], 1)
        seen = np.zeros((k, k))
        np.add.at(seen, (own[:-1][inside[1:]], own[1:][inside[1:]]), 1)
        # the first word of a text is entered from every label alike
        seen += np.outer(np.full(k, 1 / k), np.bincount(own[first], minlength=k))
        scale = 1 / len(tokens)
        grads = [np.stack([np.bincount(rows, diff[owners, j], 2 ** bits) for j in range(k)], 1) * scale
                 - 1e-6 * f.grams,
                 np.stack([np.bincount(lex, diff[:, j], len(f.words)) for j in range(k)], 1) * scale - 1e-6 * f.words,
                 (seen - moved) * scale]
        for p, g, s in zip((f.grams, f.words, f.moves), grads, sums):
            s += (g * 1e3) ** 2
            p += rate * g * 1e3 / np.sqrt(s)
    f.grams = f.grams.astype(np.float32)
    if aside:  # a text in two languages is marked with one: learn where it is looked for
        gamma, letters, lengths = f.marginals([d for d, _ in aside])
        wanted = np.array([g for _, g in aside])
        f.fall = max((0.0, 0.25, 0.5, 1.0, 2.0),
                     key=lambda x: np.log(shares(gamma, letters, lengths, x)[np.arange(len(wanted)), wanted]
                                          + 1e-6).mean())
    return f


class Scorer:
    """Word scores through a cache, texts through the field."""

    def __init__(self, model: Field):
        self.model = model
        self.place: dict[str, int] = {}
        self.table = np.empty((0, len(model.labels)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, score and runs of each text."""
        docs = [words_of(t) for t in texts]
        full = [i for i, d in enumerate(docs) if d]
        out = [(UNKNOWN, 0.0, [])] * len(docs)
        if not full or not self.model.labels:
            return out
        unseen = {w for d in docs for w in d}.difference(self.place)
        if len(self.place) + len(unseen) > CACHE:
            self.place, self.table = {}, self.table[:0]
            unseen = {w for d in docs for w in d}
        if unseen:
            new = list(unseen)
            self.place.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, self.model.scores(new)])
        place = self.place.__getitem__
        lengths = np.array([len(docs[i]) for i in full])
        tokens = np.fromiter((place(w) for i in full for w in docs[i]), np.int64, lengths.sum())
        letters = np.fromiter((len(w) for i in full for w in docs[i]), np.float64, lengths.sum())
        gamma, _ = forward_backward(self.table[tokens], lengths, self.model.moves)
        best = gamma.argmax(1)
        ends = np.cumsum(lengths)
        for i, m, n, end in zip(full, shares(gamma, letters, lengths, self.model.fall), lengths, ends):
            j = int(m.argmax())
            own, place = best[end - n:end], places_of(texts[i])
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            runs = [(place[a][0], place[b - 1][1], self.model.labels[own[a]])
                    for a, b in zip(first.tolist(), [*first[1:].tolist(), int(n)])]
            out[i] = self.model.labels[j], float(min(1.0, m[j])), runs
        return out


_SCORERS: dict[str, Scorer] = {}


def scorer(model: Field) -> Scorer:
    """The scorer that a worker keeps for a model, with its cache."""
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model)
    return _SCORERS[model.key]


def fit(docs: DataFrame, learn: Column, sample: int = 250, id_col: str = "doc_id", text: str = "text",
        lang: str = "lang") -> Field:
    """Fit on at most ``sample`` texts of each language, those with the least
    hashes of their ids, among the rows where ``learn`` holds. An id counts once
    for each of its languages, with the text of the least hash, so that no more
    than that is read however often ids repeat."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(id_col).isNotNull())
    ids = rows.select(F.col(id_col).alias("__id"), F.col(lang).alias("__lang"),
                      F.xxhash64(F.col(id_col).cast("string")).alias("__h"))
    # a hash share first, about three times what is wanted: a language of a third of all rows sends no more
    share = ids.groupBy("__lang").agg((F.lit(3.0 * sample + 30) / F.approx_count_distinct("__id")).alias("__share"))
    drawn = ids.join(share, "__lang").where(
        (F.col("__share") >= 1) | (F.col("__h") < F.lit(-2.0**63) + F.col("__share") * F.lit(2.0**64)))
    order = W.partitionBy("__lang").orderBy("__h", "__id")
    chosen = (drawn.select("__id", "__lang", "__h").distinct().withColumn("__n", F.row_number().over(order))
              .where(F.col("__n") <= sample).select("__id", "__lang").collect())
    wanted = {(r["__id"], r["__lang"]) for r in chosen}
    one = F.min_by(text, F.xxhash64(text)).alias(text)
    found = (rows.where(F.col(id_col).isin([i for i, _ in wanted])).groupBy(id_col, lang).agg(one).collect()
             if wanted else [])
    found = [r for r in found if (r[id_col], r[lang]) in wanted]
    found.sort(key=lambda r: (str(r[id_col]), str(r[text])))
    return train([r[text] for r in found], [r[lang] for r in found])


def identify(docs: DataFrame, model: Field, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred, score and runs of every text."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        s = scorer(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            for start, stop in slices(texts, 3_000_000):
                found = s.predict(texts[start:stop])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, stop - start), pa.array([x[0] for x in found], pa.string()),
                     pa.array([x[1] for x in found], pa.float64()),
                     pa.array([[dict(zip(("start", "end", "lang"), r)) for r in x[2]] for x in found], kind)],
                    [id_col, "lang_pred", "score", "runs"])

    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()),
                           T.StructField("runs", T.ArrayType(T.StructType([
                               T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                               T.StructField("lang", T.StringType())])))])
    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, ~held_out())
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "runs")


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
