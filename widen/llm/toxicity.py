"""Toxicity: a subsequence string-kernel support vector machine over sentences.

Two words are alike as far as they share subsequences of three letters or
digits, each weighted by decay ** span, gaps included, so an insult with
inserted or left-out characters stays close to the plain one; the kernel of two
words is normalised to 1 for equal ones and cubed, so that what words share by
chance counts for nothing. The kernel of two sentences is the sum over their
distinct words. Letters that stand alone in a row ("i d i o t") are taken
together as one word more, with the blanks as gaps.

Nystroem landmarks are words of the training texts: those that hold
a run of characters that toxic texts have far more often than others, and words
drawn evenly from the rest.
The kernels with the landmarks, whitened by the landmarks' own kernel matrix,
are the features of a linear support vector machine. As these are sums over
words, a task scores each distinct word once.

Labels mark texts, sentences are what is learned: all sentences of texts that
are not toxic are negative; of a toxic text, after a first round, those that
the machine finds toxic, and at least its worst. A text is as toxic as its
worst sentence, on a logistic scale fitted on the training texts.

Fitting uses a bounded sample of labelled rows: ``sample_texts`` toxic texts and
three times as many others, drawn by a hash share, one row an id, and of each at most ``sample_sentences``
sentences of at most ``SAMPLED_CHARS`` characters, drawn by hash. Scoring reads
whole texts.

Defined results: null and empty texts, and texts without words of three letters,
get the score of a sentence without any; repeated rows get equal scores; very
long texts are scored sentence by sentence, a sentence being cut every
``WINDOW`` words and a word every ``WORD_CHARS`` characters; an empty table gives an empty result; without both classes
among the learned rows every score is the share of label 1 (0.5 without any).
Rows with a label other than 0 and 1 are not learned from. Other columns are
kept, whatever their names; one that has the name of a result column is
replaced.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widen.llm.common import Kept, slices

DECAY = 0.6
#: Power of the word kernel.
POWER = 3
#: Longest stretch of characters over which a subsequence of three is looked for.
SPAN = 7
#: Words of a sentence at most; longer ones are cut.
WINDOW = 24
SAMPLED_CHARS = 1_000
#: Bound of each generation of the word cache of a worker, in words.
CACHE = 450_000
#: Longer words are scored but not kept.
CACHED_CHARS = 64
#: Longer words are cut.
WORD_CHARS = 400
#: Characters of words whose subsequences are listed at a time.
AT_A_TIME = 60_000
#: Least log ratio of shares, less its errors, by which a word tells of toxic texts.
TELLING = 1.5
RESULT = ("score", "predicted", "worst")
_ENDS = (".", "!", "?", "…")
_SIGNS = re.compile(r"[\W_]+")
_ALONE = re.compile(r"\W*\w\W*")


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, code, weight) of every distinct subsequence of each word,
    weights normalised to length 1 per word; sorted by word, then code."""
    lowered = [w.lower() for w in words]
    letters = np.frombuffer("\n".join(lowered).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    if not len(letters):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    kinds, at = np.unique(letters, return_inverse=True)
    counts = np.array([chr(k).isalnum() for k in kinds.tolist()])[at]
    narrow = np.zeros(int(kinds[-1]) + 1, np.int64)
    narrow[kinds] = np.arange(len(kinds))
    owner = np.cumsum(letters == 10)  # words hold no line ends
    owners, codes, weights = [], [], []
    for j in range(2, SPAN):
        for i in range(1, j):
            n = len(letters) - j
            if n <= 0:
                continue
            ok = np.flatnonzero((owner[:n] == owner[j:]) & counts[:n] & counts[i:i + n] & counts[j:])
            owners.append(owner[ok])
            codes.append(letters[ok] << 42 | letters[ok + i] << 21 | letters[ok + j])
            weights.append(np.full(len(ok), DECAY ** (j + 1)))
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    owner, code, weight = map(np.concatenate, (owners, codes, weights))
    # numbers of characters are shorter than characters: word and code fit one key
    bits = max(1, int(len(kinds) - 1).bit_length())
    if 3 * bits + len(words).bit_length() < 63:
        small = owner
        for shift in (42, 21, 0):
            small = small << bits | narrow[code >> shift & 0x1FFFFF]
        order = np.argsort(small)
    else:
        order = np.lexsort((code, owner))
    owner, code, weight = owner[order], code[order], weight[order]
    starts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])]) if len(owner) else []
    if not len(starts):
        return owner, code, weight
    owner, code, weight = owner[starts], code[starts], np.add.reduceat(weight, starts)
    norms = np.sqrt(np.bincount(owner, weight * weight, minlength=len(words)))
    return owner, code, weight / norms[owner]


class Landmarks:
    """Landmark words by their subsequences: for each code the landmarks that
    have it."""

    def __init__(self, words: list[str]):
        owner, code, value = subsequences(words)
        order = np.argsort(code, kind="stable")
        self.many = len(words)
        self.codes, self.starts = np.unique(code[order], return_index=True)
        self.starts = np.append(self.starts, len(code))
        self.owners, self.values = owner[order], value[order]

    def blocks(self, words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first word, words x landmarks kernels), block by block."""
        for start, stop in slices(words, AT_A_TIME):
            n = stop - start
            owner, code, value = subsequences(words[start:stop])
            if len(self.codes):
                at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[at] == code
                owner, value, at = owner[hit], value[hit], at[hit]
                sizes = self.starts[at + 1] - self.starts[at]
                inner = np.repeat(self.starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                cells = np.repeat(owner, sizes) * self.many + self.owners[inner]
                k = np.bincount(cells, np.repeat(value, sizes) * self.values[inner], minlength=n * self.many)
            else:
                k = np.zeros(n * self.many)
            power = k.copy()
            for _ in range(POWER - 1):  # much faster than a power of floats
                power *= k
            yield start, power.reshape(n, self.many)

    def kernels(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number, landmark, kernel) where the kernel is not 0."""
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for start, k in self.blocks(words):
            word, landmark = np.nonzero(k)
            parts.append((word + start, landmark, k[word, landmark]))
        return tuple(map(np.concatenate, zip(*parts)))


@dataclass(frozen=True)
class Model:
    """Landmarks with their weights, and the logistic scale."""

    landmarks: Landmarks
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def words(self, words: list[str]) -> np.ndarray:
        """What each word adds to its sentence."""
        return np.concatenate([np.empty(0), *(k @ self.weights for _, k in self.landmarks.blocks(words))])

    def score(self, worst: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(worst), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -500, 500)))


# ---------------------------------------------------------------------------
# sentences
# ---------------------------------------------------------------------------

ENDS_SENTENCE, STANDS_ALONE = 1, 2


def word_flags(word: str) -> int:
    return ENDS_SENTENCE * word.endswith(_ENDS) + STANDS_ALONE * bool(len(word) < 4 and _ALONE.fullmatch(word))


def folded(word: str) -> str:
    """What the kernel sees of a word: lower case, without signs around it, a
    row of signs inside as one."""
    return word.lower() if word.isalnum() else _SIGNS.sub("-", word.lower()).strip("-")


def sentence_starts(flags: np.ndarray) -> np.ndarray:
    """Numbers of the words that start a sentence, or a part of a long one."""
    n = len(flags)
    first = np.zeros(n, np.int64)
    ends = np.flatnonzero(flags[:-1] & ENDS_SENTENCE) + 1
    first[ends] = ends
    first = np.maximum.accumulate(first)
    return np.flatnonzero((np.arange(n) - first) % WINDOW == 0)


def distinct_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum per sentence of its words' values, repeated words once: words of a
    sentence with the same value are taken for the same word."""
    sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
    order = np.lexsort((values, sentence))
    values, sentence = values[order], sentence[order]
    first = np.r_[True, (values[1:] != values[:-1]) | (sentence[1:] != sentence[:-1])]
    return np.bincount(sentence[first], values[first], minlength=len(starts))


def lone_letters(words: list[str], flags: np.ndarray) -> list[tuple[int, str]]:
    """(first word, letters with blanks between) of runs of three or more
    letters that stand alone."""
    alone = np.r_[0, (flags & STANDS_ALONE) > 0, 0].astype(np.int8)
    steps = np.diff(alone)
    return [(i, " ".join(words[i:j])) for i, j in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)) if j - i > 2]


def split_words(text: str | None) -> list[str]:
    """Words between white space, very long ones cut."""
    words = (text or "").split()
    if len(text or "") > WORD_CHARS and max(map(len, words), default=0) > WORD_CHARS:
        return [w[i:i + WORD_CHARS] for w in words for i in range(0, len(w), WORD_CHARS)]
    return words


def text_sentences(text: str | None) -> list[list[str]]:
    """Sentences as lists of words, runs of lone letters added."""
    words = split_words(text)
    if not words:
        return []
    flags = np.array([word_flags(w) for w in words], np.int64)
    starts = sentence_starts(flags)
    out = [words[i:j] for i, j in zip(starts, [*starts[1:], len(words)])]
    for i, run in lone_letters(words, flags):
        out[int(np.searchsorted(starts, i, "right")) - 1].append(run)
    return out


# ---------------------------------------------------------------------------
# fitting, on the driver over a bounded sample
# ---------------------------------------------------------------------------

def _letters(word: str) -> str:
    return "".join(filter(str.isalnum, word.lower()))


def _grams(word: str) -> list[str]:
    return [word[i:i + 4] for i in range(max(1, len(word) - 3))]


def _telling(plain: list[str], plain_of: np.ndarray, labels: np.ndarray, sentences: list[np.ndarray],
             text_of: np.ndarray) -> np.ndarray:
    """How far a word tells of toxic texts: the largest, among its runs of four
    characters, of the log of how many times the share of toxic texts that hold
    the run is that of others, less two standard errors."""
    n, holds = np.bincount(labels, minlength=2), [Counter(), Counter()]
    starts = np.searchsorted(text_of, np.arange(len(labels) + 1))
    for t, k in enumerate(labels.tolist()):
        own = np.unique(np.concatenate([np.empty(0, np.int64), *(plain_of[s] for s in sentences[starts[t]:starts[t + 1]])]))
        holds[k].update({g for i in own.tolist() if i >= 0 for g in _grams(plain[i])})
    ratio = n[0] / n[1]
    told = {g: math.log(ratio * (c + 0.5) / (holds[0][g] + 0.5)) - 2 * math.sqrt(1 / (c + 0.5) + 1 / (holds[0][g] + 0.5))
            for g, c in holds[1].items()}
    return np.array([max(told.get(g, 0.0) for g in _grams(w)) for w in plain])


def _landmarks(words: list[str], told: np.ndarray, many: int) -> list[str]:
    """The words that tell most, no two of them almost the same, and as many
    drawn evenly from the others."""
    ranked = np.argsort(-told, kind="stable").tolist()
    chosen = [words[i] for i in ranked[:4 * many]]
    owners, others, k = Landmarks(chosen).kernels(chosen)
    near = [[] for _ in chosen]
    for i, j in zip(owners[k > 0.7].tolist(), others[k > 0.7].tolist()):
        near[i].append(j)
    taken = np.zeros(len(chosen), bool)
    for i in range(len(chosen)):
        if taken.sum() < many // 2 and not taken[near[i]].any():
            taken[i] = True
    rest = ranked[4 * many:]
    step = max(1, len(rest) // max(1, many - int(taken.sum())))
    return [w for w, t in zip(chosen, taken) if t] + [words[i] for i in rest[::step][:many - int(taken.sum())]]


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss by Newton steps;
    the last column of x is 1 and its weight is hardly shrunk. Rows with weight
    0 take no part."""
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])

    def loss(v):
        return 0.5 * (ridge * v * v).sum() + cost * (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()

    now = loss(w)
    for _ in range(30):
        grad, curve = ridge * w, np.diag(ridge)
        for i in range(0, len(x), 4096):  # no copy of all active rows
            b = x[i:i + 4096].astype(np.float64)
            own = np.where(y[i:i + 4096] * (b @ w) < 1, weight[i:i + 4096], 0.0)
            grad -= 2 * cost * b.T @ (own * (y[i:i + 4096] - b @ w))
            curve += 2 * cost * (b.T * own) @ b
        step = np.linalg.solve(curve, grad)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-6 * max(1.0, before):
            break
    return w[:-1], float(w[-1])


def fit(texts: Iterable[tuple[int, list[list[str]]]], landmarks: int = 256, rounds: int = 3, cost: float = 3.0) -> Model:
    """Fit on (label, sentences of words) of the sampled texts, which are read
    once and kept as numbers of words."""
    number_of: dict[str, int] = {}
    labels, sentences, text_of = [], [], []
    for k, own in texts:
        for s in own:
            if s:
                sentences.append(np.unique([number_of.setdefault(folded(w), len(number_of)) for w in s]))
                text_of.append(len(labels))
        labels.append(k)
    labels, text_of, words = np.array(labels, np.int64), np.array(text_of, np.int64), list(number_of)
    if len(set(labels.tolist())) < 2:
        share = 0.5 if not len(labels) else float(labels.mean())
        return Model(Landmarks([]), np.empty(0), constant=share)
    folds = [_letters(w) for w in words]
    plain = sorted({f for f in folds if len(f) > 2})
    if not plain:
        return Model(Landmarks([]), np.empty(0), constant=float(labels.mean()))
    place = {f: i for i, f in enumerate(plain)}
    plain_of = np.array([place.get(f, -1) for f in folds])
    told = _telling(plain, plain_of, labels, sentences, text_of)
    marks = _landmarks(plain, told, landmarks)
    table = Landmarks(marks)
    i, j, k = table.kernels(marks)
    own = np.zeros((len(marks), len(marks)))
    own[i, j] = k
    values, vectors = np.linalg.eigh(own)
    good = values > 1e-3 * values.max()
    white = vectors[:, good] / np.sqrt(values[good])

    word, mark, k = table.kernels(words)
    first = np.searchsorted(word, np.arange(len(words) + 1))
    x = np.ones((len(sentences), white.shape[1] + 1), np.float32)
    for i, s in enumerate(sentences):
        r = np.concatenate([np.arange(first[w], first[w + 1]) for w in s])
        x[i, :-1] = np.bincount(mark[r], k[r], minlength=len(marks)) @ white
    toxic = labels[text_of] == 1
    y = np.where(toxic, 1.0, -1.0)
    # a toxic text starts with the sentences whose best word tells about as much as any;
    # texts without a telling word, whose label may be wrong, wait for the first machine
    word_told = np.where(plain_of >= 0, told[plain_of], 0.0)
    telling = np.array([word_told[s].max() for s in sentences])
    best = _greatest(telling, text_of, len(labels), 0.0)
    chosen = toxic & (telling >= 0.75 * best[text_of])
    if (chosen & (telling >= TELLING)).any():
        chosen &= telling >= TELLING
    # of texts that are not toxic every third sentence is used, as they are more
    use = chosen | ~toxic & (np.arange(len(toxic)) % 3 == 0)
    for _ in range(rounds):
        # both classes weigh the same, however many sentences they have
        weight = use * np.where(toxic, 0.5 / max(1, (use & toxic).sum()), 0.5 / max(1, (use & ~toxic).sum()))
        w, bias = _machine(x, y, weight * min(use.sum(), 2_000), cost)
        found = x[:, :-1] @ w + bias
        worst = _greatest(found, text_of, len(labels), bias)
        if not (toxic & (found > 0)).any():
            break
        use = ~toxic & use | toxic & (found > 0)
    slope, offset = _logistic(worst, labels)
    return Model(table, white @ w, bias, slope, offset)


def _greatest(values: np.ndarray, owner: np.ndarray, n: int, least: float) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, owner, values)
    return np.where(np.isfinite(out), out, least)


def _logistic(worst: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the scale, with targets drawn in as the sample is small."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(labels == 1, 0.5 / n1, 0.5 / n0)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * worst + b, -500, 500)))
        g = np.array([(weight * (p - target) * worst).sum() + 1e-4 * (a - 1), (weight * (p - target)).sum() + 1e-4 * b])
        h = weight * p * (1 - p)
        cross = (h * worst).sum()
        step = np.linalg.solve([[(h * worst * worst).sum() + 1e-4, cross], [cross, h.sum() + 1e-4]], g)
        step *= min(1.0, 2 / max(1e-9, abs(step).max()))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------

def training_sentences(docs: DataFrame, labels: DataFrame, learn: Column, label: str, id_col: str, text: str,
                       sample_texts: int, sample_sentences: int) -> Iterator[tuple[int, list[list[str]]]]:
    """(label, sentences) of the sampled texts: at most ``sample_texts`` toxic
    ones and three times as many others."""
    most = {1: sample_texts, 0: 3 * sample_texts}
    rows = (labels.where(learn).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("label"))
            .where("label IN (0, 1) AND id IS NOT NULL").groupBy("id").agg(F.max("label").cast("int").alias("label")))
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    share = F.lit(0.0)
    for k, n in sizes.items():  # a little more than wanted is drawn, so that the share is seldom short
        share = F.when(F.col("label") == k, min(1.0, (1.2 * most[k] + 20) / n)).otherwise(share)
    drawn = rows.where((F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < 1_000_000 * share))
    own = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
           .join(F.broadcast(drawn), "id")  # about 5 x sample_texts rows
           .groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")))

    def cut(batches):
        for b in batches:
            labels, texts, out = b.column(1).to_pylist(), b.column(2).to_pylist(), []
            for t in texts:
                sentences = [" ".join(s) for s in text_sentences(t)]
                sentences = [s for s in sentences if len(s) <= SAMPLED_CHARS]
                if len(sentences) > sample_sentences:
                    rng = np.random.default_rng(len(t))
                    sentences = [sentences[i] for i in np.sort(rng.permutation(len(sentences))[:sample_sentences])]
                out.append(sentences)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels, pa.int32()),
                                              pa.array(out, pa.list_(pa.string()))], ["id", "label", "sentences"])

    schema = f"id {drawn.schema['id'].dataType.simpleString()}, label int, sentences array<string>"
    found = own.mapInArrow(cut, schema).collect()  # 5 x sample_texts x sample_sentences x SAMPLED_CHARS at most
    found.sort(key=lambda r: (r.label, repr(r.id)))
    return ((k, [text_words(s) for s in r.sentences]) for k in (0, 1)
            for r in [r for r in found if r.label == k][:most[k]])


def text_words(sentence: str) -> list[str]:
    """Words of one sentence, runs of lone letters added."""
    words = sentence.split()
    flags = np.array([word_flags(w) for w in words], np.int64)
    return words + [run for _, run in lone_letters(words, flags)]


@functools.lru_cache(maxsize=1)
def _shared_cache(run: str) -> Kept:
    return Kept(CACHE, CACHED_CHARS)


def score_texts(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text",
                batch_chars: int = 3_000_000) -> DataFrame:
    """Input columns, score, predicted and worst: the sentence that decides."""
    low = {*RESULT}
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() not in low]
    # input columns travel in one struct, so that their names meet no others
    df = docs.select(F.struct(*kept).alias("x"), F.col(f"`{text}`").alias("text"))
    run_id = uuid.uuid4().hex
    kind = np.dtype([("value", "<f4"), ("flags", "<i4")])

    def learned(words):
        out = np.empty(len(words), kind)
        folds = [folded(w) for w in words]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(folds))}
        out["value"] = model.words(list(distinct))[[distinct[w] for w in folds]] if words else 0
        out["flags"] = [word_flags(w) for w in words]
        raw = out.tobytes()
        return [raw[i:i + kind.itemsize] for i in range(0, len(raw), kind.itemsize)]

    def scored(batches):
        cache = _shared_cache(run_id)
        for b in batches:
            texts = b.column(1).to_pylist()
            for start, stop in slices(texts, batch_chars):
                split = [split_words(t) for t in texts[start:stop]]
                known, new = cache.lookup(set().union(*split), learned)
                worst, told = [], []
                for own in split:
                    if not own:
                        worst.append(model.bias)
                        told.append("")
                        continue
                    found = np.frombuffer(b"".join([known[w] if w in known else new[w] for w in own]), kind)
                    values, flags = found["value"].astype(np.float64), found["flags"]
                    starts = sentence_starts(flags)
                    sums = distinct_sums(values, starts)
                    if (flags & STANDS_ALONE).sum() > 2 and (runs := lone_letters(own, flags)):
                        for (i, _), v in zip(runs, model.words([folded(r) for _, r in runs])):
                            sums[np.searchsorted(starts, i, "right") - 1] += v
                    k = int(sums.argmax())
                    worst.append(model.bias + sums[k])
                    told.append(" ".join(own[starts[k]:starts[k + 1] if k + 1 < len(starts) else None]))
                score = model.score(np.array(worst, dtype=float))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, stop - start), pa.array(score, pa.float64()),
                     pa.array((score >= threshold).astype(np.int32)), pa.array(told, pa.string())], ["x", *RESULT])

    schema = T.StructType([df.schema["x"], T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType()), T.StructField("worst", T.StringType())])
    return df.mapInArrow(scored, schema).select("x.*", *RESULT)


def classify_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.5, id_col: str = "doc_id",
                      text: str = "text", label: str = "toxic", sample_texts: int = 400, sample_sentences: int = 50,
                      landmarks: int = 256) -> DataFrame:
    """Score every text, learning from labels only where ``learn`` (an
    expression over the id) holds."""
    sample = training_sentences(docs, labels, learn, label, id_col, text, sample_texts, sample_sentences)
    return score_texts(docs, fit(sample, landmarks), threshold, text)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify_toxicity(docs, labels, ~held_out()).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op11_toxicity": op11_toxicity}
ORACLES: dict[str, str] = {}
