"""Quality classifier: regularised quadratic discriminant analysis.

Each document becomes a short vector of transformed statistics (shares of
symbols, capitals, repeated words, lines ...). Per class a mean and a
covariance are learned; the covariance is shrunk towards its diagonal and
towards the pooled covariance and its Cholesky factor is kept. A score is the
difference of the two Gaussian log densities, each a Mahalanobis norm from one
triangular solve plus a log determinant, calibrated to 0..1.

Training is distributed: every task sums count, x and x xT per class of its
rows, so the driver sees one small matrix per class however many rows there
are. Labels enter only there; language, source and id are never inputs.

Defined results: null and empty texts have the same vector (no words) and get
a score; repeated rows get equal scores; an empty table gives an empty result;
without both classes in the training rows every score is the share of label 1
(0.5 without any label). Rows with a null label are not learned from.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = ("log_words", "mean_length", "symbols", "capitals", "shouts", "bars", "digits", "distinct_words",
            "adjacent_repeats", "distinct_pairs", "log_line_words", "duplicate_lines", "stops", "punctuation")

_SYMBOLS = "#*$%&|<>"
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGITS = re.compile(r"[0-9]")


def _logit(share: float) -> float:
    """Variance-stabilising transform of a share (arc sine of the root)."""
    return math.asin(math.sqrt(min(1.0, max(0.0, share))))


def text_statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES."""
    t = text or ""
    words = t.split()
    n, chars = len(words), max(1, len(t))
    if not n:
        return [0.0] * len(FEATURES)
    lines = [x for x in t.split("\n") if x and not x.isspace()]
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 0
    twins = sum(map(str.__eq__, words, words[1:]))
    return [
        math.log1p(n),
        math.log1p(len(t) / n),
        _logit(sum(map(t.count, _SYMBOLS)) / n),
        _logit(len(_CAPITALS.findall(t)) / chars),
        _logit(t.count("!") / n),
        _logit(t.count("|") / n),
        _logit(len(_DIGITS.findall(t)) / chars),
        _logit(len(set(words)) / n),
        _logit(twins / n),
        _logit(pairs / max(1, n - 1)),
        math.log1p(n / max(1, len(lines))),
        _logit(1 - len(set(lines)) / max(1, len(lines))),
        _logit((t.count(".") + t.count("?")) / n),
        _logit((t.count(",") + t.count(";") + t.count(":")) / n),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([text_statistics(t) for t in texts])


@dataclass(frozen=True)
class Model:
    """Parameters of a fitted discriminant; small enough to ship with a task."""

    means: np.ndarray  # class x feature
    factors: np.ndarray  # class x feature x feature: inverse Cholesky factors
    log_dets: np.ndarray  # class
    log_priors: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with priors."""
        out = []
        for mean, inverse, log_det, prior in zip(self.means, self.factors, self.log_dets, self.log_priors):
            z = (x - mean) @ inverse.T
            out.append(prior - 0.5 * log_det - 0.5 * np.einsum("ij,ij->i", z, z))
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.slope * _squash(self.difference(x)) + self.offset
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _squash(d: np.ndarray) -> np.ndarray:
    """Keeps the order of differences but not their size, which the Gaussian
    form overstates far from both classes."""
    return np.arcsinh(d / 4.0)


def _moments(features: DataFrame, label: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: count, sum of x and sum of x xT, summed by the tasks first."""
    d = len(FEATURES)

    def partial(batches):
        sums = {}
        for b in batches:
            x = np.stack(b["features"].to_numpy()) if len(b) else np.empty((0, d))
            for k in b[label].unique():
                own = x[(b[label] == k).to_numpy()]
                n, s, q = sums.get(int(k), (0, np.zeros(d), np.zeros((d, d))))
                sums[int(k)] = (n + len(own), s + own.sum(0), q + own.T @ own)
        if sums:
            yield pd.DataFrame([(k, i, float(v)) for k, (n, s, q) in sums.items()
                                for i, v in enumerate([n, *s, *q.ravel()])], columns=["k", "i", "v"])

    rows = (features.select("features", F.col(label)).mapInPandas(partial, "k int, i int, v double")
            .groupBy("k", "i").agg(F.sum("v").alias("v")).collect())  # classes x (1 + d + d*d) rows
    out = {}
    for k in {r.k for r in rows}:
        v = np.zeros(1 + d + d * d)
        for r in rows:
            if r.k == k:
                v[r.i] = r.v
        out[k] = (v[0], v[1:1 + d], v[1 + d:].reshape(d, d))
    return out


def fit(features: DataFrame, label: str = "label", diagonal: float = 0.1, pooled: float = 0.1) -> Model:
    """Fit on rows (features array<double>, label 0/1).

    ``diagonal`` and ``pooled`` are the shares by which each class covariance
    is shrunk to its own diagonal and to the covariance of both classes.
    """
    labelled = features.where(F.col(label).isin(0, 1))
    m = _moments(labelled, label)
    n = sum(x[0] for x in m.values())
    d = len(FEATURES)
    if len(m) < 2:
        share = 0.5 if not n else float(m.get(1, (0,))[0] / n)
        return Model(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), np.zeros(2), constant=share)
    means, covs = {}, {}
    for k, (c, s, q) in m.items():
        means[k] = s / c
        covs[k] = q / c - np.outer(means[k], means[k])
    both = sum(m[k][0] / n * covs[k] for k in m)
    floor = 1e-4 + 0.01 * np.diag(both).mean()
    factors, log_dets = [], []
    for k in (0, 1):
        c = (1 - pooled) * covs[k] + pooled * both
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + floor * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        log_dets.append(2 * np.log(np.diag(low)).sum())
    model = Model(np.stack([means[0], means[1]]), np.stack(factors), np.array(log_dets),
                  np.log([m[0][0] / n, m[1][0] / n]))
    return _calibrated(model, labelled, label)


def _calibrated(model: Model, labelled: DataFrame, label: str) -> Model:
    """Fit slope and offset of the logistic link on a histogram of the squashed
    differences (at most 801 cells a class, whatever the number of rows)."""
    def cells(batches):
        for b in batches:
            if len(b):
                z = _squash(model.difference(np.stack(b["features"].to_numpy())))
                yield pd.DataFrame({"z": np.clip(np.round(z * 20), -400, 400).astype("int32"),
                                    "k": b[label].astype("int32")}).value_counts().reset_index(name="n")

    rows = (labelled.select("features", F.col(label)).mapInPandas(cells, "z int, k int, n long")
            .groupBy("z", "k").agg(F.sum("n").alias("n")).collect())
    z = np.array([r.z / 20 for r in rows])
    y = np.array([r.k for r in rows], dtype=float)
    w = np.array([r.n for r in rows], dtype=float)
    w /= w.sum()
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps with a weak pull to slope 1
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        g = np.array([(w * (p - y) * z).sum() + 1e-3 * (a - 1), (w * (p - y)).sum() + 1e-3 * b])
        h = w * p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return Model(model.means, model.factors, model.log_dets, model.log_priors, max(a, 1e-3), b)


def document_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Input columns and ``features``."""
    return docs.drop(*[c for c in docs.columns if c.lower() == "features"]).withColumn(
        "features", _statistics(F.col(text)))


def score(features: DataFrame, model: Model) -> Column:
    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else np.empty(0))

    return scored(features["features"])


def classify_quality(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3,
                     id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """id, score, predicted of every document.

    Labels are learned from only where ``learn`` (an expression over the id)
    holds. The statistics of each text are computed once and cut from the
    lineage by checkpoint(), so both training passes and the scoring read
    vectors and no text.
    """
    from widen.session import checkpoint_dir

    checkpoint_dir(docs.sparkSession)
    stats = document_features(docs.select(id_col, text), text).select(id_col, "features").checkpoint()
    rows = labels.select(id_col, F.col(label).alias("label")).where(learn)
    model = fit(stats.join(rows, id_col).select("features", "label"))
    return stats.select(id_col, score(stats, model).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def accept_quality(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3, id_col: str = "doc_id",
                   text: str = "text", label: str = "quality") -> DataFrame:
    """The rows whose score is at least ``threshold``, with all their columns.

    The model is fitted as in :func:`classify_quality`; the texts are then
    scored where they are, so no text is shuffled.
    """
    from widen.session import checkpoint_dir

    checkpoint_dir(docs.sparkSession)
    rows = labels.select(F.col(id_col).alias("__id"), F.col(label).alias("__label")).where("__label IN (0, 1)")
    learned = docs.where(learn).select(F.col(id_col).alias("__id"), _statistics(F.col(text)).alias("features"))
    model = fit(learned.join(rows, "__id").select("features", F.col("__label").alias("label")).checkpoint())

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([text_statistics(t) for t in texts])) if len(texts) else np.empty(0))

    return docs.where(scored(F.col(text)) >= threshold)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return (classify_quality(docs, labels, ~held_out())
            .select("doc_id", held_out().alias("held_out"), "score", "predicted"))


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLES: dict[str, str] = {}
