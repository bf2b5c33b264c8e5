"""Wrapper selection (F11): forward selection by a model's held-out error,
from sufficient statistics.

The model is least squares: of the target itself, or of one indicator per
class. Everything that fitting and scoring any subset of columns needs is in
four small matrices of the standardised columns X, summed by the tasks in two
passes, whatever the number of steps, subsets and classes:

    A = X'X of the training rows            M = sum over classes  s s'
    T = X'X of the held-out rows            C = sum over classes  t s'

where s and t are a class's sums of X over its training and held-out rows (for
a numeric target: X'y, the one column). A subset S has the coefficients
inv(A_S) X'Y, so its held-out squared error is

    sum of y'y  -  2 tr(inv(A_S) C_S)  +  tr(T_S inv(A_S) M_S inv(A_S))

and no step reads a row again. Classes are never listed on the driver: they
enter only through M and C, so a target may have any number of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widen.functions.columns import as_double, as_list, col, field_types
from widen.functions.ranking import materialised
from widen.operators.prep import model_frame, split

#: A column whose part outside the chosen ones is smaller adds nothing.
COLLINEAR = 1e-9

STEPS = "step int, action string, feature string, score double, gain double"


def outer_sums(df: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """Sum over rows of the outer product of two lists of columns, which hold no
    nulls. A task hands on one matrix, and the matrices are added cell by cell."""
    shape = (len(left), len(right))

    def partial(batches):
        total = np.zeros(shape)
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)])
            total += x[:len(left)] @ x[len(left):].T
        cells = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "v"])

    both = df.select(*[col(c).cast("double").alias(f"l{i}") for i, c in enumerate(left)],
                     *[col(c).cast("double").alias(f"r{i}") for i, c in enumerate(right)])
    cells = both.mapInArrow(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(shape[0] * shape[1])
    for r in cells:
        out[r.cell] = r.v
    return out.reshape(shape)


@dataclass(frozen=True)
class Moments:
    """The matrices; column 0 is the constant, column i the i-th feature."""

    features: tuple[str, ...]
    a: np.ndarray
    t: np.ndarray
    m: np.ndarray
    c: np.ndarray
    total: float  # sum of y'y over the held-out rows

    def error(self, subset: list[int]) -> float | None:
        """Held-out squared error of the constant and a subset of columns; None
        if a column follows from the others on the training rows."""
        at = np.ix_([0, *subset], [0, *subset])
        a = self.a[at]
        scale = np.sqrt(np.diag(a))
        if (scale == 0).any():
            return None
        low = _cholesky(a / np.outer(scale, scale))
        if low is None:
            return None
        inverse = np.linalg.inv(low) / scale
        inverse = inverse.T @ inverse
        return float(self.total - 2 * (inverse * self.c[at].T).sum() + (inverse @ self.m[at] @ inverse * self.t[at].T).sum())


def _cholesky(a: np.ndarray) -> np.ndarray | None:
    try:
        low = np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return None
    return low if (np.diag(low) ** 2 > COLLINEAR).all() else None


def moments(df: DataFrame, features, target: str, test_flag: str, task: str) -> Moments:
    """The matrices of numeric columns without nulls, in two passes: one row of
    means and deviations of the training rows, then the sums."""
    features = as_list(features)
    types = field_types(df)
    train = ~F.col(test_flag)
    names = {c: f"x{i + 1}" for i, c in enumerate(features)}
    x = {c: as_double(c, types[c]) for c in features}
    one = df.filter(train).agg(F.count(F.lit(1)).alias("n"), *[f(x[c]).alias(f"{k}{i}") for i, c in enumerate(features)
                                                             for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not one["n"]:
        raise ValueError("no training rows")
    # standardised, so that sums of squares keep their digits; a constant column stays 0
    z = df.select(F.lit(1.0).alias("x0"), *[
        ((x[c] - F.lit(one[f"m{i}"])) / F.lit(one[f"s{i}"] or 1.0)).alias(names[c]) for i, c in enumerate(features)],
        col(target).alias("y"), F.col(test_flag).alias("test"))
    cols = ["x0", *names.values()]
    fit_part, hold = z.filter(~F.col("test")), z.filter("test")
    a, t = outer_sums(fit_part, cols, cols), outer_sums(hold, cols, cols)
    if task == "regression":
        s, u = outer_sums(fit_part, cols, ["y"]), outer_sums(hold, cols, ["y"])
        total = hold.agg(F.sum(F.col("y").cast("double") ** 2)).first()[0]
        return Moments(tuple(features), a, t, s @ s.T, u @ s.T, float(total or 0.0))
    # one row per class with its sums over both parts; a class meets itself in one task
    per = z.groupBy("y").agg(*[F.sum(F.when(F.col("test") == flag, F.col(c)).otherwise(0.0)).alias(f"{k}{c}")
                               for k, flag in (("s", False), ("u", True)) for c in cols])
    s, u = [f"s{c}" for c in cols], [f"u{c}" for c in cols]
    per = materialised(per)
    return Moments(tuple(features), a, t, outer_sums(per, s, s), outer_sums(per, u, s), float(t[0, 0]))


def forward_steps(m: Moments, k: int | None = None, min_gain: float = 0.0, drop: bool = False) -> list[tuple]:
    """(step, action, feature, score, gain) of greedy steps.

    The score is the share of the held-out squared error, beside that of the
    constant, which the subset explains. A step picks the column that raises it
    most (ties: the first), as long as it rises by more than ``min_gain``; with
    ``drop`` a step may also drop an earlier pick, if that raises the score.
    """
    base = m.error([])
    if not base or base <= 0:
        return []
    chosen, out, now = [], [], 0.0

    def score(subset):
        e = m.error(subset)
        return None if e is None else 1.0 - e / base

    while k is None or len(chosen) < k:
        best = None
        for i in range(1, len(m.features) + 1):
            if i not in chosen:
                s = score([*chosen, i])
                # rounding must not decide between columns that are copies
                if s is not None and (best is None or s > best[0] + 1e-12):
                    best = s, i
        if best is None or best[0] - now <= max(min_gain, 1e-12):
            break
        chosen.append(best[1])
        out.append((len(out) + 1, "pick", m.features[best[1] - 1], best[0], best[0] - now))
        now = best[0]
        while drop and len(chosen) > 2:
            rest = [(score([c for c in chosen if c != i]), i) for i in chosen[:-1]]
            s, i = max((x for x in rest if x[0] is not None), default=(None, 0), key=lambda x: x[0])
            if s is None or s - now <= 1e-9:
                break
            chosen.remove(i)
            out.append((len(out) + 1, "drop", m.features[i - 1], s, s - now))
            now = s
    return out


def select_forward(df: DataFrame, target: str, key: str, task: str, features=None, k: int | None = None,
                   min_gain: float = 0.0, drop: bool = False, test: float = 0.33, split_seed: int = 1) -> DataFrame:
    """``(step, action, feature, score, gain)``, a row per greedy step.

    Columns are prepared as for the model scorers (median fill, category codes,
    infinities as 0, rows without a target left out); rows are held out by md5
    of the row key, as the scorers do.
    """
    keyed = df.withColumn("__key", col(key).cast("string")).drop(key)
    if features:
        wanted = {*as_list(features), target, "__key"}
        keyed = keyed.select(*[col(c) for c in keyed.columns if c in wanted])
    prepared, names = model_frame(keyed, target, task, passthrough=["__key"])
    names = [c for c in names if c in set(as_list(features) or names)]
    data = materialised(split(prepared.select(*[col(c) for c in (*names, target, "__key")]), "__key", test, split_seed))
    steps = forward_steps(moments(data, names, target, "is_test", task), k, min_gain, drop)
    return df.sparkSession.createDataFrame(steps, STEPS)  # a row a step
