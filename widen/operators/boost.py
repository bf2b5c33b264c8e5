"""Boosted stumps (M2): multi-class AdaBoost (SAMME), distributed.

Features are binned once. A round is one weighted count of (feature, bin,
class), which the tasks sum before the shuffle, so its size is that of the
schema: features x bins x classes. The driver picks the stump, the split of one
feature with a class on either side, of least weighted error. Row weights are
never stored or joined: a row's weight is an expression over its bins, the
product over the rounds so far of exp(alpha) where the round's stump was wrong.

Rows that agree in all bins and the class have the same weight for ever, so
equal rows are counted once and carried as one row with their number; with few
distinct values a round reads a small table, whatever the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from widen.functions.columns import as_double, as_list, col, field_types
from widen.functions.ranking import materialised

#: Digits to which errors are compared, so that the order of sums does not decide.
DIGITS = 9


@dataclass(frozen=True)
class Stump:
    """``low`` where the feature's bin is at most ``bin``, else ``high``."""

    feature: str
    bin: int
    low: str
    high: str
    error: float
    alpha: float


@dataclass(frozen=True)
class Boosted:
    classes: tuple[str, ...]
    stumps: tuple[Stump, ...]
    #: feature -> (least value, width of a bin, number of bins); outside values go to the end bins
    bins: dict = field(default_factory=dict)

    def bin_of(self, feature: str, x: Column) -> Column:
        low, width, n = self.bins[feature]
        b = F.lit(0) if not width else F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((x - F.lit(low)) / F.lit(width))))
        return F.when(x.isNotNull(), b.cast("int"))

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Adds the class with the largest sum of alphas; ties to the smaller class."""
        types = field_types(df)
        if not self.stumps:
            return df.withColumn(output, F.lit(self.classes[0] if self.classes else None).cast("string"))
        votes = []
        for c in self.classes:
            total = F.lit(0.0)
            for s in self.stumps:
                b = self.bin_of(s.feature, as_double(s.feature, types[s.feature]))
                total = total + F.when(_vote(s, b) == c, F.lit(s.alpha)).otherwise(0.0)
            votes.append(F.struct(F.round(total, DIGITS).alias("v"), F.lit(c).alias("c")))
        best = F.array_max(F.transform(F.array(*votes), lambda v: v["v"]))
        return df.withColumn(output, F.filter(F.array(*votes), lambda v: v["v"] == best)[0]["c"])


def _vote(s: Stump, b: Column) -> Column:
    """A missing value goes with the high side, in fitting and predicting alike."""
    return F.when(b <= s.bin, F.lit(s.low)).otherwise(F.lit(s.high))


def bin_edges(df: DataFrame, features, bins: int) -> dict:
    """Equal-width bins between least and greatest value: one row to the driver."""
    types = field_types(df)
    one = df.agg(*[f(F.when(F.abs(x := as_double(c, types[c])) != float("inf"), x)).alias(f"{k}{i}")
                   for i, c in enumerate(features) for k, f in (("l", F.min), ("h", F.max))]).first()
    out = {}
    for i, c in enumerate(features):
        low, high = one[f"l{i}"], one[f"h{i}"]
        out[c] = (low or 0.0, 0.0 if low is None else (high - low) / bins, bins)
    return out


def _best_stump(cells: dict, features: list[str], classes: list[str]) -> Stump | None:
    """Of ``cells`` (feature number, bin) -> weight per class the split of least
    error; ties to the earlier feature, then the smaller bin, then the smaller class."""
    best = None
    for i, name in enumerate(features):
        own = sorted((b if b is not None else math.inf, w) for (f, b), w in cells.items() if f == i)
        total = {c: math.fsum(w.get(c, 0.0) for _, w in own) for c in classes}
        everything = math.fsum(total.values())
        left = dict.fromkeys(classes, 0.0)
        for n, (b, w) in enumerate(own[:-1]):
            for c in classes:
                left[c] += w.get(c, 0.0)
            low = max(classes, key=lambda c: round(left[c] / everything, DIGITS))  # the first of equal ones
            high = max(classes, key=lambda c: round((total[c] - left[c]) / everything, DIGITS))
            error = round(1.0 - (left[low] + total[high] - left[high]) / everything, DIGITS)
            if best is None or error < best.error:
                best = Stump(name, int(b), low, high, error, 0.0)
    return best


def fit_boosted(df: DataFrame, features, target: str, rounds: int = 50, bins: int = 32, max_classes: int = 1000) -> Boosted:
    """Fit on numeric ``features`` and the classes of ``target`` (as text; rows
    without one are left out). One job a round; it stops where no stump is
    better than chance, or one is right everywhere.

    The number of classes bounds what a round brings to the driver; a target
    with more than ``max_classes`` is refused.
    """
    features = as_list(features)
    types = field_types(df)
    rows = df.filter(col(target).isNotNull())
    model = Boosted((), (), bin_edges(rows, features, bins))
    binned = rows.select(*[model.bin_of(c, as_double(c, types[c])).alias(f"b{i}") for i, c in enumerate(features)],
                         col(target).cast("string").alias("y"))
    names = [f"b{i}" for i in range(len(features))]
    table = materialised(binned.groupBy(*names, "y").agg(F.count(F.lit(1)).alias("n")))
    found = [r.y for r in table.select("y").distinct().limit(max_classes + 1).collect()]
    if len(found) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    classes = sorted(found)
    stumps: list[Stump] = []
    if len(classes) < 2:
        return Boosted(tuple(classes), (), model.bins)
    weight, scale = F.col("n").cast("double"), 0.0
    for _ in range(rounds):
        w = weight * F.lit(math.exp(-scale))  # keeps the numbers near 1; shares do not change
        long = table.select("y", w.alias("w"), F.posexplode(F.array(*names)).alias("f", "b"))
        cells: dict = {}
        for r in long.groupBy("f", "b", "y").agg(F.sum("w").alias("w")).collect():
            cells.setdefault((r.f, r.b), {})[r.y] = r.w
        s = _best_stump(cells, features, classes)
        k = len(classes)
        if s is None or s.error >= 1 - 1 / k:
            break
        # a stump without an error gets the weight of one that errs by the last digit
        error = max(s.error, 10.0**-DIGITS)
        s = Stump(s.feature, s.bin, s.low, s.high, s.error, math.log((1 - error) / error) + math.log(k - 1))
        stumps.append(s)
        if s.error <= 0:
            break
        wrong = _vote(s, F.col(names[features.index(s.feature)])) != F.col("y")
        weight = weight * F.when(wrong, F.lit(math.exp(s.alpha))).otherwise(1.0)
        scale += s.alpha * s.error
    return Boosted(tuple(classes), tuple(stumps), model.bins)


def stump_table(spark, model: Boosted) -> DataFrame:
    """``(round, feature, bin, low, high, error, alpha)``: a row a round."""
    rows = [(i, s.feature, s.bin, s.low, s.high, s.error, s.alpha) for i, s in enumerate(model.stumps, 1)]
    return spark.createDataFrame(rows, "round int, feature string, bin int, low string, high string, error double, alpha double")
