"""Model scorers: boosted stumps against a plain twin, and for every scorer its
range, repeatability, seeds, and the edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from widen.operators.boost import DIGITS, Boosted, fit_boosted, stump_table
from widen.operators.prep import assemble
from widen.plans.evaluate import Score, score_boosted, score_rf, score_rf_reg, score_search, select_importance


@pytest.fixture(scope="module")
def labelled(spark):
    random.seed(11)
    rows = []
    for i in range(240):
        a, b = random.gauss(0, 1), random.choice("pqr")
        noise = random.random() < 0.05
        rows.append((f"k{i}", a, b, random.gauss(0, 1), int((a > 0.3 or b == "q") != noise), 2 * a + random.gauss(0, 0.1)))
    return spark.createDataFrame(rows, "key string, a double, b string, c double, y int, t double").repartition(3).cache()


# -- boosted stumps -----------------------------------------------------------

def plain_samme(rows, feats, rounds, bins):
    """SAMME row by row; rows are dicts with a class under 'y'."""
    rows = [r for r in rows if r["y"] is not None]
    edges = {}
    for f in feats:
        v = [r[f] for r in rows if r[f] is not None]
        edges[f] = (min(v), (max(v) - min(v)) / bins) if v else (0.0, 0.0)

    def bin_of(r, f):
        low, width = edges[f]
        return None if r[f] is None else 0 if not width else max(0, min(bins - 1, math.floor((r[f] - low) / width)))

    classes = sorted({r["y"] for r in rows})
    w, out = [1.0] * len(rows), []
    for _ in range(rounds):
        best, everything = None, math.fsum(w)
        for f in feats:
            found = sorted({b for r in rows if (b := bin_of(r, f)) is not None})
            cuts = found if any(bin_of(r, f) is None for r in rows) else found[:-1]
            for cut in cuts:
                sides = [dict.fromkeys(classes, 0.0), dict.fromkeys(classes, 0.0)]
                for r, x in zip(rows, w):
                    b = bin_of(r, f)
                    sides[b is None or b > cut][r["y"]] += x
                low, high = (max(classes, key=lambda c: round(s[c] / everything, DIGITS)) for s in sides)
                e = round(1 - (sides[0][low] + sides[1][high]) / everything, DIGITS)
                if best is None or e < best[0]:
                    best = e, f, cut, low, high
        if best is None or best[0] >= 1 - 1 / len(classes):
            break
        e, f, cut, low, high = best
        alpha = math.log((1 - max(e, 10**-DIGITS)) / max(e, 10**-DIGITS)) + math.log(len(classes) - 1)
        out.append((f, cut, low, high, e, alpha))
        if e <= 0:
            break
        w = [x * math.exp(alpha) if (low if (b := bin_of(r, f)) is not None and b <= cut else high) != r["y"] else x
             for r, x in zip(rows, w)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_match_row_by_row(spark, seed):
    random.seed(seed)
    rows = []
    for _ in range(150):
        a, b = random.choice([None, random.gauss(0, 1), 1.0]), float(random.randint(0, 5))
        y = None if random.random() < 0.05 else "u" if (a or 0) > 0.5 else "v" if b > 2 + random.gauss(0, 1) else "ww"
        rows.append((a, b, 4.0, y))
    df = spark.createDataFrame(rows, "a double, b double, flat double, y string").repartition(3)
    model = fit_boosted(df, ["a", "b", "flat"], "y", rounds=6, bins=8)
    want = plain_samme([dict(zip(("a", "b", "flat", "y"), r)) for r in rows], ["a", "b", "flat"], 6, 8)
    assert len(model.stumps) == len(want) > 2
    for s, (f, cut, low, high, e, alpha) in zip(model.stumps, want):
        assert (s.feature, s.bin, s.low, s.high) == (f, cut, low, high)
        assert s.error == pytest.approx(e, abs=1e-8) and s.alpha == pytest.approx(alpha, abs=1e-6)
    assert stump_table(spark, model).count() == len(want)


def test_votes_and_edge_inputs(spark, labelled):
    model = fit_boosted(labelled, ["a", "c"], "y", rounds=20)
    got = model.predict(labelled).collect()
    assert sum(r.prediction == str(r.y) for r in got) / len(got) > 0.75
    one = fit_boosted(labelled.withColumn("y", F.lit("only")), ["a"], "y")
    assert one.stumps == () and {r.prediction for r in one.predict(labelled).collect()} == {"only"}
    none = fit_boosted(labelled.limit(0), ["a"], "y")
    assert none == Boosted((), (), none.bins) and none.predict(labelled).filter("prediction IS NOT NULL").count() == 0
    clear = labelled.withColumn("y", F.when(F.col("a") > F.lit(0.0), "up").otherwise("down"))
    assert len(fit_boosted(clear, ["a"], "y", bins=4000).stumps) <= 2  # right everywhere: it stops
    with pytest.raises(ValueError):
        fit_boosted(labelled, ["a"], "key", max_classes=10)


# -- scorers -------------------------------------------------------------------

def test_boosted_score(labelled, spark):
    s = score_boosted(labelled.drop("t"), "y", "key", max_iter=15)
    assert s.metric == "macro_f1" and s.higher_is_better and 0.6 < s.value <= 1
    assert s == score_boosted(labelled.drop("t").repartition(5), "y", "key", max_iter=15)
    three = labelled.drop("t").withColumn("y", F.when(F.col("a") > 1, "x").when(F.col("a") < -1, "w").otherwise("m"))
    assert score_boosted(three, "y", "key", max_iter=15).value > 0.6  # more than two classes
    assert score_boosted(labelled.drop("t").withColumn("y", F.lit(1)), "y", "key", max_iter=3).value == 1.0


def test_forest_scores(labelled):
    small = dict(num_trees=8, max_depth=4)
    a, b = (score_rf(labelled.drop("t"), "y", "key", seeds=(s,), **small) for s in (1, 2))
    both = score_rf(labelled.drop("t"), "y", "key", seeds=(1, 2), **small)
    assert 0.6 < a.value <= 1 and both.value == pytest.approx((a.value + b.value) / 2)  # M9
    assert a == score_rf(labelled.drop("t"), "y", "key", seeds=(1,), **small)
    assert score_rf(labelled.drop("t"), "y", "key", test=0.0, **small).value == 0.0  # nothing held out
    r = score_rf_reg(labelled.drop("y"), "t", "key", **small)
    assert not r.higher_is_better and 0 <= r.value < 1.6
    assert r == score_rf_reg(labelled.drop("y"), "t", "key", **small)
    assert score_rf_reg(labelled.drop("y"), "t", "key", test=0.0, **small).value is None


def test_search_and_importance(labelled):
    s = score_search(labelled.drop("t"), "y", "key", folds=2)
    assert s.metric == "binary_f1" and 0.6 < s.value <= 1
    rows = select_importance(labelled.drop("t"), "y", "key", num_trees=8, max_depth=4).orderBy("rank").collect()
    assert sum(r.importance for r in rows) == pytest.approx(1.0) and [r.selected for r in rows] == [True, False, False]
    assert rows[0].feature in ("a", "b")


def test_failing_fits_leave_nothing_cached(labelled, spark):
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    with pytest.raises(Exception):
        score_rf(labelled.drop("t"), "y", "key", num_trees=-1)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= before


def test_assembly_and_direction(labelled):
    v = assemble(labelled, ["a", "c", "t"]).orderBy("key").select("a", "c", "t", "features").first()
    assert v.features.toArray().tolist() == [v.a, v.c, v.t]
    up, down = Score(0.7, True, "f"), Score(0.7, False, "mae")
    assert up.better_than(Score(0.6, True, "f")) and not down.better_than(Score(0.6, False, "mae"))
    assert up.better_than(None) and not Score(None, True, "f").better_than(None)
    assert down.improvement(Score(0.9, False, "mae")) == pytest.approx(0.2)
