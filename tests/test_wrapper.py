"""Forward selection from sufficient statistics against a plain least squares
over the rows, for numbers and classes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from widen.operators.prep import split
from widen.operators.wrapper import forward_steps, moments, outer_sums, select_forward


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(2)
    out = []
    for i in range(400):
        a, b, c, d = (random.gauss(0, 1) for _ in range(4))
        t = 3 * a - 2 * b + 0.3 * c + random.gauss(0, 0.5) + 100
        out.append((i, a * 1e6, b, c, d, 5.0, a * 2e6 + 1, t, random.choice("xy") if t > 100 else "z"))
    df = spark.createDataFrame(out, "id int, a double, b double, c double, d double, flat double, copy double, y double, k string")
    return split(df, "id", 0.33, 1).cache()


FEATS = ["a", "b", "c", "d", "flat", "copy"]


def plain_score(rows, names, target, by_class):
    train, hold = ([r for r in rows if r.is_test == k] for k in (False, True))
    ys = sorted({r[target] for r in rows}) if by_class else [None]

    def part(rs):
        x = np.array([[1.0, *(r[n] / (1e6 if n in ("a", "copy") else 1) for n in names)] for r in rs])
        return x, np.array([[float(r[target] == y) if by_class else r[target] for y in ys] for r in rs])

    (x, y), (u, v) = part(train), part(hold)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return 1 - ((v - u @ beta) ** 2).sum() / ((v - y.mean(0)) ** 2).sum()


@pytest.mark.parametrize("target,task", [("y", "regression"), ("k", "classification")])
def test_steps_match_least_squares(rows, target, task):
    data = rows.collect()
    steps = forward_steps(moments(rows, FEATS, target, "is_test", task))
    names, now = [], 0.0
    for n, (step, action, feature, score, gain) in enumerate(steps, 1):
        own = {f: plain_score(data, [*names, f], target, task == "classification") for f in ("a", "b", "c", "d")
               if f not in names}
        best = max(own, key=own.get)
        assert (step, action, feature) == (n, "pick", best)
        assert score == pytest.approx(own[best], abs=1e-8) and gain == pytest.approx(score - now, abs=1e-8)
        names, now = [*names, best], score
    rest = [f for f in "abcd" if f not in names]
    assert all(plain_score(data, [*names, f], target, task == "classification") <= now + 1e-9 for f in rest)
    # a constant, and a copy of what is chosen, are never picked
    assert {"a", "b"} <= set(names) and not {"flat", "copy"} & set(names)


def test_limits_and_gain(rows):
    m = moments(rows, FEATS, "y", "is_test", "regression")
    assert len(forward_steps(m, k=1)) == 1 and forward_steps(m, min_gain=0.99) == []
    assert all(s[4] > 0.01 for s in forward_steps(m, min_gain=0.01))


def test_an_early_pick_is_dropped(spark):
    # d is the best single column, but b + c make it superfluous and it is noisy on the held-out rows
    random.seed(5)
    out = []
    for i in range(600):
        b, c = random.gauss(0, 1), random.gauss(0, 1)
        out.append((i, b, c, b + c + random.gauss(0, 0.4), random.gauss(0, 1), b + c))
    df = split(spark.createDataFrame(out, "id int, b double, c double, d double, e double, y double"), "id", 0.33, 1)
    m = moments(df, ["b", "c", "d", "e"], "y", "is_test", "regression")
    plain, floating = forward_steps(m), forward_steps(m, drop=True)
    assert plain[0][2] == "d" and floating[0][2] == "d"
    assert all(s[3] <= t[3] + 1e-12 for s, t in zip(floating, floating[1:]))
    assert floating[-1][3] >= plain[-1][3] - 1e-12


def test_outer_sums_and_empty_parts(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double").repartition(3)
    assert outer_sums(df, ["a", "b"], ["b"]).tolist() == [[14.0], [20.0]]
    assert outer_sums(df.limit(0), ["a"], ["b"]).tolist() == [[0.0]]
    with pytest.raises(ValueError):
        moments(df.withColumn("t", F.lit(True)), ["a"], "b", "t", "regression")
    assert forward_steps(moments(df.withColumn("t", F.lit(False)), ["a"], "b", "t", "regression")) == []


def test_many_classes_stay_in_the_tasks(spark):
    n = 300  # every row nearly a class of its own
    df = spark.createDataFrame([(i, float(i % 7), f"c{i // 2}") for i in range(n)], "id int, a double, y string")
    out = select_forward(df, "y", "id", "classification")
    assert out.columns == ["step", "action", "feature", "score", "gain"] and out.count() <= 1


def test_text_and_missing_columns_are_prepared(spark):
    random.seed(1)
    out = [(i, random.choice(["p", "q", None]), random.choice([None, 1.0, 2.0])) for i in range(300)]
    out = [(i, s, x, (3.0 if s == "q" else 0.0) + (x or 1.5) + random.gauss(0, 0.1)) for i, s, x in out]
    df = spark.createDataFrame(out, "id int, s string, x double, y double")
    steps = select_forward(df, "y", "id", "regression").orderBy("step").collect()
    assert [r.feature for r in steps] == ["s", "x"] and steps[-1].score > 0.5


def test_preparation_without_text_columns_leaves_the_key(spark):
    # no text and no numeric features must not mean "all columns"
    from widen.operators.prep import clean_inf, encode, impute_median, model_frame

    df = spark.createDataFrame([("k9", 1.0, "b"), ("k1", None, "a"), ("k5", 3.0, "b")], "key string, x double, y string")
    out, _ = model_frame(df, "y", "classification", passthrough=["key"])
    assert {(r.key, r.x, r.y) for r in out.collect()} == {("k9", 1.0, 1), ("k1", 2.0, 0), ("k5", 3.0, 1)}
    assert encode(df, []).collect() == impute_median(df, []).collect() == clean_inf(df, []).collect() == df.collect()
