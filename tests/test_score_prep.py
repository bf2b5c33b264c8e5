"""F1-F5 and E1-E11 on hand fixtures, checked against brute force."""

import math

import pytest
from pyspark.sql import functions as F

from widen.functions.ranking import exact_medians, global_rank
from widen.operators.prep import (
    balance,
    category_codes,
    clean_inf,
    encode,
    impute_constant,
    impute_median,
    split,
    to_numeric,
    variances,
)
from widen.operators.score import cramers_v, missing_ratios, mutual_info, pearson, scores


def chi2_yates_2x2(a, b, c, d):
    n = a + b + c + d
    r = [a + b, c + d]
    k = [a + c, b + d]
    obs = [[a, b], [c, d]]
    s = 0.0
    for i in range(2):
        for j in range(2):
            e = r[i] * k[j] / n
            dd = abs(obs[i][j] - e)
            dd -= min(0.5, dd)
            s += dd * dd / e
    return s


def test_pearson_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0), (None, 4.0)], "x double, y double")
    assert pearson(df, ["x"], "y").first()["pearson"] is None
    df2 = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5), (None, 1.0)], "x double, y double")
    r = pearson(df2, ["x"], "y").first()["pearson"]
    xs, ys = [1, 2, 3], [2, 4, 6.5]
    mx, my = sum(xs) / 3, sum(ys) / 3
    exp = sum((a - mx) * (b - my) for a, b in zip(xs, ys)) / math.sqrt(
        sum((a - mx) ** 2 for a in xs) * sum((b - my) ** 2 for b in ys))
    assert r == pytest.approx(exp)


def test_cramers_v_two_by_two_yates(spark):
    # labels counts: (quality, toxic) = (1,0) 299, (1,1) 42, (0,0) 49, (0,1) 9
    data = [(1, 0)] * 299 + [(1, 1)] * 42 + [(0, 0)] * 49 + [(0, 1)] * 9
    df = spark.createDataFrame(data, "quality int, toxic int")
    r = cramers_v(df, ["toxic"], "quality").first()
    chi2 = chi2_yates_2x2(299, 42, 49, 9)
    assert r["chi2"] == pytest.approx(chi2)
    assert r["cramers_v"] == pytest.approx(math.sqrt(chi2 / 399))


def test_cramers_v_general_and_one_level(spark):
    data = [("a", "x")] * 5 + [("a", "y")] * 1 + [("b", "y")] * 4 + [("c", "x")] * 2 + [("c", "z")] * 3
    df = spark.createDataFrame(data + [(None, "x")], "f string, y string")
    r = cramers_v(df, ["f"], "y").first()
    # dense brute force
    n = len(data)
    rows_ = sorted({a for a, _ in data})
    cols_ = sorted({b for _, b in data})
    chi2 = 0.0
    for a in rows_:
        for b in cols_:
            o = sum(1 for p in data if p == (a, b))
            e = sum(1 for p in data if p[0] == a) * sum(1 for p in data if p[1] == b) / n
            chi2 += (o - e) ** 2 / e
    assert r["chi2"] == pytest.approx(chi2)
    assert r["cramers_v"] == pytest.approx(math.sqrt(chi2 / (n * 2)))
    one = spark.createDataFrame([("a", "x"), ("a", "y")], "f string, y string")
    assert cramers_v(one, ["f"], "y").first()["cramers_v"] == 0.0


def test_mutual_info_brute_force(spark):
    data = [("a", "p"), ("a", "p"), ("b", "q"), ("b", "p"), (None, "q"), ("a", None)]
    df = spark.createDataFrame(data, "f string, y string")
    got = mutual_info(df, ["f"], "y").first()["mutual_info"]
    pairs = [(a or "MISSING", b or "MISSING") for a, b in data]
    n = len(pairs)
    exp = 0.0
    for p in set(pairs):
        o = pairs.count(p)
        r = sum(1 for q in pairs if q[0] == p[0])
        c = sum(1 for q in pairs if q[1] == p[1])
        exp += o / n * math.log(o * n / (r * c))
    assert got == pytest.approx(exp)
    assert got >= 0


def test_scores_skip_numeric_vs_class(spark):
    df = spark.createDataFrame([(1.0, "a", "x"), (2.0, "b", "y"), (None, "a", "x")], "n double, s string, y string")
    got = {r["feature"]: r for r in scores(df, ["n", "s"], "y").collect()}
    assert got["n"]["score"] == 0.0 and got["n"]["measure"] == "none"
    assert got["s"]["measure"] == "cramers_v"
    assert missing_ratios(df, ["n"]).first()["missing_ratio"] == pytest.approx(1 / 3)


def test_exact_medians_match_statistics(spark):
    import random
    import statistics

    rnd = random.Random(3)
    vals = [rnd.choice([1.0, 2.0, rnd.random()]) for _ in range(501)] + [None]
    df = spark.createDataFrame([(v, v if v is None else -v) for v in vals], "a double, b double")
    got = {r["column"]: r["median"] for r in exact_medians(df, ["a", "b"], 5).collect()}
    clean = [v for v in vals if v is not None]
    assert got["a"] == pytest.approx(statistics.median(clean))
    assert got["b"] == pytest.approx(statistics.median([-v for v in clean]))
    even = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "a double")
    assert exact_medians(even, ["a"]).first()["median"] == 2.5
    empty = spark.createDataFrame([(None,)], "a double")
    assert exact_medians(empty, ["a"]).first()["median"] is None


def test_global_rank_is_exact(spark):
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    ranked = global_rank(df, [F.col("v")], "r", partitions=7)
    assert all(r["r"] == r["v"] + 1 for r in ranked.collect())


def test_impute_and_clean(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (None, None, None), (3.0, None, "b"), (10.0, None, None)],
                               "x double, allnull double, s string")
    m = {r[0]: r for r in impute_median(df).select(F.col("x"), "allnull").collect()}
    assert sorted(m) == [1.0, 3.0, 10.0] and all(r["allnull"] == 0.0 for r in m.values())
    c = impute_constant(df).collect()
    assert {r["s"] for r in c} == {"a", "b", "MISSING"} and all(r["x"] is not None for r in c)
    inf = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (2.0,)], "v double")
    assert sorted(r["v"] for r in clean_inf(inf).collect()) == [0.0, 0.0, 0.0, 0.0, 2.0]
    num = spark.createDataFrame([("1",), ("x",), (None,), ("2.5",)], "v string")
    assert [r["v"] for r in to_numeric(num, ["v"]).collect()] == [1.0, None, None, 2.5]


def test_codes_sorted_and_null(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "s string")
    codes = {r["value"]: r["code"] for r in category_codes(df, "s", 3).collect()}
    assert codes == {"a": 0, "b": 1, "c": 2}
    assert sorted(r["s"] for r in encode(df, ["s"]).collect()) == [-1, 0, 0, 1, 2]


def test_split_stable_and_disjoint(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "k")
    a = split(df, "k", 0.2, seed=1)
    b = split(df.withColumn("extra", F.lit(1)).repartition(13), "k", 0.2, seed=1)
    ta = {r["k"] for r in a.filter("is_test").collect()}
    tb = {r["k"] for r in b.filter("is_test").collect()}
    assert ta == tb and 300 < len(ta) < 500


def test_balance_keeps_minority_whole(spark):
    data = [(i, 1) for i in range(300)] + [(1000 + i, 0) for i in range(40)] + [(2000 + i, 2) for i in range(50)]
    df = spark.createDataFrame(data, "k int, y int")
    out = balance(df, "y", "k", major=1, seed=42)
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {1: 40, 0: 40, 2: 50}
    again = {r["k"] for r in balance(df.repartition(5), "y", "k", major=1, seed=42).filter("y = 1").collect()}
    assert again == {r["k"] for r in out.filter("y = 1").collect()}


def test_low_variance_is_population(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (1.0,)], "x double")
    v = variances(df).first()
    assert v["var_pop"] == pytest.approx(2 / 9) and v["low"] is False
