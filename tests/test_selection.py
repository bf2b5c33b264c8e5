"""The k-th smallest value by histograms, medians, and sampling by hash."""

import math
import random

import pytest
from pyspark.sql import functions as F

from widen.functions.columns import hash_order
from widen.functions.selection import _first_rows, _Search, kth_smallest, medians, smallest_by_hash
from widen.operators.prep import balance


def _odd_number():
    k = random.random()
    if k < 0.1:
        return None
    if k < 0.15:
        return random.choice([math.inf, -math.inf, math.nan, 0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308])
    if k < 0.4:
        return 7.0  # a third of the rows hold one value
    if k < 0.6:
        return float(random.randint(-5, 5))
    if k < 0.8:
        return random.gauss(0, 1) * 10 ** random.randint(-300, 300)
    return random.random()


@pytest.mark.parametrize("n", [0, 1, 2, 101, 1500])
def test_kth_smallest_against_sort(spark, n):
    random.seed(n)
    rows = [(_odd_number(), random.choice([1.0, 2.0]), i) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c long").repartition(3)

    def ranks(count):
        return 1, 2, (count + 1) // 2, count // 2 + 1, count, count + 1

    got = kth_smallest(df, {c: F.col(c) for c in "abc"}, ranks)
    for j, c in enumerate("abc"):
        v = sorted(float(r[j]) for r in rows if r[j] is not None and not math.isnan(r[j]))
        assert got[c] == [v[k - 1] if 1 <= k <= len(v) else None for k in ranks(len(v))]


def test_neighbouring_doubles_and_modes(spark):
    xs = [1.0 + i * 2.0**-52 for i in range(3000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert kth_smallest(df, {"x": F.col("x")}, lambda n: (1700,))["x"] == [xs[1699]]
    assert _Search("x", 1, 1.0, 1.0 + 2**-50).mode == "value"
    assert _Search("x", 1, -1.0, 5.0).mode == "log" and _Search("x", 1, 2.0, 5.0).mode == "linear"


def test_medians_interpolate_and_miss(spark):
    df = spark.createDataFrame([(1.0, 4, None), (2.0, 2, None), (math.nan, 9, None)], "a double, b int, c double")
    assert medians(df, {c: F.col(c) for c in "abc"}) == {"a": 1.5, "b": 4.0, "c": None}


def test_no_sort_in_the_plans(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    plan = balance(df, "y", "id", major=0)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "Sort" not in plan


def test_balance_takes_the_smallest_hashes(spark):
    rows = [(i, int(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, y int").repartition(4)
    order = {r.k: r.h for r in df.select("k", hash_order(7, F.col("k")).alias("h")).collect()}
    want = sorted((k for k, y in rows if not y), key=order.get)[:80]
    got = balance(df, "y", "k", major=0, seed=7).collect()
    assert sorted(r.k for r in got if not r.y) == sorted(want) and sum(r.y for r in got) == 80


@pytest.mark.parametrize("n", [0, 1, 5, 37, 60, 100])
def test_equal_hashes_at_the_cut(spark, n):
    # 50 rows share one key, so the cut-off may fall among equal hashes
    df = spark.createDataFrame([(min(i, 20), i) for i in range(70)], "k int, i int").repartition(3)
    got = smallest_by_hash(df, hash_order(1, F.col("k")), n).collect()
    assert len(got) == len({r.i for r in got}) == min(n, 70)
    assert _first_rows(df, n).count() == min(n, 70)
