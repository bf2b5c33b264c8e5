"""Columns that no score is defined for are reported, not raised on; the task of a target."""

import pytest
from pyspark.sql import functions as F

from widen.operators.profile import infer_task, task_of
from widen.operators.select import leak_scan, select_filter, select_mutual_info
from widen.sources.tables import TableRef


@pytest.fixture(scope="module")
def pair(spark):
    base = spark.createDataFrame([(i, float(i)) for i in range(40)], "k int, y double")
    right = spark.createDataFrame([(i, i * 2.0, [i]) for i in range(40)], "rk int, x double, list array<int>").withColumn(
        "map", F.create_map(F.lit("a"), "x"))
    return base, TableRef("t", right, ["k"], ["rk"])


def test_arrays_and_maps_are_unsupported(pair):
    base, t = pair
    rows = {r.feature: r for r in select_filter(base, t, "y").collect()}
    assert rows["x"].selected and rows["x"].measure == "pearson"
    assert all((rows[c].measure, rows[c].kind, rows[c].selected) == ("unsupported", "other", False) for c in ("list", "map"))
    scan = {r.feature: (r.measure, r.flagged) for r in leak_scan(base, t, "y").collect()}
    assert scan == {"x": ("pearson", True), "list": ("unsupported", False), "map": ("unsupported", False)}
    mi = {r.feature: r for r in select_mutual_info(base, t, "y", "regression", k=3).collect()}
    assert mi["x"].selected and mi["list"].mutual_info is None and not mi["list"].selected


def test_a_table_of_odd_columns_only(spark, pair):
    base, t = pair
    only = TableRef("o", t.df.select("rk", "list"), ["k"], ["rk"])
    assert [(r.feature, r.measure, r.selected) for r in select_filter(base, only, "y").collect()] == [("list", "unsupported", False)]
    assert [(r.feature, r.measure) for r in leak_scan(base, only, "y").collect()] == [("list", "unsupported")]


@pytest.mark.parametrize("n", [1, 10, 11, 150, 3000])
def test_task_of_a_number(spark, n):
    df = spark.range(3000).select((F.col("id") % n).alias("y"), F.lit("a").alias("s"))
    assert task_of(df, "y") == infer_task(df, "y").first().task == ("classification" if n <= 10 else "regression")
    assert task_of(df, "s") == "classification"
    with pytest.raises(ValueError):
        task_of(df, "none")
