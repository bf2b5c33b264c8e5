"""Wide tables are reduced with one shuffle of the rows, and joined once a query."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from widen.operators import join
from widen.operators.join import augment, reduce_by_key
from widen.operators.prep import model_frame
from widen.operators.score import mutual_info
from widen.operators.wrapper import select_forward

ROWS = ([(1, "b", 1.0, dt.datetime(2024, 1, 2)), (1, "a", 3.0, None), (1, "a", None, dt.datetime(2024, 1, 1)),
         (1, "b", 8.0, dt.datetime(2024, 1, 1)), (2, None, 5.0, None), (2, "z", 5.0, None), (3, None, None, None),
         (None, "q", 1.0, None)] + [(4, f"v{i % 7}", float(i), None) for i in range(60)])
SCHEMA = "k long, s string, x double, t timestamp_ntz"


def _final_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("token", [None, "a", "nan"])
@pytest.mark.parametrize("nulls", [False, True])
def test_crowded_keys_reduce_alike(spark, monkeypatch, token, nulls):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = []
    for limit in (0, 5, 1000):  # all keys by counts, some, none
        monkeypatch.setattr(join, "CROWDED", limit)
        out = reduce_by_key(df, "k", null_token=token, keep_null_keys=nulls)
        got.append(sorted(map(tuple, out.collect()), key=str))
    assert got[0] == got[1] == got[2]
    assert len(got[0]) == 4 + nulls


def test_reduced_values(spark):
    got = {r.k: (r.s, r.x, r.t) for r in reduce_by_key(spark.createDataFrame(ROWS, SCHEMA), "k").collect()}
    assert got == {1: ("a", 4.0, dt.datetime(2024, 1, 1)), 2: ("z", 5.0, None), 3: (None, None, None), 4: ("v0", 29.5, None)}


def test_rows_are_not_multiplied_before_the_shuffle(spark):
    right = spark.range(3000).select((F.col("id") % 700).alias("k"), F.col("id").cast("string").alias("s"),
                                     (F.col("id") % 5).cast("double").alias("x"))
    out = reduce_by_key(right, "k")
    assert len(out.collect()) == 700
    assert "Generate" not in _final_plan(out)  # no key is crowded, so no long form


def _read_counted(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.range(400).select("id", (F.col("id") % 3).cast("string").alias("y"), (F.col("id") * 1.5).alias("t"),
                                 F.when(F.col("id") % 4 > 0, F.col("id") % 11).cast("double").alias("x"),
                                 (F.col("id") % 2).cast("string").alias("s"))
    return df.mapInArrow(seen, df.schema), reads


def _checkpoint_reads(spark):
    df, reads = _read_counted(spark)
    df.checkpoint(eager=True)
    return reads.value


@pytest.mark.parametrize("run", [
    lambda df: mutual_info(df, ["x", "s"], "y").collect(),
    lambda df: model_frame(df, "y", "classification", passthrough=["id"])[0].collect(),
    lambda df: select_forward(df, "t", "id", "regression", ["x"], k=1).collect()])
def test_input_is_computed_once(spark, run):
    """However many passes there are, the input runs as often as for one checkpoint."""
    once = _checkpoint_reads(spark)
    df, reads = _read_counted(spark)
    run(df)
    assert reads.value == once


def test_augment_keeps_rows_with_crowded_keys(spark, monkeypatch):
    monkeypatch.setattr(join, "CROWDED", 5)
    base = spark.createDataFrame([(i,) for i in (1, 1, 2, 4, 9, None)], "b long")
    out = augment(base, spark.createDataFrame(ROWS, SCHEMA), ["s", "x"], "b", "k")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "a", 4.0), (1, "a", 4.0), (2, "z", 5.0), (4, "v0", 29.5), (9, None, None), (None, None, None)], key=str)
