"""The loop joins a round's table once for all methods that stand at one table,
and codes of a few short texts are looked up in a list."""

import random
import threading

import pytest
from pyspark.sql import functions as F

import widen.operators.select as select
import widen.plans.loop as loop
from widen.operators.prep import FEW, LISTED, encode, model_frame
from widen.plans.evaluate import Score
from widen.sources.tables import TableRef


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(i, i % 4, ("no", "yes")[i % 3 == 1]) for i in range(90)], "k int, z int, y string").cache()


def table(spark):
    random.seed(5)
    made = [(i % 80, ("low", "high")[i % 3 == 1], float(i % 3 == 1), random.random(), None if i % 7 else i) for i in range(160)]
    return spark.createDataFrame(made, "rk int, word string, tell double, dust double, hole int")


def score(df, target, key):
    worth = {"tell": 0.4, "dust": 0.1, "word": 0.2}
    assert df.count() == 90
    return Score(0.1 + sum(v for c, v in worth.items() if c in df.columns), True, "made")


def counted(monkeypatch):
    """Feature lists of every join that is made."""
    calls, lock, real = [], threading.Lock(), loop.augment

    def augment(b, t, features=None, *a, **k):
        with lock:
            calls.append(tuple(features or ()))
        return real(b, t, features, *a, **k)

    monkeypatch.setattr(loop, "augment", augment)
    monkeypatch.setattr(select, "augment", augment)
    return calls


def test_a_round_joins_its_table_once(spark, base, monkeypatch):
    t = table(spark)
    calls = counted(monkeypatch)
    wanted = spark.createDataFrame([("t", "word", True)], "table string, feature string, recommended boolean")
    got = {r.method: r for r in loop.run(base, "y", "k", [TableRef("t", t, ["k"], ["rk"])], (*loop.METHODS, loop.RECOMMENDED),
                                         score, recommendations=wanted).collect()}
    assert calls == [("word", "tell", "dust", "hole")]
    assert got["all"].selected_features == ["word", "tell", "dust", "hole"] and got["all"].accepted
    assert got["recommended"].current_features == ["word"]
    # what the selectors choose by the shared join is what they choose by a join of their own
    assert got["filter"].selected_features == select.chosen(select.select_filter(base, TableRef("t", t, ["k"], ["rk"]), "y"))
    assert got["mutual_info"].selected_features == select.chosen(
        select.select_mutual_info(base, TableRef("t", t, ["k"], ["rk"]), "y"))


def test_methods_at_other_tables_do_not_share(spark, base, monkeypatch):
    one, two = table(spark).select("rk", "tell", "dust"), table(spark).select("rk", "word")
    wanted = spark.createDataFrame([("one", "dust", True), ("two", "word", True)], "table string, feature string, recommended boolean")
    calls = counted(monkeypatch)
    pool = [TableRef("two", two, ["k"], ["rk"]), TableRef("one", one, ["k"], ["rk"])]
    got = {(r["round"], r.method): r for r in loop.run(base, "y", "k", pool, ("all", "recommended"), score, recommendations=wanted).collect()}
    assert got[2, "all"].current_features == ["tell", "dust", "word"]
    assert got[2, "recommended"].current_features == ["dust", "word"]
    assert sorted(calls) == [("tell", "dust"), ("word",), ("word",)]


def test_columns_that_cannot_be_reduced_fail_their_methods_only(spark, base):
    t = table(spark).withColumn("list", F.array("tell"))
    got = {r.method: r for r in loop.run(base, "y", "k", [TableRef("t", t, ["k"], ["rk"])], ("all", "filter"), score).collect()}
    assert "TypeError" in got["all"].error and not got["all"].accepted
    assert got["filter"].error is None and "word" in got["filter"].selected_features


@pytest.mark.parametrize("values", [["b", "a", None, "", "é", "z", "~", "\U0001f600", "Z", "a"], [None, None],
                                    [f"v{i}" for i in range(LISTED + 5)], ["x" * 5000, "y", None]])
def test_listed_codes_are_the_joined_ones(spark, values):
    df = spark.createDataFrame([(i, v, values[-1 - i]) for i, v in enumerate(values)], "i int, s string, `t.u` string")
    own = sorted(encode(df, ["s", "t.u"], listed=True).collect())
    assert own == sorted(encode(df, ["s", "t.u"]).collect())
    order = {v: n for n, v in enumerate(sorted({v for v in values if v is not None}, key=lambda v: v.encode()))}
    assert [r["s"] for r in own] == [order.get(v, -1) for v in values]


def test_a_large_frame_stays_in_its_partitions(spark):
    df = spark.range(FEW + 50, numPartitions=3).select(
        F.col("id").alias("key"), F.concat(F.lit("c"), F.col("id") % 3).alias("y"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("w"), F.col("id") % 5)).alias("word"), (F.col("id") % 11).alias("n"))
    out, feats = model_frame(df, "y", "classification", passthrough=["key"])
    assert feats == ["word", "n"]
    place = F.spark_partition_id().alias("p")
    assert out.select("key", place).exceptAll(df.select("key", place)).count() == 0
    codes = {(r.y, r.word, r.key % 3, r.key % 5) for r in out.collect()}
    assert codes == {(i % 3, float(i % 5), i % 3, i % 5) for i in range(15)}  # MISSING comes before w1
