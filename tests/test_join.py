"""J1-J5, A1, P1/P2 on hand fixtures (FIXTURES.md §3) and properties."""

import math

import pytest
from pyspark.sql import functions as F

from widen.operators.join import augment, fanout, key_overlap, left_join, left_join_m1, plan_features, reduce_by_key
from widen.sources.tables import TableRef


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_reduce_rules(spark):
    # dup_keys + mode_ties: number -> mean, text -> mode (smallest on tie), bool -> mean, all-null -> null
    df = spark.createDataFrame(
        [(1, 1.0, "b", True, None), (1, 3.0, "a", False, None), (1, None, "a", True, None), (1, 5.0, "b", True, None),
         (2, 7.0, "z", None, None), (None, 9.0, "q", True, None)],
        "k int, x double, s string, b boolean, n string")
    out = {r["k"]: r for r in reduce_by_key(df, "k").collect()}
    assert set(out) == {1, 2}  # null keys dropped like pandas groupby
    assert out[1]["x"] == pytest.approx(3.0)
    assert out[1]["s"] == "a"  # a:2, b:2 -> smallest
    assert out[1]["b"] == pytest.approx(0.75)
    assert out[1]["n"] is None
    assert out[2]["x"] == 7.0 and out[2]["s"] == "z" and out[2]["b"] is None


def test_reduce_constant_keeps_exact_value(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.1), (1, 0.1)], "k int, x double")
    assert reduce_by_key(df, "k").first()["x"] == 0.1


def test_reduce_null_token(spark):
    df = spark.createDataFrame([(1, "b"), (1, None), (1, None), (1, "a"), (2, None), (3, "c"), (3, None)],
                               "k int, s string")
    out = {r["k"]: r["s"] for r in reduce_by_key(df, "k", null_token="nan").collect()}
    assert out == {1: "nan", 2: None, 3: "c"}


def test_reduce_rejects_arrays(spark):
    df = spark.createDataFrame([(1, [1.0])], "k int, v array<double>")
    with pytest.raises(TypeError):
        reduce_by_key(df, "k")


def test_reduce_matches_pandas_brute_force(spark):
    import random

    rnd = random.Random(7)
    data = [(rnd.randint(0, 20), rnd.choice([None, rnd.random()]), rnd.choice([None, "a", "b", "c"]))
            for _ in range(400)]
    df = spark.createDataFrame(data, "k int, x double, s string")
    got = {r["k"]: (r["x"], r["s"]) for r in reduce_by_key(df, "k").collect()}
    for k in {d[0] for d in data}:
        xs = [d[1] for d in data if d[0] == k and d[1] is not None]
        ss = [d[2] for d in data if d[0] == k and d[2] is not None]
        mean = None if not xs else (xs[0] if len(set(xs)) == 1 else sum(xs) / len(xs))
        mode = None
        if ss:
            cnt = {v: ss.count(v) for v in set(ss)}
            mode = sorted(cnt, key=lambda v: (-cnt[v], v))[0]
        gx, gs = got[k]
        assert (gx is None and mean is None) or math.isclose(gx, mean, rel_tol=1e-12)
        assert gs == mode


def test_augment_keeps_rows_and_columns(spark):
    base = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "w")], "k int, v string")
    right = spark.createDataFrame([(1, 10.0, "p"), (1, 20.0, "q"), (2, 5.0, "r"), (None, 1.0, "n")],
                                  "rk int, amount double, tag string")
    out = augment(base, right, None, left_keys="k", right_keys="rk", validate=True)
    assert out.count() == 4
    assert out.columns == ["k", "v", "amount", "tag"]
    got = {r["k"]: (r["amount"], r["tag"]) for r in out.collect()}
    assert got[1] == (15.0, "p") and got[3] == (None, None) and got[None] == (None, None)


def test_null_keys_match_option(spark):
    base = spark.createDataFrame([(1,), (None,)], "k int")
    right = spark.createDataFrame([(1, 1.0), (None, 2.0)], "k int, x double")
    never = augment(base, right, ["x"], left_keys="k", right_keys="k")
    match = augment(base, right, ["x"], left_keys="k", right_keys="k", null_keys="match")
    assert never.filter(F.col("x").isNotNull()).count() == 1
    assert match.filter(F.col("x").isNotNull()).count() == 2


def test_collisions_and_odd_names(spark):
    base = spark.createDataFrame([(1, "a", 0.5)], "`id` int, `V` string, `rk` double")
    right = spark.createDataFrame([(1, "b", 2.0, 3.0)], "`rk` int, `v` string, `a.b` double, `SCHOOL LEVEL*` double")
    plan = plan_features(base.columns, right.columns, ["rk"], ["v", "a.b", "nope", "SCHOOL LEVEL*"])
    assert plan.kept == ("a.b", "SCHOOL LEVEL*") and plan.collisions == ("v",) and plan.unknown == ("nope",)
    out = augment(base, right, ["v", "a.b", "SCHOOL LEVEL*"], left_keys="id", right_keys="rk")
    assert out.columns == ["id", "V", "rk", "a.b", "SCHOOL LEVEL*"]
    assert out.first()["a.b"] == 2.0 and out.first()["rk"] == 0.5  # base column named like the right key survives


def test_only_collisions_returns_base(spark):
    base = spark.createDataFrame([(1, 1.0)], "k int, x double")
    right = spark.createDataFrame([(1, 2.0)], "k int, x double")
    assert augment(base, right, ["x"], left_keys="k", right_keys="k") is base


def test_key_types_string_vs_number(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([("1", 1.0), ("x", 2.0)], "k string, v double")
    out = left_join_m1(base, right, "k", "k")
    assert rows(out, "k") == [(1, 1.0), (2, None)]


def test_auto_reduce_keeps_types(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 5), (2, 6)], "k int, n int")
    out = augment(base, right, ["n"], left_keys="k", right_keys="k", reduce="auto")
    assert dict(out.dtypes)["n"] == "int"
    out2 = augment(base, right, ["n"], left_keys="k", right_keys="k")
    assert dict(out2.dtypes)["n"] == "double"


def test_fanout_and_overlap(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k int")
    r = fanout(df, "k").first()
    assert (r["n_keys"], r["n_dup_keys"], r["max_rows_per_key"]) == (2, 1, 2)
    base = spark.createDataFrame([(1,), (2,), (3,), (3,)], "k int")
    o = key_overlap(base, "k", df, "k").first()
    assert (o["n_rows"], o["n_matched"], o["overlap"]) == (4, 2, 0.5)


def test_left_join_fanout_multiplies(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "rk int, t string")
    assert left_join(base, right, "k", "rk").count() == 3


def test_tableref_composite_keys(spark):
    base = spark.createDataFrame([(1, "a"), (1, "b")], "k1 int, k2 string")
    right = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (1, "b", 5.0)], "r1 int, r2 string, x double")
    t = TableRef("r", right, ["k1", "k2"], ["r1", "r2"])
    got = {(r["k1"], r["k2"]): r["x"] for r in augment(base, t).collect()}
    assert got == {(1, "a"): 2.0, (1, "b"): 5.0}


def test_plan_has_no_python_udf_or_cartesian(spark):
    from tests.conftest import SF

    cust = spark.read.parquet(f"{SF}/customer.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    out = augment(cust, orders, ["o_totalprice", "o_orderpriority"], left_keys="c_custkey", right_keys="o_custkey")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "Cartesian" not in plan
    assert "PushedFilters: [IsNotNull(o_custkey)]" in plan
    assert out.count() == cust.count()
