"""Row preservation for awkward keys, undefined numbers, and the loop's rules."""

import random

import pytest
from pyspark.sql import functions as F

from widen.functions.ranking import global_rank
from widen.operators.aggregate import min_max
from widen.operators.join import augment, key_overlap, left_join_m1, reduce_by_key
from widen.operators.profile import profile
from widen.operators.score import missing_ratios, mutual_info, pearson
from widen.plans.evaluate import Score
from widen.plans.loop import evaluate, method_status, run, MethodState
from widen.sources.tables import TableRef, read_table

NAN, INF = float("nan"), float("inf")


def test_null_keys_match_once(spark):
    base = spark.createDataFrame([(1, None), (2, "a")], "id int, k string")
    right = spark.createDataFrame([(None, 1.0, "x"), (None, 3.0, "x"), ("a", 5.0, "y")], "rk string, n double, t string")
    rows = {r.id: (r.n, r.t) for r in augment(base, right, left_keys="k", right_keys="rk", null_keys="match").collect()}
    assert rows == {1: (2.0, "x"), 2: (5.0, "y")}


@pytest.mark.parametrize("base_type, keys", [("int", ["1", "01", " 1", "x", None]), ("date", ["2020-01-02", " 2020-01-02", "no"]),
                                             ("timestamp", ["2020-01-02 00:00:00", "2020-01-02"])])
def test_text_keys_are_read_in_the_base_type(spark, base_type, keys):
    value = "1" if base_type == "int" else "2020-01-02"
    base = spark.createDataFrame([(value,), (None,)], "k string").select(F.col("k").cast(base_type).alias("k"))
    right = spark.createDataFrame([(k, float(i)) for i, k in enumerate(keys)], "rk string, n double")
    matching = [float(i) for i, k in enumerate(keys) if k and k.strip() not in ("x", "no")]
    for out in (augment(base, right, left_keys="k", right_keys="rk"), left_join_m1(base, right, "k", "rk")):
        got = [r.n for r in out.collect()]
        assert sorted(got, key=str) == sorted([sum(matching) / len(matching), None], key=str)
    o = key_overlap(base, "k", right, "rk").first()
    assert (o.n_rows, o.n_matched) == (2, 1)


def test_rows_never_change(spark):
    rnd = random.Random(1)
    for t in ("string", "int", "double"):
        base = spark.createDataFrame([(i, rnd.choice(["1", "02", "2", None, "q"])) for i in range(40)], "id int, k string")
        base = base.select("id", F.expr(f"try_cast(k AS {t})").alias("k"))
        right = spark.createDataFrame([(rnd.choice(["1", "01", "2", " 2", None, "q"]), float(i), rnd.choice("ab"))
                                       for i in range(60)], "rk string, n double, t string")
        for nulls in ("never", "match"):
            out = augment(base, right, left_keys="k", right_keys="rk", null_keys=nulls)
            assert sorted(r.id for r in out.collect()) == list(range(40))


def test_undefined_numbers(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, NAN, 4.0), (2, NAN, 6.0), (2, None, 9.0)], "k int, x double, y double")
    assert {r.k: r.x for r in reduce_by_key(df, "k", ["x"]).collect()} == {1: 1.0, 2: None}
    assert missing_ratios(df, ["x"]).first().missing_ratio == 0.75
    wide = spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)] + [(NAN, 1.0), (7.0, NAN)], "x double, y double")
    assert abs(pearson(wide, ["x"], "y").first().pearson - 1) < 1e-12
    rows = [(float(i % 2), "ab"[i % 2]) for i in range(100)]
    clean = spark.createDataFrame(rows, "x double, y string")
    dirty = spark.createDataFrame([*rows, (INF, "a"), (NAN, "a")], "x double, y string")
    a, b = (mutual_info(d, ["x"], "y").first().mutual_info for d in (clean, dirty))
    assert abs(a - 0.693147) < 1e-6 and b > 0.6


def test_large_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([(9007199254740993, 1e20), (9007199254740995, INF), (None, NAN)], "a long, b double")
    m = {r["column"]: r for r in min_max(df).collect()}
    assert (m["a"].min_int, m["a"].max_int) == (9007199254740993, 9007199254740995) and m["b"].max == INF
    p = {r["column"]: r for r in profile(df).collect()}
    assert int(p["a"]["max"]) == 9007199254740995 and p["b"]["max"] is None and int(p["b"]["min"]) == 10 ** 20


def test_rank_is_one_number_per_row(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v")).repartition(5)
    rows = global_rank(df, [F.col("v")], partitions=4).collect()
    assert all(r["rank"] == r.v + 1 for r in rows) and len(rows) == 500


def count_scorer(df, target, key):
    return Score(float(len(df.columns)), True, "columns")


def test_loop_with_recommendations_and_log(spark, tmp_path):
    base = spark.createDataFrame([(i, i % 2) for i in range(6)], "k int, y int")
    one = TableRef("one", spark.createDataFrame([(i, float(i), "c") for i in range(6)], "k1 int, a double, b string"), ["k"], ["k1"])
    two = TableRef("two", spark.createDataFrame([(i, float(i)) for i in range(6)], "k2 int, c double"), ["k"], ["k2"])
    rec = spark.createDataFrame([("one", "a", True), ("one", "nope", True), ("two", "c", True)],
                                "`table` string, feature string, recommended boolean")
    verdicts = spark.createDataFrame([("one", "Yes"), ("two", "No")], "`table` string, conclusion string")

    def scorer(df, target, key):
        if "b" in df.columns:
            raise RuntimeError("x" * 900)
        return count_scorer(df, target, key)

    h = run(base, "y", "k", [one, two], methods=("all", "recommended"), scorer=scorer, recommendations=rec, verdicts=verdicts,
            history_path=str(tmp_path / "log"))
    rows = {(r.method, r.augment_table): r for r in h.collect()}
    assert rows[("recommended", "one")].current_features == ["a"] and rows[("recommended", "one")].accepted
    assert rows[("recommended", "two")].selected_features == [] and not rows[("recommended", "two")].accepted
    assert len(rows[("all", "one")].error) > 900 and rows[("all", "two")].accepted  # isolated, and told in full
    status = {r.method: (r.score, r.n_features, r.last_round) for r in method_status(h).collect()}
    assert status == {"all": (3.0, 1, 1), "recommended": (3.0, 1, 2)}
    none = run(base, "y", "k", [one], methods=("recommended",), scorer=scorer, recommendations=rec.where("false"))
    assert [tuple(r) for r in method_status(none).collect()] == [("recommended", 2.0, 0, 0)]


def test_empty_selection_joins_nothing(spark):
    base = spark.createDataFrame([(1, 0)], "k int, y int")
    t = TableRef("t", spark.createDataFrame([(1, 2.0)], "k1 int, a double"), ["k"], ["k1"])
    df, score, joined = evaluate(MethodState(base, Score(1.0, True, "m")), t, [], "y", "k", None)
    assert joined == [] and df.columns == ["k", "y"] and score.value == 1.0


def test_csv_as_people_write_it(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('id,name,n,f\n1,"say ""hi"" x",NA,1.5\n2,"two\nlines",4,NaN\n3,plain,5,\n')
    df = read_table(spark, str(p), multiline=True)
    rows = {r.id: r for r in df.collect()}
    assert dict(df.dtypes) == {"id": "int", "name": "string", "n": "int", "f": "double"}
    assert rows[1].name == 'say "hi" x' and rows[2].name == "two\nlines" and rows[1].n is None and rows[2].f is None
    good, bad = read_table(spark, str(p), bad_rows="quarantine", multiline=True)
    assert good.count() == 3 and bad.count() == 0
