"""The loop over catalog entries: visiting order, failing tables, shared
scoring, concurrent methods, resuming a stopped run, and the files it writes."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from widen.plans.evaluate import Score
from widen.plans.loop import RunLog, compare, round_log, run, write_run
from widen.sources.catalog import PoolEntry, load_pool
from widen.sources.tables import TableRef, load_tables

CATALOG = "id string, dataset_name string, score double, left_columns_names string, right_columns_names string, size bigint, join_key int, description string"


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(3)
    base = spark.createDataFrame([(i, i % 3, int(i % 3 == 1)) for i in range(60)], "k int, z int, y int").cache()
    lake = {
        "good": spark.createDataFrame([(i, float(i % 3 == 1), random.random()) for i in range(60)], "rk int, tell double, dust double"),
        "more": spark.createDataFrame([(i, float(i % 2), float(i % 3)) for i in range(60)], "rk int, half double, third double"),
        "dull": spark.createDataFrame([(i, 1.0) for i in range(60)], "rk int, one double"),
    }
    return base, lake


def catalog(spark, names):
    rows = [(f"{n}.rk", n, 1.0 - i / 10, "['k']", "['rk']", 1000 - 10 * i, i, f"about {n}") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, CATALOG)


class Scorer:
    """Counts columns that are worth something; stops the run when it is told to."""

    worth = {"tell": 0.4, "half": 0.1, "third": 0.2}

    def __init__(self, stop_at=None):
        self.calls, self.stop_at, self.lock = [], stop_at, threading.Lock()

    def __call__(self, df, target, key):
        with self.lock:
            self.calls.append(tuple(sorted(df.columns)))
            if self.stop_at is not None and len(self.calls) >= self.stop_at:
                raise KeyboardInterrupt
        assert df.count() == 60
        return Score(0.1 + sum(v for c, v in self.worth.items() if c in df.columns), True, "made")


def open_from(lake, opened):
    def open_table(name):
        opened.append(name)
        return lake[name]
    return open_table


def shown(history):
    return sorted(tuple(str(r[c]) for c in sorted(history.columns) if c != "timestamp") for r in history.collect())


def test_policies_and_lazy_opening(spark, tables):
    base, lake = tables
    c = catalog(spark, ["good", "more", "dull", "gone"])
    opened = []
    present = spark.createDataFrame([("good",), ("more",), ("dull",)], "dataset_name string")
    for policy, names in (("catalog_desc", ["dull", "more", "good"]), ("score", ["good", "more", "dull"]), ("size", ["dull", "more", "good"])):
        pool = load_pool(c, open_from(lake, opened), present, policy)
        assert [p.name for p in pool] == names and opened == []
        got = run(base, "y", "k", pool, methods=("all",), scorer=Scorer())
        assert [r.augment_table for r in got.orderBy("round").collect()] == names
        opened.clear()
    entry = load_pool(c, open_from(lake, opened))[0]
    assert isinstance(entry, PoolEntry) and (entry.left_keys, entry.right_keys) == (("k",), ("rk",))
    assert entry.name == "gone" and entry.description == "about gone"
    twice = c.unionByName(c.withColumn("id", F.concat("id", F.lit("2"))).withColumn("score", F.lit(0.01)))
    assert len(load_pool(twice, lake.get)) == 4 and len(load_pool(twice, lake.get, one_per_dataset=False)) == 8


def test_a_failing_table_is_passed_over(spark, tables):
    base, lake = tables
    pool = load_pool(catalog(spark, ["good", "gone", "more"]), open_from(lake, []), policy="score")
    rows = {(r["round"], r.method): r for r in run(base, "y", "k", pool, methods=("all", "random"), scorer=Scorer()).collect()}
    assert len(rows) == 6 and all("KeyError" in rows[2, m].error for m in ("all", "random"))
    assert rows[1, "all"].accepted and rows[3, "all"].accepted and rows[3, "all"].error is None


def test_equal_choices_are_scored_once(spark, tables):
    base, lake = tables
    scorer = Scorer()
    pool = [TableRef("dull", lake["dull"], ["k"], ["rk"]), TableRef("good", lake["good"], ["k"], ["rk"])]
    wanted = spark.createDataFrame([("good", "tell", True), ("good", "dust", True), ("dull", "one", True)],
                                   "table string, feature string, recommended boolean")
    h = run(base, "y", "k", pool, methods=("all", "recommended"), scorer=scorer, recommendations=wanted)
    rows = {(r["round"], r.method): r for r in h.collect()}
    assert rows[1, "all"].selected_features == rows[1, "recommended"].selected_features == ["tell", "dust"]
    assert all(rows[1, m].accepted for m in ("all", "recommended"))
    assert len(scorer.calls) == 3  # the baseline and one candidate a round
    alone = run(base, "y", "k", pool, methods=("all", "recommended"), scorer=Scorer(), recommendations=wanted, parallel=1)
    assert shown(h) == shown(alone)


@pytest.mark.parametrize("stop_at", [2, 3, 4])
def test_a_stopped_run_goes_on(spark, tables, tmpdir_path, stop_at):
    base, lake = tables
    pool = load_pool(catalog(spark, ["good", "more", "dull"]), open_from(lake, []), policy="score")
    whole = run(base, "y", "k", pool, methods=("all",), scorer=Scorer())
    path = f"{tmpdir_path}/log"
    with pytest.raises(KeyboardInterrupt):
        run(base, "y", "k", pool, methods=("all",), scorer=Scorer(stop_at), history_path=path, parallel=1)
    log = RunLog(spark, path).history()
    assert (log.count() if log is not None else 0) == stop_at - 2
    # rows that no commit names are not seen
    if log is not None:
        log.withColumn("round", F.lit(3)).withColumn("attempt", F.lit("torn")).write.mode("append").parquet(f"{path}/rounds")
    scorer = Scorer()
    got = run(base, "y", "k", pool, methods=("all",), scorer=scorer, history_path=path)
    assert shown(got) == shown(whole)
    assert len(scorer.calls) == (4 if stop_at == 2 else 5 - stop_at)  # neither baseline nor logged rounds anew
    scorer = Scorer()
    assert shown(run(base, "y", "k", pool, methods=("all",), scorer=scorer, history_path=path)) == shown(whole) and scorer.calls == []


def test_report_and_round_files(spark, tables, tmpdir_path):
    base, lake = tables
    pool = load_pool(catalog(spark, ["good", "more", "dull"]), open_from(lake, []), policy="score")
    h = run(base, "y", "k", pool, methods=("all", "random"), scorer=Scorer())
    rep = {r.method: r for r in compare(h).collect()}
    assert rep["all"].feature_history == ["tell", "dust", "half", "third"] and rep["all"].rounds_improved == 2
    assert round_log(h).count() == 3
    write_run(h, f"{tmpdir_path}/run")
    rounds = spark.read.json(f"{tmpdir_path}/run/rounds").orderBy("round").collect()
    assert [(r["round"], r.augment_table, len(r.methods_results)) for r in rounds] == [(1, "good", 2), (2, "more", 2), (3, "dull", 2)]
    assert rounds[0].methods_results[0].method == "all" and rounds[0].methods_results[0].selected_features == ["tell", "dust"]
    final = [json.loads(r.value) for r in spark.read.text(f"{tmpdir_path}/run/final/report").collect()]
    assert {r["method"] for r in final} == {"all", "random"} and "feature_history" in final[0]
    summary = spark.read.option("header", True).csv(f"{tmpdir_path}/run/final/summary")
    assert summary.count() == 2 and "final_score" in summary.columns


def test_tables_by_name(spark):
    got = load_tables(spark, "/root/testdata/sf0.001", ["nation", "region"])
    assert {n: df.count() for n, df in got.items()} == {"nation": 25, "region": 5}
