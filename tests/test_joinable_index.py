"""Search over stored sketches: the rows of the exact search, recall, which
tables are read, appended tables, edge columns."""

import random

import pytest
from pyspark.sql import functions as F

from widen.sources.catalog import find_joinable
from widen.sources.joinable_index import add_to_index, find_joinable_indexed, sketch_candidates, sketch_columns


@pytest.fixture(scope="module")
def lake(spark):
    random.seed(8)
    keys = [f"k{i}" for i in range(3000)]
    base = spark.createDataFrame([(k, i % 7) for i, k in enumerate(keys)], "key string, small int")
    tables = {}
    for n, share in enumerate([0.0, 0.2, 0.45, 0.5, 0.55, 0.8, 1.0]):
        own = random.sample(keys, int(share * len(keys))) + [f"x{n}-{i}" for i in range(random.choice([10, 5000]))]
        tables[f"t{n}"] = spark.createDataFrame([(v, j % 5) for j, v in enumerate(own)], "id string, part int")
    tables["tiny"] = spark.createDataFrame([("k1", 1), ("k2", None)], "id string, part int")
    tables["empty"] = tables["tiny"].filter("false")
    tables["none"] = spark.createDataFrame([(1.5,)], "x double")  # no key-like column
    return base, tables


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("k", [16, 256, 8192])
def test_equals_the_exact_search(lake, spark, k, tmpdir_path):
    base, tables = lake
    path = f"{tmpdir_path}/index"
    for name, df in tables.items():
        add_to_index(path, name, df, k)
    asked = []

    def open_table(name):
        asked.append(name)
        return tables[name]

    got = find_joinable_indexed(base, spark.read.parquet(path), open_table, k=k)
    assert rows(got) == rows(find_joinable(base, {n: t for n, t in tables.items() if n != "none"}))
    assert not {"empty", "none"} & set(asked)
    if k == 256:  # far from the score: passed over by the sketches alone
        assert "t0" not in asked and "tiny" not in asked
    if k == 8192:  # every sketch is whole
        assert asked == []


def test_recall_and_bounds(lake, spark):
    base, tables = lake
    index = None
    for name, df in tables.items():
        s = sketch_columns(name, df, k=256)
        index = s if index is None else index.unionByName(s)
    true = {(r.dataset_name, r.left_column, r.right_column): r.score for r in find_joinable(
        base, {n: t for n, t in tables.items() if n != "none"}, min_score=0.0).collect()}
    for score in (0.3, 0.5, 0.75):
        kept = {(r.dataset_name, r.left_column, r.right_column): r for r in
                sketch_candidates(base, index, min_score=score, k=256).collect()}
        assert {p for p, s in true.items() if s >= score} <= set(kept)  # recall 1.0
        assert all(abs(r.estimate - true.get(p, 0.0)) < 0.35 for p, r in kept.items())


def test_sketch_rows(spark):
    df = spark.createDataFrame([(i % 100, "v", None) for i in range(1000)], "a int, b string, c string").withColumn("d", F.lit(0.5))
    got = {r.right_column: r for r in sketch_columns("t", df, k=30).collect()}
    assert {c: (r.n_distinct, len(r.hashes)) for c, r in got.items()} == {"a": (100, 30), "b": (1, 1), "c": (0, 0)}
    assert all(r.hashes == sorted(set(r.hashes)) and r.size == got["a"].size for r in got.values())
    assert find_joinable_indexed(df.filter("false"), sketch_columns("t", df), lambda n: df).count() == 0


def test_adding_appends_only(lake, spark, tmpdir_path):
    base, tables = lake
    path = f"{tmpdir_path}/grown"
    add_to_index(path, "t1", tables["t1"])
    before = {f for f in spark.read.parquet(path).inputFiles()}
    add_to_index(path, "t6", tables["t6"])
    assert before < set(spark.read.parquet(path).inputFiles())
    got = find_joinable_indexed(base, spark.read.parquet(path), tables.get)
    assert ("t6", "key", "id") in {(r.dataset_name, r.left_column, r.right_column) for r in got.collect()}
