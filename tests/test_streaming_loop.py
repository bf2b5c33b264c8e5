"""Streaming augmentation, reply ingestion, catalog frames, loop reports."""

import json
import os

from pyspark.sql import functions as F

from tests.conftest import SF
from widen.operators.join import augment
from widen.operators.recommend import ingest_descriptions, ingest_replies, ingest_verdicts
from widen.plans.loop import accept_history, best, compare, method_status
from widen.sources.catalog import admit, clean_key_names, dedup_catalog, ingest_search_results, merge_catalog, pending
from widen.sources.tables import read_table, write_table


def test_stream_static_augment_equals_batch(spark, tmpdir_path):
    from widen.streaming import augment_stream

    cust = spark.read.parquet(f"{SF}/customer.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    src = os.path.join(tmpdir_path, "in")
    cust.write.parquet(src)
    stream = spark.readStream.schema(cust.schema).parquet(src)
    out = augment_stream(stream, orders, ["o_totalprice", "o_orderpriority"], "c_custkey", "o_custkey")
    q = out.writeStream.format("memory").queryName("widen_stream_test").outputMode("append") \
        .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM widen_stream_test")
    batch = augment(cust, orders, ["o_totalprice", "o_orderpriority"], left_keys="c_custkey", right_keys="o_custkey")
    assert got.count() == cust.count()
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_reply_ingestion(spark):
    good = json.dumps({"feature_scores": {"a": 0.9, "b": 0.1}, "feature_ranking": ["a", "b"],
                       "recommended_features": ["a", "ghost"]})
    replies = spark.createDataFrame([
        ("t1", "Sure:\n```json\n" + good + "\n```\nbye"),
        ("t2", good),
        ("t3", "{not json"),
        ("t4", json.dumps({"feature_scores": {"a": 1.0}})),  # no recommendation list
        ("t5", json.dumps({"recommended_features": []})),
    ], "table string, reply string")
    rows, rejects = ingest_replies(replies)
    got = {(r["table"], r["feature"]): (r["score"], r["rank"], r["recommended"]) for r in rows.collect()}
    assert got[("t1", "a")] == (0.9, 1, True) and got[("t2", "ghost")] == (None, None, True)
    assert got[("t1", "b")] == (0.1, 2, False)
    assert {r["table"] for r in rejects.collect()} == {"t3", "t4"}
    assert not any(t == "t5" for t, _ in got)


def test_verdicts_and_descriptions(spark):
    texts = spark.createDataFrame([
        ("y", "Table Analysis: good\nConclusion: yes"),
        ("n", "Conclusion: NO"),
        ("m", "Conclusion: maybe"),
        ("x", "nothing here"),
        ("two", "Conclusion: No\nmore\n  Conclusion:\tYES  "),
    ], "table string, reply string")
    got = {r["table"]: (r["analysis"], r["conclusion"]) for r in ingest_verdicts(texts).collect()}
    assert got == {"y": ("good", "Yes"), "n": (None, "No"), "m": (None, "No"), "x": (None, "No"),
                   "two": (None, "Yes")}
    d = spark.createDataFrame([("t", "Columns:\nage: (int) - years\nno paren: here\nSummary: x")],
                              "table string, reply string")
    rows = ingest_descriptions(d).collect()
    assert [(r["line_no"], r["column"], r["description"]) for r in rows] == [(1, "age", "(int) - years")]


def test_catalog_frames(spark):
    doc = {"results": [
        {"id": "1", "score": 0.9, "metadata": {"name": "a b/c", "size": 30000},
         "augmentation": {"type": "join", "left_columns_names": [["k"]], "right_columns_names": [["rk"]]}},
        {"id": "2", "score": 0.4, "metadata": {"name": "d", "size": 30000, "description": "desc"},
         "augmentation": {"type": "union", "left_columns_names": [["k"]], "right_columns_names": [["k"]]}},
        {"id": "3", "score": 0.7, "metadata": {"name": "e", "size": 10, "description": "small"},
         "augmentation": {"type": "join", "left_columns_names": [["k1", "k2"]], "right_columns_names": [["r1", "r2"]]}},
    ]}
    cat = ingest_search_results(spark.createDataFrame([(json.dumps(doc),)], "json string"))
    rows = {r["id"]: r for r in cat.collect()}
    assert set(rows) == {"1", "3"} and rows["1"]["dataset_name"] == "a_b_c" and rows["1"]["description"] == "N/A"
    clean = {r["id"]: r for r in clean_key_names(cat).collect()}
    assert clean["3"]["left_columns_names"] == "k1, k2" and clean["3"]["left_keys"] == ["k1", "k2"]
    assert [r["id"] for r in admit(cat).collect()] == ["1"]
    newer = cat.withColumn("score", F.lit(0.99))
    merged = {r["id"]: r["score"] for r in merge_catalog(cat, newer).collect()}
    assert merged == {"1": 0.9, "3": 0.7}
    dup = dedup_catalog(cat.unionByName(newer))
    assert {r["id"]: r["score"] for r in dup.collect()} == {"1": 0.99, "3": 0.99}
    present = spark.createDataFrame([("e",)], "dataset_name string")
    assert [r["id"] for r in pending(cat, present).collect()] == ["1"]


def test_ragged_csv(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "reg.csv")
    with open(p, "w") as f:
        f.write("base_table_name,target_attribute,description\naqe,PM,air,\nschools,GRADE,grades\n")
    keep = read_table(spark, p, bad_rows="keep")
    assert keep.count() == 2
    drop = read_table(spark, p, bad_rows="drop")
    assert [r["base_table_name"] for r in drop.collect()] == ["schools"]
    out = os.path.join(tmpdir_path, "out")
    write_table(keep, out, "parquet")
    assert spark.read.parquet(out).count() == 2


def _history(spark):
    rows = [(1, "all", 0.6, 2, True), (2, "all", 0.55, 3, False), (3, "all", 0.7, 4, True),
            (1, "random", 0.4, 1, False), (2, "random", 0.52, 2, True), (3, "random", 0.52, 2, False)]
    df = spark.createDataFrame(rows, "round int, method string, score double, num_joined int, accepted boolean")
    cur = {"all": [2, 2, 6], "random": [0, 2, 2]}
    df = df.withColumn("current_features_num", F.when(F.col("method") == "all", F.element_at(
        F.array(*[F.lit(x) for x in cur["all"]]), F.col("round"))).otherwise(F.element_at(
        F.array(*[F.lit(x) for x in cur["random"]]), F.col("round"))))
    return (df.withColumn("initial_score", F.lit(0.5)).withColumn("higher_is_better", F.lit(True))
            .withColumn("improvement", F.lit(0.0)))


def test_loop_reports(spark):
    h = _history(spark)
    acc = {(r["method"], r["round"]): r["accepted"]
           for r in accept_history(h.drop("accepted", "improvement"), 0.5).collect()}
    assert acc == {(m, r): a for r, m, a in [(1, "all", True), (2, "all", False), (3, "all", True),
                                             (1, "random", False), (2, "random", True), (3, "random", False)]}
    st = {r["method"]: (r["score"], r["n_features"]) for r in method_status(h).collect()}
    assert st == {"all": (0.7, 6), "random": (0.52, 2)}
    rep = compare(h).collect()
    assert [r["method"] for r in rep] == ["all", "random"]
    assert rep[0]["final_score"] == 0.7 and abs(rep[0]["total_improvement"] - 0.2) < 1e-12
    assert rep[0]["features_added"] == 6 and rep[0]["rounds_improved"] == 2
    assert best(compare(h)).first()["method"] == "all"
