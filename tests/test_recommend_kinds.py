"""Requests of every kind, sample rows, and the summaries of description replies."""

import pytest

from widen.operators.profile import profile
from widen.operators.recommend import ASKS, ingest_descriptions, ingest_summaries, prompt_frame, prompt_kinds, sample_lines
from pyspark.sql import functions as F


def profiles(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, y string")
    b = spark.createDataFrame([(1, 2.5)], "rk int, v double")
    return profile(a).withColumn("table", F.lit("base")).unionByName(profile(b).withColumn("table", F.lit("aug")))


def test_kinds_differ_in_what_they_ask(spark):
    p = profiles(spark)
    got = {r.kind: r.prompt for r in prompt_kinds(p, "base", "y", "classification").collect()}
    assert set(got) == set(ASKS) - {"samples"}  # there are no samples
    assert all(got[k].endswith(ASKS[k]) and "Candidate table aug:\nrk (int)" in got[k] for k in got)
    assert got["features"] == prompt_frame(p, "base", "y", "classification").first().prompt
    with pytest.raises(ValueError):
        prompt_kinds(p, "base", "y", "classification", kinds=("poem",))


def test_descriptions_and_samples(spark):
    described = spark.createDataFrame([("aug", "what it is")], "table string, description string")
    samples = spark.createDataFrame([("base", "k=1; y=x"), ("aug", "rk=1; v=2.5")], "table string, sample string")
    got = {r.kind: r.prompt for r in prompt_kinds(profiles(spark), "base", "y", "regression", ("samples", "score"), described, samples).collect()}
    assert "Candidate table aug:\nName: aug\nDescription: what it is\nrk (int)" in got["score"] and "Name: base" not in got["score"]
    assert "k=1; y=x\nCandidate table aug:\nName: aug\nDescription: what it is\nrk=1; v=2.5\n" in got["samples"]


def test_sample_lines_are_ordered(spark):
    df = spark.createDataFrame([(2, None), (1, "b"), (3, "c"), (1, "a")], "k int, `a.b` string").repartition(3)
    assert sample_lines(df, "k", 3).first().sample == "k=1; a.b=a\nk=1; a.b=b\nk=2; a.b="
    assert sample_lines(df.filter("false"), "k").first().sample == ""


def test_summaries(spark):
    replies = [("t", "Columns\nage: (int) - years\n数据规模: small\nname: (text) - who\nmore\n主要包含 people"), ("none", "a: (int) - b"),
               ("at_end", "x\n主要包含"), ("null", None)]
    df = spark.createDataFrame(replies, "table string, reply string")
    assert {r.table: r.summary for r in ingest_summaries(df).collect()} == {
        "t": "数据规模: small\nmore\n主要包含 people\n", "at_end": "主要包含\n"}
    assert ingest_descriptions(df).count() == 3
