"""Corpus pipeline: documents to packed training sequences.

``STAGES`` lists the stages in order. Each function takes (spark, docs, sf_dir)
and returns a DataFrame; all but the last return the columns of documents, and
each works on what the one before kept. ``run`` applies them to the documents
of ``sf_dir``, each stage written as Parquet in the folder that
spark.checkpoint.dir names and read again, so that no stage is computed twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from widen.llm.classifier import accept_quality, held_out
from widen.llm.jaccard import jaccard_components
from widen.llm.line_dedup import line_dedup, row_key
from widen.llm.packing import pack_documents, vocabulary_path
from widen.llm.quality_rules import quality_rules
from widen.session import checkpoint_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; it learns from the
    labelled ones among them that are not held out. Null and empty texts have no
    words and are judged as such, repeated rows alike; very long texts are read
    whole; a null id has no label; other columns stay as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return accept_quality(docs, labels, ~held_out())


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every threshold; null, empty and
    short texts do not, repeated rows pass or fail alike, very long texts are
    read whole, other columns stay as they are."""
    return quality_rules(docs).where("kept").select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has. A document that is
    nothing else goes; n_chars is that of the new text."""
    out = line_dedup(docs).where("n_deleted = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of similarity 0.8 or more on five-word
    shingles join: the one with the least id, of several with that id the one
    with the least key of id and text; null ids come first. Rows are linked, not
    ids: rows that share only the id are documents of their own, and of rows that
    share id and text one stays. Texts without a word are in no group and stay."""
    # input columns travel in one struct, so that their names meet no others
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    named = docs.select(whole.alias("x"), F.struct("doc_id", row_key("doc_id", "text").alias("key")).alias("row"), "text")
    rows = jaccard_components(named.select("row", "text"), n=5, num=80, den=100, id_col="row").where("n_shingles > 0")
    marks = (rows.groupBy("row").agg(F.count("*").alias("n"), F.max(F.expr("component_id <> row")).alias("later"))
             .where("n > 1 OR later").checkpoint())
    marked = named.select("x", "row").join(marks, "row", "left").where("NOT coalesce(later, false)")
    out = marked.where("n IS NULL").unionByName(marked.where("n > 1").dropDuplicates(["row"]))
    return out.select("x.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of at most 2048 tokens. Null
    and empty texts are an end id, repeated rows are packed each, long texts are
    cut; columns but id and text are not read."""
    return pack_documents(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("line_dedup", repeated_lines),
    ("jaccard_join", near_duplicates),
    ("best_fit_packing", packing),
]

#: The classifier, the extension of line matches and the packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
