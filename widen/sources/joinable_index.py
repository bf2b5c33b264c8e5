"""Joinable-table search over a stored index.

Each key-like column of each table of the lake has one row in the index: its
number of distinct values, the table's bytes, and a sketch, the ``k`` smallest
64-bit hashes of its distinct values. Hashes are uniform, so the values of two
columns below the smaller of their largest kept hashes are an even sample of
both, and the share of the base column's sample that the other sketch has
estimates the containment. Of columns with at most ``k`` values the sketch has
all, and the containment is known from the sketches alone.

A search joins sketches, one row per column, and keeps the pairs whose
containment may reach the wanted score; only these columns are read, and their
containment is counted exactly on their values. A pair is passed over when

* the other column has too few distinct values: |C| / |B| < score, or
* too many values of the base's sample are missing: 1 - missing / |B| < score, or
* the estimate is below the score by more than its error, which chance exceeds
  with probability ``risk`` (Hoeffding's bound for the size of the sample).

Adding a table appends its rows; nothing else of the index is read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widen.functions.columns import col
from widen.functions.ranking import materialised
from widen.sources.catalog import MIN_SCORE, _distinct_values, _hashed, _key_like, _place, _value_bytes

SKETCH = "dataset_name string, right_column string, n_distinct bigint, size bigint, hashes array<bigint>"
JOINABLE = ("dataset_name", "left_column", "right_column", "n_base_values", "n_shared_values", "score", "size", "join_key")
RISK = 1e-9


def sketch_columns(name: str, df: DataFrame, columns=None, k: int = 1024) -> DataFrame:
    """Index rows of one table, a row per key-like column with a value or
    without. The distinct values are shuffled by hash, once per table; a task
    passes on its ``k`` smallest hashes of a column."""
    columns = _key_like(df, columns)
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in columns], "right_column string")
    size = df.agg(_value_bytes(df).alias("size"))
    values = _distinct_values(df, columns).select(F.col("column").alias("right_column"), F.xxhash64("value").alias("h")) \
        if columns else None
    if values is None:
        return spark.createDataFrame([], SKETCH)
    values = materialised(values.distinct())
    n = values.groupBy("right_column").agg(F.count(F.lit(1)).alias("n_distinct"))
    least = (values.withColumn("r", F.expr("row_number() OVER (PARTITION BY right_column ORDER BY h)")).filter(F.col("r") <= k)
             .groupBy("right_column").agg(F.sort_array(F.collect_list("h")).alias("hashes")))  # k a column
    out = names.join(n, "right_column", "left").join(least, "right_column", "left").join(F.broadcast(size))
    return out.select(F.lit(name).alias("dataset_name"), "right_column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
                      "size", F.coalesce("hashes", F.array().cast("array<bigint>")).alias("hashes"))


def add_to_index(path: str, name: str, df: DataFrame, k: int = 1024) -> None:
    """Appends a table's sketches to the index stored at ``path`` (Parquet)."""
    sketch_columns(name, df, k=k).coalesce(1).write.mode("append").parquet(path)  # a row a column


def sketch_candidates(base: DataFrame, index: DataFrame, base_columns=None, min_score: float = MIN_SCORE, k: int = 1024,
                      risk: float = RISK) -> DataFrame:
    """Pairs of a base column and an index column that may reach the score:
    ``(dataset_name, right_column, left_column, n_base_values, size, estimate,
    exact_shared)``; the last is null where values must be counted.

    The base table's sketches are schema-sized and go with the plan; the index
    is read once, a row per column of the lake.
    """
    own = sketch_columns("", base, base_columns, k).filter("n_distinct > 0").collect()  # a row a base column
    if not own:
        return index.sparkSession.createDataFrame(
            [], "dataset_name string, right_column string, left_column string, n_base_values bigint, size bigint, "
                "estimate double, exact_shared bigint")
    lefts = F.array(*[F.struct(F.lit(r.right_column).alias("left_column"), F.lit(r.n_distinct).alias("nb"),
                               F.array(*[F.lit(h) for h in r.hashes]).cast("array<bigint>").alias("hb")) for r in own])
    x = index.select("dataset_name", "right_column", "n_distinct", "size", "hashes", F.inline(lefts))
    whole_b, whole_c = F.size("hb") == F.col("nb"), F.size("hashes") == F.col("n_distinct")
    most = F.lit(2**63 - 1)
    # hashes up to this one are known of both columns
    limit = F.least(F.when(whole_b, most).otherwise(F.element_at("hb", -1)),
                    F.when(whole_c, most).otherwise(F.element_at("hashes", -1)))
    x = x.withColumn("limit", limit)
    x = x.withColumn("sample", F.expr("size(filter(hb, h -> h <= limit))")).withColumn(
        "shared", F.size(F.array_intersect("hb", "hashes")))  # what both keep is below both largest
    estimate = F.col("shared") / F.greatest(F.col("sample"), F.lit(1))
    exact = F.when(whole_b & whole_c, F.col("shared").cast("bigint"))
    error = F.sqrt(F.lit(math.log(1 / risk) / 2) / F.greatest(F.col("sample"), F.lit(1)))
    fair = F.when(exact.isNotNull(), estimate >= F.lit(min_score)).otherwise(
        (F.col("n_distinct") / F.col("nb") >= min_score)
        & (1 - (F.col("sample") - F.col("shared")) / F.col("nb") >= min_score)
        & (estimate + error >= min_score))
    return x.filter(fair & (F.col("n_distinct") > 0)).select(
        "dataset_name", "right_column", "left_column", F.col("nb").alias("n_base_values"), "size",
        estimate.alias("estimate"), exact.alias("exact_shared"))


def find_joinable_indexed(base: DataFrame, index: DataFrame, open_table: Callable[[str], DataFrame], base_columns=None,
                          min_score: float = MIN_SCORE, k: int = 1024, risk: float = RISK) -> DataFrame:
    """The rows of ``find_joinable`` over the tables of an index.

    ``open_table`` gives a table by name; it is asked only for tables with a
    column that the sketches let through and cannot count, and only these columns
    are read. Names of surviving columns reach the driver, as the plan of the
    exact count is made of them.
    """
    pairs = materialised(sketch_candidates(base, index, base_columns, min_score, k, risk))
    known = pairs.filter("exact_shared IS NOT NULL").select(
        "dataset_name", "left_column", "right_column", "n_base_values", F.col("exact_shared").alias("n_shared_values"), "size")
    open_ = pairs.filter("exact_shared IS NULL")
    by_table: dict[str, set] = {}
    lefts: set = set()
    for r in open_.select("dataset_name", "right_column", "left_column").collect():
        by_table.setdefault(r.dataset_name, set()).add(r.right_column)
        lefts.add(r.left_column)
    out = known
    if by_table:
        left = _hashed(_distinct_values(base, sorted(lefts))).select(F.col("column").alias("left_column"), "value")
        right = None
        for name, columns in sorted(by_table.items()):
            df = open_table(name)
            r = _hashed(_distinct_values(df.select(*[col(c) for c in sorted(columns)]), sorted(columns), name)).select(
                F.col("table").alias("dataset_name"), F.col("column").alias("right_column"), "value")
            right = r if right is None else right.unionByName(r)
        shared = (left.join(right, "value").groupBy("left_column", "dataset_name", "right_column")
                  .agg(F.count(F.lit(1)).alias("n_shared_values")))
        counted = open_.drop("exact_shared").join(shared, ["left_column", "dataset_name", "right_column"])
        out = known.unionByName(counted.select(*known.columns))
    score = F.try_divide(F.col("n_shared_values").cast("double"), F.col("n_base_values"))
    return out.select("dataset_name", "left_column", "right_column", "n_base_values", "n_shared_values",
                      score.alias("score"), "size", _place(base, F.col("left_column")).alias("join_key")).filter(
        F.col("score") >= min_score)
