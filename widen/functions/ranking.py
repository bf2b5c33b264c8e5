"""Exact global ranking without a single-task window.

``Window.orderBy`` with no partition puts every row in one task. Here rows are
range-partitioned on the order, numbered inside each partition, and shifted by
the row count of the partitions before them; the only global step runs over a
table with one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def materialised(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder, so later branches
    (per-partition sizes and per-row ranks) read the same partitioning."""
    from widen.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Add ``name``: 1-based position of each row in ``order`` (ties broken by
    the order's later columns; give a unique order for a unique rank).

    Runs one job at call time (the range-partitioned rows are checkpointed so
    the size and rank branches agree)."""
    n = int(partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__o{i}" for i in range(len(order))]
    with_keys = df.select("*", *[o.alias(k) for o, k in zip(order, keys)])
    ranged = materialised(with_keys.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(*keys))
    # rows are read back in the order they were written: the low 33 bits of this
    # number are a row's place in its partition, the bits above the partition
    local = ranged.withColumn("__m", F.monotonically_increasing_id())
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    local = local.withColumn("__p", part).withColumn("__i", place + 1)
    sizes = local.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__off"))
    return (local.join(F.broadcast(offsets), "__p")  # one row per partition: bounded
            .withColumn(name, (F.col("__off") + F.col("__i")).cast("bigint"))
            .drop("__p", "__i", "__m", "__off"))


def exact_medians(df: DataFrame, columns, partitions: int | None = None) -> DataFrame:
    """Exact interpolated median of each numeric column: ``(column, median)``.

    A global ``median()`` keeps every distinct value of a column in one task's
    buffer; here the middle ranks are found by histograms (see
    :mod:`widen.functions.selection`). Columns with no value get a null median.
    Runs jobs at call time; the result has one row per column. ``partitions``
    is kept for its callers: nothing is partitioned anew.
    """
    from widen.functions.selection import medians

    got = medians(df, {c: F.col("`" + c.replace("`", "``") + "`") for c in columns})
    return df.sparkSession.createDataFrame(list(got.items()), "column string, median double")
