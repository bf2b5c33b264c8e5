"""Group summaries and column statistics (A2-A10).

Per-column statistics over many columns use a long form
``(column, value)`` so exact distinct counts and top-k come from one
aggregation instead of one expansion per distinct aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widen.functions.ranking import exact_medians
from widen.functions.columns import (
    native,
    NUMERIC,
    as_double,
    as_list,
    classes,
    col,
    field_types,
    type_class,
)


def long_form(df: DataFrame, columns, keys=(), value_name: str = "value") -> DataFrame:
    """``(keys..., column, value-as-string)``; one row per input row and column."""
    keys = as_list(keys)
    rows = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias(value_name)) for c in columns]
    return df.select(*[col(k) for k in keys], F.inline(F.array(*rows)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A3: frequency of each non-null value, most frequent first (ties by value)."""
    return (df.filter(col(column).isNotNull()).groupBy(col(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("value")))


def value_counts_long(df: DataFrame, columns) -> DataFrame:
    """``(column, value, n)`` for every listed column, nulls left out."""
    return (long_form(df, columns).filter(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def top_values(df: DataFrame, columns, k: int = 3) -> DataFrame:
    """A4: the ``k`` most frequent non-null values per column: ``(column, rank, value, n)``.

    ``row_number() <= k`` lets Spark put a per-task group limit before the
    shuffle, so a column with many distinct values sends at most ``k`` rows
    per task to the ranking step.
    """
    counts = value_counts_long(df, as_list(columns))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("column", F.col("rank").cast("bigint").alias("rank"), "value", "n"))


def mode_per_group(df: DataFrame, keys, columns) -> DataFrame:
    """Most frequent non-null value per group and column, smallest on ties.

    Two aggregations: ``(keys, column, value)`` counts spread a hot group over
    all tasks by value; the second keeps one ``min_by`` buffer per group.
    """
    keys = as_list(keys)
    columns = as_list(columns)
    types = field_types(df)
    counts = (long_form(df, columns, keys).filter(F.col("value").isNotNull())
              .groupBy(*[col(k) for k in keys], "column", "value").agg(F.count(F.lit(1)).alias("n")))
    out = []
    for c in columns:
        m = F.min_by("value", F.when(F.col("column") == c, F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))))
        if type_class(types[c]) != "string":
            m = m.cast(types[c])
        out.append(m.alias(c))
    return counts.groupBy(*[col(k) for k in keys]).agg(*out)


def group_summary(df: DataFrame, by, mean=(), mode=()) -> DataFrame:
    """A2: per group row count, mean of ``mean`` columns, mode of ``mode`` columns."""
    by = as_list(by)
    types = field_types(df)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(as_double(c, types[c])).alias(f"mean_{c}") for c in mean]
    out = df.groupBy(*[col(b) for b in by]).agg(*aggs)
    if mode:
        modes = mode_per_group(df, by, mode).select(*[col(b) for b in by],
                                                     *[col(c).alias(f"mode_{c}") for c in mode])
        out = out.join(modes, on=by, how="left")
    return out


def null_profile(df: DataFrame, columns=None) -> DataFrame:
    """``(column, n_rows, n_null, null_ratio, n_notnull)`` from one aggregation."""
    columns = as_list(columns) or df.columns
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(columns):
        aggs.append(F.count_if(col(c).isNull()).alias(f"__n{i}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"__n{i}").alias("n_null")) for i, c in enumerate(columns)]
    return one.select(F.col("__rows").alias("n_rows"), F.inline(F.array(*rows))).select(
        "column", "n_rows", "n_null",
        F.try_divide(F.col("n_null").cast("double"), F.col("n_rows")).alias("null_ratio"),
        (F.col("n_rows") - F.col("n_null")).alias("n_notnull"),
    )


def distinct_counts(df: DataFrame, columns=None, exact: bool = True) -> DataFrame:
    """A5: non-null distinct values per column, ``(column, n_distinct)``.

    Exact mode counts distinct ``(column, value)`` pairs in one long-form
    aggregation (no per-column expansion); ``exact=False`` uses HLL sketches in
    a single pass.
    """
    columns = as_list(columns) or df.columns
    if not exact:
        one = df.agg(*[F.approx_count_distinct(col(c)).alias(f"__d{i}") for i, c in enumerate(columns)])
        rows = [F.struct(F.lit(c).alias("column"), F.col(f"__d{i}").alias("n_distinct")) for i, c in enumerate(columns)]
        return one.select(F.inline(F.array(*rows)))
    pairs = long_form(df, columns).filter(F.col("value").isNotNull()).distinct()
    counted = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(counted, "column", "left").select(
        "column", F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"))


def min_max(df: DataFrame, columns=None) -> DataFrame:
    """``(column, min, max, min_int, max_int)`` of numeric columns, one
    aggregation in each column's own type. min and max are doubles; integral
    columns have them exactly in min_int and max_int too (null for others)."""
    types = field_types(df)
    columns = as_list(columns) or [c for c, k in classes(df).items() if k == NUMERIC]
    aggs = []
    for i, c in enumerate(columns):
        x = native(c, types[c])
        aggs += [F.min(x).alias(f"__lo{i}"), F.max(x).alias(f"__hi{i}")]
    one = df.agg(*aggs)

    def whole(c, i, side):
        x = F.col(f"__{side}{i}") if isinstance(types[c], (T.IntegralType, T.BooleanType)) else F.lit(None)
        return x.cast("bigint")

    rows = [F.struct(F.lit(c).alias("column"), F.col(f"__lo{i}").cast("double").alias("min"),
                     F.col(f"__hi{i}").cast("double").alias("max"), whole(c, i, "lo").alias("min_int"),
                     whole(c, i, "hi").alias("max_int")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*rows)))


def medians(df: DataFrame, columns=None, exact: bool = True) -> DataFrame:
    """Interpolated median per numeric column (nulls ignored): ``(column, median)``.

    Exact mode closes in on the middle ranks by histograms (no column is sorted
    or gathered into one task); ``exact=False`` uses ``percentile_approx`` in one pass
    (not interpolated, bounded memory).
    """
    types = field_types(df)
    columns = as_list(columns) or [c for c, k in classes(df).items() if k == NUMERIC]
    if exact:
        return exact_medians(df.select(*[as_double(c, types[c]).alias(c) for c in columns]), columns)
    one = df.agg(*[F.percentile_approx(as_double(c, types[c]), 0.5).cast("double").alias(f"__m{i}")
                   for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"__m{i}").alias("median")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*rows)))


def describe_strings(df: DataFrame, columns=None) -> DataFrame:
    """``(column, count, unique, top, freq)`` for string columns."""
    columns = as_list(columns) or [c for c, k in classes(df).items() if k == "string"]
    counts = value_counts_long(df, columns)
    per = counts.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("top"),
        F.max("n").alias("freq"),
    )
    return per.select("column", F.col("count").cast("bigint").alias("count"),
                      F.col("unique").cast("bigint").alias("unique"), "top",
                      F.col("freq").cast("bigint").alias("freq"))


def shape(df: DataFrame) -> DataFrame:
    """A10: ``(n_rows, n_columns)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))
