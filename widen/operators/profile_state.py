"""Mergeable column profiles (A4, A5, A6, A7, K2): states of which two make one.

A state is a row per column: counts, least and greatest value, sums, a sketch of
the distinct values (HyperLogLog) and one of the frequent values. Two states of
different rows of a table merge into the state of all of them, so a profile that
is stored with its state is brought up to date by the new rows alone; the old
rows are never read again. One aggregation makes the state of all columns, with
buffers of bounded size that the tasks fill before the shuffle.

Errors: numbers of rows and nulls, least, greatest and mean are exact. The
number of distinct values errs by about 1.04 / sqrt(2 ** LG_K), 1.6 percent, and
hardly at all below a few hundred. A frequent value's count is exact while a
column has at most ``TRACKED`` distinct values; beyond, counts are short by at
most about rows / (0.75 * TRACKED), and values that are rarer may be missing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widen.functions.columns import NUMERIC, OTHER, as_list, classes, col, defined, field_types, native

#: Size of the sketch of distinct values, in powers of two.
LG_K = 12
#: Frequent values that a sketch tracks.
TRACKED = 10_000


def profile_state(df: DataFrame, columns=None, tracked: int = TRACKED) -> DataFrame:
    """State of a table's rows: ``(column, dtype, n_rows, n_missing, min, max,
    total, distinct, frequent)``, a row per column that is a number, a text or a
    time. NaN counts as missing; values are compared as text, as in the profile."""
    types, kinds = field_types(df), classes(df)
    columns = [c for c in (as_list(columns) or df.columns) if kinds[c] != OTHER]
    src, aggs, rows = [], [F.count(F.lit(1)).alias("rows")], []
    for i, c in enumerate(columns):
        there = defined(c, types[c])
        src.append(F.when(there, col(c).cast("string")).alias(f"v{i}"))
        number = native(c, types[c]) if kinds[c] == NUMERIC else F.lit(None).cast("double")
        src.append(number.alias(f"x{i}"))
        aggs += [F.count(f"v{i}").alias(f"n{i}"),
                 F.min(f"x{i}").try_cast("decimal(38,4)").alias(f"lo{i}"), F.max(f"x{i}").try_cast("decimal(38,4)").alias(f"hi{i}"),
                 F.sum(F.col(f"x{i}").cast("double")).alias(f"t{i}"),
                 F.expr(f"hll_sketch_agg(v{i}, {LG_K})").alias(f"d{i}"),
                 F.expr(f"approx_top_k_accumulate(v{i}, {int(tracked)}) FILTER (WHERE v{i} IS NOT NULL)").alias(f"f{i}")]
        rows.append(F.struct(
            F.lit(c).alias("column"), F.lit(types[c].simpleString()).alias("dtype"), F.col("rows").alias("n_rows"),
            (F.col("rows") - F.col(f"n{i}")).alias("n_missing"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
            F.col(f"t{i}").alias("total"), F.col(f"d{i}").alias("distinct"), F.col(f"f{i}").alias("frequent")))
    if not rows:
        raise ValueError("no column can be profiled")
    return df.select(*src).agg(*aggs).select(F.inline(F.array(*rows)))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of the rows of all of them together. A column that some of them
    lack was not there: its rows count as missing there, as after a union by name."""
    both = None
    for i, s in enumerate(states):
        own = s.withColumn("part", F.lit(str(i)))
        both = own if both is None else both.unionByName(own)
    return _merged(both)


def _merged(parts: DataFrame) -> DataFrame:
    """States told apart by ``part`` made one."""
    # every column of a part has the same number of rows
    total = (parts.groupBy("part").agg(F.max("n_rows").alias("n")).agg(F.sum("n").alias("everything"))
             .withColumn("one", F.lit(1)))  # one row
    out = parts.groupBy("column").agg(
        F.max_by("dtype", "n_rows").alias("dtype"), F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.sum("total").alias("total"),
        F.hll_union_agg("distinct").alias("distinct"), F.expr("approx_top_k_combine(frequent)").alias("frequent"))
    return out.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select(
        "column", "dtype", F.col("everything").alias("n_rows"),
        (F.col("n_missing") + F.col("everything") - F.col("n_rows")).alias("n_missing"), "min", "max", "total", "distinct",
        "frequent")


def state_profile(state: DataFrame, k: int = 3) -> DataFrame:
    """``(column, dtype, n_rows, n_missing, missing_ratio, min, max, mean,
    unique_count, cell_examples)`` of a state; examples are the ``k`` most
    frequent values with their counts, ties by value."""
    # a few more than wanted, as the estimate leaves the order of ties open
    many = F.expr(f"approx_top_k_estimate(frequent, {int(k) + 100})")
    best = F.slice(F.array_sort(F.transform(many, lambda r: F.struct((-r["count"]).alias("n"), r["item"].alias("value")))), 1, k)
    there = F.col("n_rows") - F.col("n_missing")
    return state.select(
        "column", "dtype", "n_rows", "n_missing",
        F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows")).alias("missing_ratio"), "min", "max",
        F.try_divide(F.col("total"), there).alias("mean"), F.hll_sketch_estimate("distinct").alias("unique_count"),
        F.when(there > 0, F.transform(best, lambda r: F.struct(r["value"].alias("value"), (-r["n"]).alias("n"))))
        .otherwise(F.array().cast("array<struct<value:string,n:bigint>>")).alias("cell_examples"))


def write_state(state: DataFrame, path: str) -> None:
    """Appends a state; appends are told apart by a name of their own."""
    state.withColumn("part", F.lit(uuid.uuid4().hex)).coalesce(1).write.mode("append").parquet(path)  # a row a column


def stored_state(spark, path: str) -> DataFrame:
    """The merged state of all that was appended at ``path``: a row per column
    and append is read, no row of a table."""
    return _merged(spark.read.parquet(path))
