"""Column profiles, join-key detection and task-type inference (K1-K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from widen.functions.columns import NUMERIC, STRING, TEMPORAL, native, as_list, classes, col, field_types
from widen.operators.aggregate import long_form

# Fixed values that must equal the reference's:
# name tokens that mark a likely key, and the token that rules a column out.
KEY_TOKENS = ["id", "name", "code", "number", "no", "key"]
EXCLUDE_TOKENS = ["text"]
MIN_UNIQUE_RATIO = 0.4
MIN_UNIQUE_RATIO_NAMED = 0.2
MIN_NOTNULL_RATIO = 0.8
MAX_CLASSES = 10

PROFILE_SCHEMA = ("column string, pos int, dtype string, min decimal(38,4), max decimal(38,4), "
                  "unique_count bigint, cell_examples array<string>")


def _col_stats(df: DataFrame, columns) -> DataFrame:
    """``(column, n_notnull, n_distinct)`` from one long-form aggregation; values
    are told apart by a 128-bit hash, so long texts are not shuffled."""
    lf = long_form(df, columns).filter(F.col("value").isNotNull()).select("column", F.unhex(F.md5("value")).alias("value"))
    per_value = lf.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("column").agg(F.sum("n").cast("bigint").alias("n_notnull"),
                                            F.count(F.lit(1)).alias("n_distinct"))


def profile(df: DataFrame, columns=None, k: int = 3) -> DataFrame:
    """K1: one row per column.

    Numeric (booleans included): dtype, min, max, found in the column's own type
    and shown as decimals (null where an infinity or over 1e34). String and temporal (the
    reference sees dates as text): dtype, distinct count, ``k`` most frequent
    values (ties by value). Numeric columns come from one aggregation; string
    columns from one long-form count that gives distinct counts and top-k
    together.
    """
    types = field_types(df)
    kinds = classes(df)
    columns = as_list(columns) or df.columns
    pos = {c: i for i, c in enumerate(df.columns)}
    nums = [c for c in columns if kinds[c] == NUMERIC]
    texts = [c for c in columns if kinds[c] in (STRING, TEMPORAL)]
    parts = []
    if nums:
        aggs = []
        for i, c in enumerate(nums):
            x = native(c, types[c])
            aggs += [F.min(x).alias(f"__lo{i}"), F.max(x).alias(f"__hi{i}")]
        rows = [F.struct(F.lit(c).alias("column"), F.lit(pos[c]).alias("pos"),
                         F.lit(types[c].simpleString()).alias("dtype"),
                         F.col(f"__lo{i}").try_cast("decimal(38,4)").alias("min"),
                         F.col(f"__hi{i}").try_cast("decimal(38,4)").alias("max"),
                         F.lit(None).cast("bigint").alias("unique_count"),
                         F.lit(None).cast("array<string>").alias("cell_examples"))
                for i, c in enumerate(nums)]
        parts.append(df.agg(*aggs).select(F.inline(F.array(*rows))))
    if texts:
        counts = (long_form(df, texts).filter(F.col("value").isNotNull())
                  .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
        w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
        top = (counts.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k)
               .groupBy("column").agg(F.sort_array(F.collect_list(F.struct("__r", "value"))).alias("__t"))
               .select("column", F.col("__t.value").alias("cell_examples")))
        uniq = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
        meta = df.sparkSession.createDataFrame(
            [(c, pos[c], types[c].simpleString()) for c in texts], "column string, pos int, dtype string")
        parts.append(meta.join(uniq, "column", "left").join(top, "column", "left").select(
            "column", "pos", "dtype", F.lit(None).cast("decimal(38,4)").alias("min"),
            F.lit(None).cast("decimal(38,4)").alias("max"),
            F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count"),
            F.coalesce("cell_examples", F.array().cast("array<string>")).alias("cell_examples")))
    if not parts:
        return df.sparkSession.createDataFrame([], PROFILE_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_incremental(df: DataFrame, known: DataFrame, k: int = 3) -> DataFrame:
    """K2: reuse rows of ``known`` for columns it already has, profile the rest."""
    have = {r["column"] for r in known.select("column").distinct().collect()}  # schema-sized
    todo = [c for c in df.columns if c not in have]
    pos = {c: i for i, c in enumerate(df.columns)}
    kept = known.filter(F.col("column").isin(list(pos)))
    # positions follow the current table
    posmap = F.create_map(*[x for c in pos for x in (F.lit(c), F.lit(pos[c]))])
    kept = kept.withColumn("pos", posmap[F.col("column")])
    if not todo:
        return kept
    return kept.unionByName(profile(df, todo, k))


def describe_table(df: DataFrame, order_by=None, n: int = 3) -> DataFrame:
    """K3: one row with row count, column names, dtypes and ``n`` sample rows as JSON.

    The sample is the first ``n`` rows by ``order_by`` (default: first column)
    so it is deterministic.
    """
    order = as_list(order_by) or [df.columns[0]]
    sample = (df.orderBy(*[col(c) for c in order]).limit(n)
              .select(F.to_json(F.struct(*[col(c) for c in df.columns])).alias("j"),
                      *[col(c).alias(f"__o{i}") for i, c in enumerate(order)]))
    samples = sample.agg(F.sort_array(F.collect_list(F.struct(*[f"__o{i}" for i in range(len(order))], "j")))
                         .alias("s")).select(F.col("s.j").alias("sample_rows"))
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"))
    meta = df.sparkSession.createDataFrame(
        [(len(df.columns), list(df.columns), [t.simpleString() for t in field_types(df).values()])],
        "n_columns bigint, columns array<string>, dtypes array<string>")
    # three one-row frames glued on a constant key
    return (meta.withColumn("__j", F.lit(1))
            .join(F.broadcast(counts.withColumn("__j", F.lit(1))), "__j")
            .join(F.broadcast(samples.withColumn("__j", F.lit(1))), "__j").drop("__j"))


def detect_keys(
    df: DataFrame,
    min_unique: float = MIN_UNIQUE_RATIO,
    min_unique_named: float = MIN_UNIQUE_RATIO_NAMED,
    min_notnull: float = MIN_NOTNULL_RATIO,
    exact: bool = True,
) -> DataFrame:
    """K4/K5: likely join keys.

    ``unique_ratio = distinct / non-null``; a key if (``unique_ratio >=
    min_unique`` or (name holds a key token and ``unique_ratio >=
    min_unique_named``)) and the non-null share is ``>= min_notnull`` and the
    name holds no excluded token. All-null columns are never keys. Tokens
    match as substrings of the lower-cased name (``notes`` holds ``no``).
    """
    columns = df.columns
    pos = {c: i for i, c in enumerate(columns)}
    n_rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    if exact:
        stats = _col_stats(df, columns)
    else:
        one = df.agg(*[F.count(col(c)).alias(f"__n{i}") for i, c in enumerate(columns)],
                     *[F.approx_count_distinct(col(c)).alias(f"__d{i}") for i, c in enumerate(columns)])
        stats = one.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"__n{i}").alias("n_notnull"),
                     F.col(f"__d{i}").alias("n_distinct")) for i, c in enumerate(columns)])))
    names = df.sparkSession.createDataFrame([(c, pos[c]) for c in columns], "column string, pos int")
    low = F.lower(F.col("column"))
    named = None
    for t in KEY_TOKENS:
        e = low.contains(t)
        named = e if named is None else named | e
    excluded = None
    for t in EXCLUDE_TOKENS:
        e = low.contains(t)
        excluded = e if excluded is None else excluded | e
    out = (names.join(stats, "column", "left").withColumn("__j", F.lit(1))
           .join(n_rows.withColumn("__j", F.lit(1)), "__j").drop("__j")
           .select("column", "pos", "n_rows",
                   F.coalesce("n_notnull", F.lit(0)).cast("bigint").alias("n_notnull"),
                   F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct")))
    ur = F.try_divide(F.col("n_distinct").cast("double"), F.col("n_notnull"))
    nr = F.try_divide(F.col("n_notnull").cast("double"), F.col("n_rows"))
    return out.select(
        "column", "pos", "n_rows", "n_notnull", "n_distinct",
        ur.alias("unique_ratio"), nr.alias("notnull_ratio"),
        named.alias("name_hint"), excluded.alias("excluded"),
        ((F.col("n_notnull") > 0) & ((ur >= min_unique) | (named & (ur >= min_unique_named)))
         & (nr >= min_notnull) & ~excluded).alias("is_key"),
    )


def infer_task(df: DataFrame, target: str, max_classes: int = MAX_CLASSES) -> DataFrame:
    """K6: classification if the target is text or has ``<= max_classes`` distinct values."""
    if target not in df.columns:
        raise ValueError(f"target {target!r} not in table")
    dt = field_types(df)[target]
    is_text = classes(df)[target] != NUMERIC
    return df.agg(F.count_distinct(col(target)).alias("n_distinct")).select(
        F.lit(target).alias("target"), F.lit(dt.simpleString()).alias("dtype"),
        F.col("n_distinct").cast("bigint").alias("n_distinct"),
        F.when(F.lit(is_text) | (F.col("n_distinct") <= max_classes), F.lit("classification"))
        .otherwise(F.lit("regression")).alias("task"))


def task_of(df: DataFrame, target: str, max_classes: int = MAX_CLASSES) -> str:
    """The task alone: no job for a text target, and for a number the exact
    distinct count only where a sketch says that it may be near ``max_classes``."""
    if target not in df.columns:
        raise ValueError(f"target {target!r} not in table")
    if classes(df)[target] != NUMERIC:
        return "classification"
    about = df.agg(F.approx_count_distinct(col(target)).alias("n")).first()["n"]
    if about > 10 * max_classes + 100:
        return "regression"
    return infer_task(df, target, max_classes).first()["task"]
