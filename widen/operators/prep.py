"""Feature preparation (E1-E12): imputation, codes, coercion, split, balancing."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widen.functions.columns import (
    NUMERIC,
    STRING,
    as_double,
    as_list,
    classes,
    col,
    field_types,
    hash_bucket,
    hash_order,
)
from widen.functions.ranking import global_rank, materialised
from widen.functions.selection import medians, smallest_by_hash

# Fixed values that must equal the reference's.
MISSING_TOKEN = "MISSING"
LOW_VARIANCE = 0.1

#: Codes of texts of up to so many different values in all, none of more bytes,
#: may be written into the plan instead of being joined.
LISTED, LISTED_BYTES = 256, 256
#: Frames of fewer rows are laid out by the joins with their codes: bootstrap
#: samples of models follow the places of the rows.
FEW = 10_000


def column_medians(df: DataFrame, columns) -> dict[str, float | None]:
    """Exact interpolated medians of numeric columns, by histograms that close
    in on the middle ranks; the cells of a pass come back to the driver."""
    columns = as_list(columns)
    if not columns:
        return {}
    types = field_types(df)
    # every pass scans its input; keep the projected columns for the length of
    # this one eager call
    src = df.select(*[as_double(c, types[c]).alias(c) for c in columns]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return medians(src, {c: col(c) for c in columns})
    finally:
        src.unpersist()


def impute_median(df: DataFrame, columns=None, exclude=()) -> DataFrame:
    """Numeric null -> column median; a column with no value at all -> 0."""
    kinds = classes(df)
    columns = [c for c in (df.columns if columns is None else as_list(columns)) if kinds[c] == NUMERIC and c not in exclude]
    med = column_medians(df, columns)
    types = field_types(df)
    repl = {c: F.coalesce(as_double(c, types[c]), F.lit(0.0 if med[c] is None else float(med[c]))).alias(c)
            for c in columns}
    return df.select(*[repl.get(c, col(c)) for c in df.columns])


def impute_constant(df: DataFrame, number: float = 0, token: str = MISSING_TOKEN, exclude=()) -> DataFrame:
    """Numeric null -> ``number``; string null -> ``token``."""
    kinds = classes(df)
    out = []
    for c in df.columns:
        if c in exclude:
            out.append(col(c))
        elif kinds[c] == NUMERIC:
            out.append(F.coalesce(col(c), F.lit(number).cast(df.schema[c].dataType)).alias(c))
        elif kinds[c] == STRING:
            out.append(F.coalesce(col(c), F.lit(token)).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def category_codes(df: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    """Sorted distinct non-null values of ``column`` with codes ``0..n-1``: ``(value, code)``.

    Exact and distributed: distinct values are range-partitioned, numbered
    inside each partition, and shifted by the running count of the partitions
    before them (a table with one row per partition). No single task sees all
    values.
    """
    vals = df.select(col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    ranked = global_rank(vals, [F.col("value")], "code", partitions)
    return ranked.select("value", (F.col("code") - 1).alias("code"))


def _listed_codes(pairs: DataFrame) -> dict[int, list] | None:
    """Sorted values, as bytes, of each column of ``(c, value)`` pairs; None if
    there are more than ``LISTED`` of them or one is long."""
    raw = F.when(F.octet_length("value") <= LISTED_BYTES, F.col("value").cast("binary"))
    rows = pairs.select("c", raw.alias("value")).limit(LISTED + 1).collect()
    if len(rows) > LISTED or any(r["value"] is None for r in rows):
        return None
    out: dict[int, list] = {}
    for c, value in sorted((r["c"], bytes(r["value"])) for r in rows):  # texts are ordered by their bytes
        out.setdefault(c, []).append(value)
    return out


def encode(df: DataFrame, columns=None, null_code: int = -1, exclude=(), listed: bool = False) -> DataFrame:
    """Replace each listed column (default: string columns) by its category code.

    Codes follow the sorted distinct values (as text); nulls get ``null_code``.
    The values of all columns are found in one pass, however many columns there
    are; the code table is joined back with Spark choosing the strategy from its
    measured size (broadcast when small). With ``listed`` the codes of a few short
    values are looked up in a list instead, which takes one job for all columns
    and leaves every row where it is.
    """
    kinds = classes(df)
    columns = [c for c in ([c for c in df.columns if kinds[c] == STRING] if columns is None else as_list(columns))
               if c not in exclude]
    if not columns:
        return df
    # one pass for all columns: distinct (column, value) pairs, one global rank,
    # less the rank at which the column begins
    rows = [F.struct(F.lit(i).alias("c"), col(c).cast("string").alias("value")) for i, c in enumerate(columns)]
    pairs = df.select(F.inline(F.array(*rows))).filter(F.col("value").isNotNull()).distinct()
    if listed:
        found = _listed_codes(pairs)
        if found is not None:
            null, new = F.lit(null_code).cast("bigint"), {}
            for i, c in enumerate(columns):
                code = F.create_map(*[x for k, v in enumerate(found.get(i, [])) for x in (F.lit(v), F.lit(k).cast("bigint"))])
                raw = col(c).cast("string").cast("binary")
                new[c] = (F.coalesce(code[raw], null) if i in found else null).alias(c)
            return df.select(*[new.get(c, col(c)) for c in df.columns])
    ranked = materialised(global_rank(pairs, [F.col("c"), F.col("value")], "r"))
    begins = ranked.groupBy("c").agg(F.min("r").alias("begin"))  # a row a column
    codes = ranked.join(F.broadcast(begins), "c").select("c", "value", (F.col("r") - F.col("begin")).alias("code"))
    out = df
    for i, c in enumerate(columns):
        own = codes.filter(F.col("c") == i).select(F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__k{i}"))
        out = out.join(own, col(c).cast("string") == F.col(f"__v{i}"), "left")
        out = out.withColumn(c, F.coalesce(F.col(f"__k{i}"), F.lit(null_code).cast("bigint"))).drop(f"__v{i}", f"__k{i}")
    return out


def to_numeric(df: DataFrame, columns) -> DataFrame:
    """Text -> double; anything that does not parse becomes null (never an error)."""
    cs = set(as_list(columns))
    return df.select(*[col(c).try_cast("double").alias(c) if c in cs else col(c) for c in df.columns])


def clean_inf(df: DataFrame, columns=None) -> DataFrame:
    """E5: +inf, -inf and NaN -> 0.0, then nulls -> 0.0 (numeric columns)."""
    types = field_types(df)
    kinds = classes(df)
    cs = set([c for c in df.columns if kinds[c] == NUMERIC] if columns is None else as_list(columns))
    out = []
    for c in df.columns:
        if c in cs:
            x = as_double(c, types[c])
            bad = F.isnan(x) | (x == F.lit(float("inf"))) | (x == F.lit(float("-inf")))
            out.append(F.coalesce(F.when(bad, F.lit(0.0)).otherwise(x), F.lit(0.0)).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def target_int(df: DataFrame, target: str) -> DataFrame:
    """Target as integer after rows without a target are dropped."""
    return df.filter(col(target).isNotNull()).withColumn(target, col(target).cast("int"))


def prepare_target(df: DataFrame, target: str, task: str) -> DataFrame:
    """Classification -> category codes; regression -> number with median fill."""
    if task == "classification":
        return encode(df, [target])
    num = to_numeric(df, [target]) if classes(df)[target] == STRING else df
    return impute_median(num, [target])


def null_cells(df: DataFrame) -> DataFrame:
    """One row, ``(n_null_cells, ok)`` over every column in one aggregation."""
    total = None
    for c in df.columns:
        e = F.count_if(col(c).isNull())
        total = e if total is None else total + e
    return df.agg(total.cast("bigint").alias("n_null_cells")).withColumn("ok", F.col("n_null_cells") == 0)


def assert_no_nulls(df: DataFrame) -> None:
    n = null_cells(df).first()["n_null_cells"]
    if n:
        raise AssertionError(f"{n} null cells left")


def variances(df: DataFrame, columns=None, threshold: float = LOW_VARIANCE) -> DataFrame:
    """Population variance per numeric column and whether it is ``<= threshold``."""
    types = field_types(df)
    kinds = classes(df)
    columns = as_list(columns) or [c for c in df.columns if kinds[c] == NUMERIC]
    one = df.agg(*[F.var_pop(as_double(c, types[c])).alias(f"__v{i}") for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"__v{i}").alias("var_pop")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*rows))).withColumn("low", F.col("var_pop") <= threshold)


def low_variance(df: DataFrame, columns=None, threshold: float = LOW_VARIANCE) -> list[str]:
    return [r["column"] for r in variances(df, columns, threshold).filter("low").collect()]


def split(df: DataFrame, key, test: float = 0.2, seed: int = 1, column: str = "is_test") -> DataFrame:
    """Deterministic train/test flag from md5(seed:key).

    The same row lands in the same part whatever the plan, partitioning or
    added columns, so every round of the loop scores on the same rows.
    """
    keys = as_list(key)
    k = col(keys[0]).cast("string") if len(keys) == 1 else F.concat_ws("|", *[col(x).cast("string") for x in keys])
    return df.withColumn(column, hash_bucket(seed, k, 100) < F.lit(int(round(test * 100))))


def balance(df: DataFrame, target: str, key, major=0, n: int | None = None, seed: int = 42) -> DataFrame:
    """Keep at most ``n`` rows of class ``major`` (default: size of the
    smallest other class), chosen by md5(seed:key); every other class is kept
    whole.

    The cut-off is the n-th smallest hash, found by histograms: the class is
    neither sorted nor shuffled. Rows that share a key share its hash; of those
    at the cut-off as many stay as are wanted.
    """
    keys = as_list(key)
    k = col(keys[0]).cast("string") if len(keys) == 1 else F.concat_ws("|", *[col(x).cast("string") for x in keys])
    if n is None:
        counts = df.filter(col(target).isNotNull() & (col(target) != F.lit(major))).groupBy(col(target)).count()
        row = counts.agg(F.min("count").alias("m")).first()
        n = int(row["m"] or 0)
    maj = df.filter(col(target) == F.lit(major))
    rest = df.filter(~(col(target) == F.lit(major)) | col(target).isNull())
    return smallest_by_hash(maj, hash_order(seed, k), n).unionByName(rest)


def assemble(df: DataFrame, features, output: str = "features") -> DataFrame:
    """Numeric feature vector; codes stay plain numbers (no nominal metadata)."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="keep").transform(df)


def model_frame(df: DataFrame, target: str, task: str, drop_null_target: bool = True,
                passthrough=()) -> tuple[DataFrame, list[str]]:
    """Everything a scorer needs: text nulls -> ``'MISSING'`` then codes,
    numeric nulls -> median, infinities -> 0, target prepared (E1-E7).
    ``passthrough`` columns (e.g. a row key) are carried along untouched."""
    return counted_frame(df, target, task, drop_null_target, passthrough)[:2]


def counted_frame(df: DataFrame, target: str, task: str, drop_null_target: bool = True,
                  passthrough=()) -> tuple[DataFrame, list[str], int]:
    """:func:`model_frame` and the number of its rows."""
    if drop_null_target:
        df = df.filter(col(target).isNotNull())
    kinds = classes(df)
    keep = [c for c in df.columns if c != target and c not in passthrough and kinds[c] in (NUMERIC, STRING)]
    strs = [c for c in keep if kinds[c] == STRING]
    nums = [c for c in keep if kinds[c] == NUMERIC]
    df = df.select(*[F.coalesce(col(c), F.lit(MISSING_TOKEN)).alias(c) if c in strs else col(c) for c in keep],
                   col(target), *[col(c) for c in passthrough])
    # medians, codes and the target each read the table: a join must not run for every pass
    df = materialised(df)
    rows = df.count()
    df = impute_median(df, nums)
    if rows < FEW or task != "classification":
        df = encode(df, strs, listed=rows >= FEW)
        df = clean_inf(df, keep)
        df = prepare_target(df, target, task)
    else:  # codes of features and target are found together
        df = encode(df, [*strs, target], listed=True)
        df = clean_inf(df, keep)
    return df, keep, rows
