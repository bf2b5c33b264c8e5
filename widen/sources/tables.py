"""Table handles, readers and sinks."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from widen.functions.columns import as_list, col, quote
from widen.session import checkpoint_dir


@dataclass(frozen=True)
class TableRef:
    """A lazily evaluated table plus the catalog metadata the loop needs.

    ``left_keys`` are columns of the base table, ``right_keys`` the matching
    columns of this table (composite keys are lists of equal length).
    """

    name: str
    df: DataFrame
    left_keys: tuple = ()
    right_keys: tuple = ()
    score: float | None = None
    size: int | None = None
    description: str | None = None
    target: str | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "left_keys", tuple(as_list(self.left_keys)))
        object.__setattr__(self, "right_keys", tuple(as_list(self.right_keys)))
        if self.left_keys and self.right_keys and len(self.left_keys) != len(self.right_keys):
            raise ValueError(f"{self.name}: left keys {self.left_keys} and right keys {self.right_keys} differ in length")

    @property
    def columns(self) -> list[str]:
        return list(self.df.columns)

    def features(self) -> list[str]:
        """Every non-key column (the 'select all' feature list, F7)."""
        keys = set(self.right_keys)
        return [c for c in self.df.columns if c not in keys]

    def with_df(self, df: DataFrame) -> "TableRef":
        return replace(self, df=df)


# Cells that the reference's reader takes for missing ones.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
               "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _typed(df: DataFrame, columns, null_tokens) -> DataFrame:
    """Text columns with missing cells as null and the narrowest type that all
    other cells have, found in one pass over all columns."""
    columns = list(columns)
    cells = [F.when(~F.col(quote(c)).isin(*null_tokens), F.col(quote(c))).alias(c) if null_tokens else F.col(quote(c))
             for c in columns]
    clean = df.select(*cells, *[F.col(quote(c)) for c in df.columns if c not in columns])
    kinds = ("int", "bigint", "double", "boolean", "date", "timestamp")
    # dates only where they look like dates: a bare year is a number
    dated = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T].*)?\s*$"

    def fits(c, kind):
        v = F.col(quote(c))
        ok = v.try_cast(kind).isNotNull()
        if kind == "date":
            ok = ok & v.rlike(dated) & ~v.contains(":")
        return ok & v.rlike(dated) if kind == "timestamp" else ok

    counts = clean.agg(*[F.count(F.col(quote(c))).alias(f"n{i}") for i, c in enumerate(columns)],
                       *[F.count_if(fits(c, k)).alias(f"{k}{i}") for i, c in enumerate(columns) for k in kinds]).first()
    out = []
    for i, c in enumerate(columns):
        n = counts[f"n{i}"]
        kind = next((k for k in kinds if counts[f"{k}{i}"] == n), "string") if n else "string"
        out.append(F.col(quote(c)).try_cast(kind).alias(c) if kind != "string" else F.col(quote(c)))
    return clean.select(*out, *[F.col(quote(c)) for c in df.columns if c not in columns])


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    bad_rows: str = "keep",
    corrupt_column: str = "_corrupt_record",
    schema=None,
    multiline: bool = False,
    null_tokens=NULL_TOKENS,
):
    """Read a table; CSV with header and inferred types.

    Quotes are doubled inside quoted cells; with ``multiline`` a quoted cell may
    hold line ends (a file is then read by one task, so it is an option). Cells
    among ``null_tokens`` are null, and a column's type is that of the others.

    ``bad_rows`` (C2): ``'keep'`` (PERMISSIVE), ``'drop'`` (DROPMALFORMED) or
    ``'quarantine'``, which returns ``(good, bad)``: rows that failed to parse are
    kept as raw text in ``bad`` instead of being lost.
    """
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else
                  "json" if path.rstrip("/").endswith(".json") else "csv")
    if fmt != "csv":
        reader = spark.read.format(fmt)
        if schema is not None:
            reader = reader.schema(schema)
        return reader.load(path)
    if bad_rows not in ("keep", "drop", "quarantine"):
        raise ValueError(f"bad_rows must be keep, drop or quarantine, not {bad_rows!r}")

    def reader():
        return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multiline)

    if bad_rows != "quarantine":
        r = reader().option("mode", "PERMISSIVE" if bad_rows == "keep" else "DROPMALFORMED")
        if schema is not None:
            return r.schema(schema).csv(path)
        df = r.csv(path)
        return _typed(df, df.columns, null_tokens)
    from pyspark.sql import types as T

    fields = list((reader().csv(path).schema if schema is None else schema).fields)
    wide = T.StructType([*fields, T.StructField(corrupt_column, T.StringType(), True)])
    raw = reader().option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt_column).schema(wide).csv(path)
    # Spark refuses queries that only touch the corrupt column of a raw read;
    # materialising once through the checkpoint folder keeps both parts consistent.
    checkpoint_dir(spark)
    raw = raw.checkpoint(eager=True)
    good = raw.filter(col(corrupt_column).isNull()).drop(corrupt_column)
    bad = raw.filter(col(corrupt_column).isNotNull()).select(corrupt_column)
    return (good if schema is not None else _typed(good, good.columns, null_tokens)), bad


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by=None) -> None:
    """Table sink (C14): parquet by default, CSV with a header row."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*as_list(partition_by))
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def zip_columns(x: DataFrame, y: DataFrame, key: str | list[str]) -> DataFrame:
    """Column-wise concat of two frames.

    Spark rows have no position, so the frames are aligned on an explicit key
    (a left join keeps every row of ``x``); columns of ``y`` already in ``x``
    are not repeated.
    """
    keys = as_list(key)
    have = {c.lower() for c in x.columns}
    extra = [c for c in y.columns if c not in keys and c.lower() not in have]
    return x.join(y.select(*keys, *extra), on=keys, how="left")


def write_rounds(rounds: DataFrame, path: str) -> None:
    """Round log sink (C15): one JSON folder per round."""
    rounds.write.mode("overwrite").partitionBy("round").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """Final report sink (C15): JSON with histories plus a flat CSV summary."""
    report.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    flat = [c for c, t in report.dtypes if not t.startswith(("array", "struct", "map"))]
    report.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def load_tables(spark: SparkSession, sf_dir: str, names) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in as_list(names)}
