"""Column helpers shared by every operator.

Column names in feature tables can hold spaces, ``*``, dots or back-quotes
(``SCHOOL LEVEL*``, ``2009-2010 OVERALL GRADE``), so every reference to a column
by name goes through :func:`col`, which back-quotes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quote(name: str) -> str:
    """Back-quote a column name, doubling inner back-quotes."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Reference a top-level column by its exact name."""
    return F.col(quote(name))


def cols(names) -> list[Column]:
    return [col(n) for n in names]


def as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (list, tuple)):
        return list(x)
    return [x]


# ---------------------------------------------------------------------------
# type classes (the reference only ever splits numeric / string / other)
# ---------------------------------------------------------------------------

NUMERIC = "numeric"
STRING = "string"
TEMPORAL = "temporal"
OTHER = "other"


def type_class(dt: T.DataType) -> str:
    if isinstance(dt, (T.NumericType, T.BooleanType)):
        return NUMERIC
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return STRING
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TEMPORAL
    return OTHER


def field_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def classes(df: DataFrame) -> dict[str, str]:
    return {f.name: type_class(f.dataType) for f in df.schema.fields}


def as_double(name: str, dt: T.DataType) -> Column:
    """Numeric value as double; booleans count as 0/1 like pandas, NaN is
    undefined and so null."""
    c = col(name)
    if isinstance(dt, T.BooleanType):
        c = c.cast("int")
    c = c.cast("double")
    return F.when(~F.isnan(c), c) if isinstance(dt, (T.FloatType, T.DoubleType)) else c


def native(name: str, dt: T.DataType) -> Column:
    """Numeric value in its own type: booleans as 0/1, NaN as null. Integers
    beyond 2**53 keep all their digits, which a double would not."""
    c = col(name)
    if isinstance(dt, T.BooleanType):
        return c.cast("int")
    return F.when(~F.isnan(c), c) if isinstance(dt, (T.FloatType, T.DoubleType)) else c


def defined(name: str, dt: T.DataType) -> Column:
    """Whether a value is there: not null and, for numbers, not NaN."""
    c = col(name)
    return c.isNotNull() & ~F.isnan(c) if isinstance(dt, (T.FloatType, T.DoubleType)) else c.isNotNull()


# ---------------------------------------------------------------------------
# deterministic hashing (row keys, seeds) -- the same formula runs in DuckDB:
#   cast(conv(substr(md5(concat(seed, ':', key)), 1, 8), 16, 10) as bigint)
# DuckDB: ('x' || substr(md5(seed || ':' || key), 1, 8))::bit... see queries
# ---------------------------------------------------------------------------


def hash_bucket(seed, key: Column, buckets: int = 100) -> Column:
    """Stable bucket in ``[0, buckets)`` from md5(seed:key); plan-independent."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10)
    return (h.cast("bigint") % F.lit(buckets)).cast("int")


def hash_order(seed, key: Column) -> Column:
    """Stable pseudo-random sort key from md5(seed:key)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))

