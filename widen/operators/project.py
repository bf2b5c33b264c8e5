"""Projection and filter operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from widen.functions.columns import as_list, col
from widen.sources.tables import TableRef


def drop_columns(df: DataFrame, names) -> DataFrame:
    """Drop columns by exact name (special characters allowed)."""
    drop = set(as_list(names))
    return df.select(*[col(c) for c in df.columns if c not in drop])


def drop_leaky(df: DataFrame, token: str) -> DataFrame:
    """P5: drop every column whose name contains ``token``."""
    return df.select(*[col(c) for c in df.columns if token not in c])


def drop_leaky_tables(tables: list[TableRef], token: str) -> list[TableRef]:
    """P5 over a pool: the same rule applied to each table (keys are kept)."""
    out = []
    for t in tables:
        keep = [c for c in t.df.columns if token not in c or c in t.right_keys]
        out.append(t.with_df(t.df.select(*[col(c) for c in keep])))
    return out


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """Keep rows whose target is present."""
    return df.filter(col(target).isNotNull())


def filter_equals(df: DataFrame, column: str, value) -> DataFrame:
    """Equality filter (``isin`` when ``value`` is a list)."""
    if isinstance(value, (list, tuple, set)):
        return df.filter(col(column).isin(list(value)))
    return df.filter(col(column) == F.lit(value))


def sample_rows(df: DataFrame, order_by, n: int = 3) -> DataFrame:
    """The first ``n`` rows by ``order_by`` as JSON records ``(rank, row_json)``.

    The limit is the operator (a fixed-size head sample); the order makes it
    deterministic.
    """
    order = as_list(order_by)
    head = df.orderBy(*[col(c) for c in order]).limit(n)
    # the window runs over the n sampled rows only
    rank = F.row_number().over(Window.orderBy(*[col(c) for c in order])).cast("bigint")
    return head.select(rank.alias("rank"), F.to_json(F.struct(*[col(c) for c in df.columns])).alias("row_json"))
