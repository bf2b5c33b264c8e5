"""Name -> (Spark query, DuckDB oracle SQL) registry used by ``__spark_entry__``.

Every query reads the driver's tables from ``sf_dir`` so its work grows with
them. Doubles that are means or ratios are rounded to 6 decimals on both sides
(summation order differs between engines in the last bits).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the DuckDB oracle (None = rows-only check)."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            # "column" is a reserved word in DuckDB; quote it where it is a name
            ORACLES[name] = re.sub(r'(?<![\w"\'.])column(?![\w"\'])', '"column"', sql)
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all():
    # importing the modules fills the registry
    from widen.plans import (  # noqa: F401
        q_join,
        q_stats,
        q_prep,
        q_select,
        q_catalog,
        q_recommend,
        q_model,
    )
    return QUERIES, ORACLES
