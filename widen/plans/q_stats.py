"""Registered queries: group statistics, profiles, key detection (A2-A10, K1-K6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from widen.operators.aggregate import (
    describe_strings,
    distinct_counts,
    group_summary,
    medians,
    min_max,
    null_profile,
    shape,
    top_values,
    value_counts,
)
from widen.operators.join import augment
from widen.operators.profile import (
    EXCLUDE_TOKENS,
    KEY_TOKENS,
    MIN_NOTNULL_RATIO,
    MIN_UNIQUE_RATIO,
    MIN_UNIQUE_RATIO_NAMED,
    describe_table,
    detect_keys,
    infer_task,
    profile,
    profile_incremental,
)
from widen.operators.profile_state import profile_state, state_profile, stored_state, write_state
from widen.plans.registry import query, table
from widen.session import checkpoint_dir
from widen.plans.sqlgen import augment_sql, union_all

# DuckDB type name -> Spark simpleString, for the oracles
SPARK_TYPE_SQL = ("CASE {e} WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
                  "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower({e}) END")

LINE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]
LINE_TXT = ["l_returnflag", "l_linestatus", "l_shipdate"]
LINE_ALL = LINE_NUM[:4] + LINE_NUM[4:] + LINE_TXT


def _r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


# -- A2 -----------------------------------------------------------------------


@query("group_summary", """
SELECT g.o_orderpriority, g.n, g.mean_o_totalprice, m.mode_o_orderstatus FROM
 (SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean_o_totalprice
  FROM orders GROUP BY o_orderpriority) g
LEFT JOIN (SELECT k, v AS mode_o_orderstatus FROM (
  SELECT o_orderpriority AS k, o_orderstatus AS v,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_orderstatus) AS rn
  FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderpriority, o_orderstatus) WHERE rn = 1) m
ON g.o_orderpriority IS NOT DISTINCT FROM m.k
""")
def group_summary_q(spark, sf_dir):
    out = group_summary(table(spark, sf_dir, "orders"), "o_orderpriority", mean=["o_totalprice"],
                        mode=["o_orderstatus"])
    return _r6(out, "mean_o_totalprice")


# -- A3, A4, A5, A7, A9, A10 ------------------------------------------------


@query("value_counts", """
SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type
""")
def value_counts_q(spark, sf_dir):
    return value_counts(table(spark, sf_dir, "events"), "event_type")


def _long_sql(tbl, cols):
    return union_all(f"SELECT '{c}' AS column, {c}::VARCHAR AS value FROM {tbl}" for c in cols)


@query("top_values", f"""
SELECT column, rank, value, n FROM (
  SELECT column, value, n, row_number() OVER (PARTITION BY column ORDER BY n DESC, value) AS rank FROM (
    SELECT column, value, count(*) AS n FROM ({_long_sql('lineitem', LINE_TXT)})
    WHERE value IS NOT NULL GROUP BY column, value))
WHERE rank <= 3
""")
def top_values_q(spark, sf_dir):
    return top_values(table(spark, sf_dir, "lineitem"), LINE_TXT, 3)


@query("distinct_counts", union_all(
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in LINE_ALL))
def distinct_counts_q(spark, sf_dir):
    return distinct_counts(table(spark, sf_dir, "lineitem"), LINE_ALL)


@query("min_max", union_all(
    f"SELECT '{c}' AS column, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
    + (f"min({c})::BIGINT AS min_int, max({c})::BIGINT AS max_int" if c in LINE_NUM[:4] else
       "NULL::BIGINT AS min_int, NULL::BIGINT AS max_int") + " FROM lineitem" for c in LINE_NUM))
def min_max_q(spark, sf_dir):
    return min_max(table(spark, sf_dir, "lineitem"), LINE_NUM)


@query("describe_string", f"""
SELECT column, sum(n)::BIGINT AS count, count(*) AS unique,
       arg_min(value, (-n, value)) AS top, max(n) AS freq
FROM (SELECT column, value, count(*) AS n FROM ({_long_sql('events', ['event_type', 'props'])})
      WHERE value IS NOT NULL GROUP BY column, value)
GROUP BY column
""")
def describe_string_q(spark, sf_dir):
    return describe_strings(table(spark, sf_dir, "events"), ["event_type", "props"])


@query("table_shape", "SELECT count(*) AS n_rows, 11::BIGINT AS n_columns FROM lineitem")
def table_shape(spark, sf_dir):
    return shape(table(spark, sf_dir, "lineitem"))


# -- K1: profiles ---------------------------------------------------------------

_POS = {c: i for i, c in enumerate(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                     "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                                     "l_shipdate"])}


def _num_profile_sql(tbl, cols, pos, types):
    return union_all(
        f"SELECT '{c}' AS column, {pos[c]} AS pos, '{types[c]}' AS dtype, min({c})::DECIMAL(38,4) AS min, "
        f"max({c})::DECIMAL(38,4) AS max FROM {tbl}" for c in cols)


def _str_profile_sql(tbl, cols, pos, types):
    return f"""
SELECT column, pos, dtype, count(*) AS unique_count,
       string_agg(CASE WHEN rk <= 3 THEN value END, ', ' ORDER BY rk) AS cell_examples
FROM (SELECT column, value, n, row_number() OVER (PARTITION BY column ORDER BY n DESC, value) AS rk,
             CASE column {' '.join(f"WHEN '{c}' THEN {pos[c]}" for c in cols)} END AS pos,
             CASE column {' '.join(f"WHEN '{c}' THEN '{types[c]}'" for c in cols)} END AS dtype
      FROM (SELECT column, value, count(*) AS n FROM ({_long_sql(tbl, cols)})
            WHERE value IS NOT NULL GROUP BY column, value))
GROUP BY column, pos, dtype"""


_LTYPES = {**{c: "bigint" for c in ["l_orderkey", "l_partkey", "l_suppkey"]}, "l_linenumber": "int",
           **{c: "double" for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]},
           "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


@query("profile_numeric", _num_profile_sql("lineitem", LINE_NUM, _POS, _LTYPES))
def profile_numeric(spark, sf_dir):
    p = profile(table(spark, sf_dir, "lineitem"))
    return p.filter(F.col("unique_count").isNull()).select("column", "pos", "dtype", "min", "max")


_BIG = ("o_orderkey * 1000000007 + 9007199254740993 AS big, "
        "CASE WHEN o_orderkey % 7 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS holes")


@query("profile_large", union_all(
    f"SELECT '{c}' AS column, {i} AS pos, '{t}' AS dtype, min({c})::DECIMAL(38,4) AS min, max({c})::DECIMAL(38,4) AS max "
    f"FROM (SELECT {_BIG} FROM orders) WHERE {c} <> 'NaN'::DOUBLE"
    for i, (c, t) in enumerate([("big", "bigint"), ("holes", "double")])))
def profile_large(spark, sf_dir):
    """Long ids past 2**53 and a column with NaN."""
    o = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") * 1000000007 + 9007199254740993).alias("big"),
        F.when(F.col("o_orderkey") % 7 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("holes"))
    return profile(o).select("column", "pos", "dtype", "min", "max")


@query("min_max_large", """
SELECT 'big' AS column, min(big)::DOUBLE AS min, max(big)::DOUBLE AS max, min(big) AS min_int, max(big) AS max_int
FROM (SELECT o_orderkey * 1000000007 + 9007199254740993 AS big FROM orders)""")
def min_max_large(spark, sf_dir):
    return min_max(table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") * 1000000007 + 9007199254740993).alias("big")))


def _string_view(p):
    return p.filter(F.col("unique_count").isNotNull()).select(
        "column", "pos", "dtype", "unique_count", F.array_join("cell_examples", ", ").alias("cell_examples"))


@query("profile_string", _str_profile_sql("lineitem", LINE_TXT, _POS, _LTYPES))
def profile_string(spark, sf_dir):
    return _string_view(profile(table(spark, sf_dir, "lineitem")))


_WIDE_EV = augment_sql("customer", "c_custkey", "events", "user_id", ["value"], ["event_type", "props"],
                       round_means=False)
_WPOS = {c: i for i, c in enumerate(["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
                                     "value", "event_type", "props"])}
_WTYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
           "c_mktsegment": "string", "value": "double", "event_type": "string", "props": "string"}


def _wide_events(spark, sf_dir):
    return augment(table(spark, sf_dir, "customer"), table(spark, sf_dir, "events"), ["value", "event_type", "props"],
                   left_keys="c_custkey", right_keys="user_id")


@query("profile_incremental", f"""
WITH wide AS ({_WIDE_EV})
SELECT column, pos, dtype, min, max, NULL::BIGINT AS unique_count, NULL::VARCHAR AS cell_examples FROM (
{_num_profile_sql('wide', ['c_custkey', 'c_nationkey', 'c_acctbal', 'value'], _WPOS, _WTYPES)})
UNION ALL
SELECT column, pos, dtype, NULL::DECIMAL(38,4), NULL::DECIMAL(38,4), unique_count, cell_examples FROM (
{_str_profile_sql('wide', ['c_name', 'c_mktsegment', 'event_type', 'props'], _WPOS, _WTYPES)})
""")
def profile_incremental_q(spark, sf_dir):
    known = profile(table(spark, sf_dir, "customer"))  # profile kept from before the join
    p = profile_incremental(_wide_events(spark, sf_dir), known)
    return p.select("column", "pos", "dtype", "min", "max", "unique_count",
                    F.array_join("cell_examples", ", ").alias("cell_examples"))


@query("null_profile", f"""
WITH wide AS ({_WIDE_EV})
{union_all(f"SELECT '{c}' AS column, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
           f"round((count(*) - count({c}))::DOUBLE / count(*), 6) AS null_ratio, count({c}) AS n_notnull FROM wide"
           for c in _WPOS)}
""")
def null_profile_q(spark, sf_dir):
    return _r6(null_profile(_wide_events(spark, sf_dir)), "null_ratio")


@query("median_profile", union_all(
    f"SELECT '{c}' AS column, round(median({c}::DOUBLE), 6) AS median FROM lineitem" for c in LINE_NUM))
def median_profile(spark, sf_dir):
    return _r6(medians(table(spark, sf_dir, "lineitem"), LINE_NUM), "median")


@query("table_overview", f"""
SELECT (SELECT count(*) FROM information_schema.columns WHERE table_name = 'nation') AS n_columns,
       (SELECT string_agg(column_name, ',' ORDER BY ordinal_position) FROM information_schema.columns
         WHERE table_name = 'nation') AS columns,
       (SELECT string_agg({SPARK_TYPE_SQL.format(e='data_type')}, ',' ORDER BY ordinal_position)
          FROM information_schema.columns WHERE table_name = 'nation') AS dtypes,
       (SELECT count(*) FROM nation) AS n_rows,
       (SELECT string_agg(j, chr(10) ORDER BY k) FROM (
          SELECT n_nationkey AS k,
                 to_json({{'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}})::VARCHAR AS j
          FROM nation ORDER BY n_nationkey LIMIT 3)) AS sample_rows
""")
def table_overview(spark, sf_dir):
    d = describe_table(table(spark, sf_dir, "nation"), "n_nationkey", 3)
    return d.select("n_columns", F.array_join("columns", ",").alias("columns"),
                    F.array_join("dtypes", ",").alias("dtypes"), "n_rows",
                    F.array_join("sample_rows", "\n").alias("sample_rows"))


@query("table_overview_orders", f"""
SELECT (SELECT count(*) FROM information_schema.columns WHERE table_name = 'orders'
          AND column_name <> 'o_orderdate') AS n_columns,
       (SELECT string_agg(column_name, ',' ORDER BY ordinal_position) FROM information_schema.columns
         WHERE table_name = 'orders' AND column_name <> 'o_orderdate') AS columns,
       (SELECT string_agg({SPARK_TYPE_SQL.format(e='data_type')}, ',' ORDER BY ordinal_position)
          FROM information_schema.columns WHERE table_name = 'orders' AND column_name <> 'o_orderdate') AS dtypes,
       (SELECT count(*) FROM orders) AS n_rows,
       (SELECT string_agg(j, chr(10) ORDER BY k) FROM (
          SELECT o_orderkey AS k,
                 to_json({{'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus,
                          'o_totalprice': o_totalprice, 'o_orderpriority': o_orderpriority}})::VARCHAR AS j
          FROM orders ORDER BY o_orderkey LIMIT 3)) AS sample_rows
""")
def table_overview_orders(spark, sf_dir):
    # the same overview of a table that grows
    d = describe_table(table(spark, sf_dir, "orders").drop("o_orderdate"), "o_orderkey", 3)
    return d.select("n_columns", F.array_join("columns", ",").alias("columns"),
                    F.array_join("dtypes", ",").alias("dtypes"), "n_rows",
                    F.array_join("sample_rows", "\n").alias("sample_rows"))


# -- K4 / K5 / K6 ------------------------------------------------------------

KEY_TABLES = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
}


def _keys_sql(min_unique, min_named, min_notnull):
    named = " OR ".join(f"contains(lower(column), '{t}')" for t in KEY_TOKENS)
    excl = " OR ".join(f"contains(lower(column), '{t}')" for t in EXCLUDE_TOKENS)
    stats = union_all(
        f"SELECT '{t}' AS table_name, '{c}' AS column, {i} AS pos, count(*) AS n_rows, count({c}) AS n_notnull, "
        f"count(DISTINCT {c}::VARCHAR) AS n_distinct FROM {t}"
        for t, cols in KEY_TABLES.items() for i, c in enumerate(cols))
    ur = "(n_distinct::DOUBLE / nullif(n_notnull, 0))"
    nr = "(n_notnull::DOUBLE / nullif(n_rows, 0))"
    return f"""
SELECT table_name, column, pos, n_rows, n_notnull, n_distinct,
       round({ur}, 6) AS unique_ratio, round({nr}, 6) AS notnull_ratio,
       ({named}) AS name_hint, ({excl}) AS excluded,
       coalesce(n_notnull > 0 AND ({ur} >= {min_unique} OR (({named}) AND {ur} >= {min_named}))
                AND {nr} >= {min_notnull} AND NOT ({excl}), false) AS is_key
FROM ({stats})"""


def _keys_df(spark, sf_dir, **kw):
    out = None
    for t in KEY_TABLES:
        k = detect_keys(table(spark, sf_dir, t), **kw).select(F.lit(t).alias("table_name"), "*")
        out = k if out is None else out.unionByName(k)
    return _r6(out.withColumn("is_key", F.coalesce("is_key", F.lit(False))), "unique_ratio", "notnull_ratio")


@query("detect_keys", _keys_sql(MIN_UNIQUE_RATIO, MIN_UNIQUE_RATIO_NAMED, MIN_NOTNULL_RATIO))
def detect_keys_q(spark, sf_dir):
    return _keys_df(spark, sf_dir)


@query("detect_keys_strict", _keys_sql(0.8, MIN_UNIQUE_RATIO_NAMED, MIN_NOTNULL_RATIO))
def detect_keys_strict(spark, sf_dir):
    return _keys_df(spark, sf_dir, min_unique=0.8)


TASKS = [("customer", "c_mktsegment"), ("customer", "c_acctbal"), ("labels", "quality"),
         ("documents", "n_chars"), ("orders", "o_orderstatus")]


@query("infer_task", union_all(
    f"SELECT '{t}' AS table_name, '{y}' AS target, {SPARK_TYPE_SQL.format(e=f'typeof(any_value({y}))')} AS dtype, "
    f"count(DISTINCT {y}) AS n_distinct, CASE WHEN typeof(any_value({y})) = 'VARCHAR' OR count(DISTINCT {y}) <= 10 "
    f"THEN 'classification' ELSE 'regression' END AS task FROM {t}" for t, y in TASKS))
def infer_task_q(spark, sf_dir):
    out = None
    for t, y in TASKS:
        k = infer_task(table(spark, sf_dir, t), y).select(F.lit(t).alias("table_name"), "*")
        out = k if out is None else out.unionByName(k)
    return out


# -- A4-A7, K2: a profile brought up to date by new rows ---------------------------

_STATE_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
_STATE_TEXT = ["o_orderstatus", "o_orderpriority"]


def _state_sql() -> str:
    nums = [f"""SELECT '{c}' AS column, count(*) AS n_rows, count(*) - count({c}) AS n_missing,
       min({c})::DECIMAL(38,4) AS min, max({c})::DECIMAL(38,4) AS max, round(avg({c}), 4) AS mean,
       NULL::BIGINT AS unique_count, NULL::VARCHAR AS examples FROM orders""" for c in _STATE_NUM]
    texts = [f"""SELECT '{c}', (SELECT count(*) FROM orders), (SELECT count(*) - count({c}) FROM orders), NULL, NULL, NULL,
       (SELECT count(DISTINCT {c}) FROM orders),
       (SELECT string_agg({c} || '=' || n, ';' ORDER BY n DESC, {c}) FROM (
          SELECT {c}, count(*) AS n FROM orders GROUP BY {c} ORDER BY n DESC, {c} LIMIT 3))""" for c in _STATE_TEXT]
    return " UNION ALL ".join(nums + texts)


@query("profile_appended", _state_sql())
def profile_appended(spark, sf_dir):
    """Orders arrive in three parts; the stored state grows by each, and the
    profile of all rows is read from it alone."""
    path = f"{checkpoint_dir(spark)}/profile-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select(*_STATE_NUM, *_STATE_TEXT)
    for part in range(3):
        write_state(profile_state(orders.filter(F.col("o_orderkey") % 3 == part)), path)
    p = state_profile(stored_state(spark, path))
    text = F.col("column").isin(_STATE_TEXT)
    shown = F.array_join(F.transform("cell_examples", lambda r: F.concat(r["value"], F.lit("="), r["n"].cast("string"))), ";")
    return p.select("column", "n_rows", "n_missing", "min", "max", F.round("mean", 4).alias("mean"),
                    F.when(text, F.col("unique_count")).alias("unique_count"), F.when(text, shown).alias("examples"))
