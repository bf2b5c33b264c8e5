"""Registered queries: feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from widen.operators.join import augment
from widen.operators.prep import (
    balance,
    clean_inf,
    encode,
    impute_constant,
    impute_median,
    null_cells,
    prepare_target,
    split,
    to_numeric,
    variances,
)
from widen.plans.registry import query, table
from widen.plans.sqlgen import augment_sql, union_all

_WIDE = augment_sql("customer", "c_custkey", "events", "user_id", ["value"], ["event_type", "props"],
                    round_means=False)


def _wide(spark, sf_dir):
    return augment(table(spark, sf_dir, "customer"), table(spark, sf_dir, "events"), ["value", "event_type", "props"],
                   left_keys="c_custkey", right_keys="user_id")


@query("impute_median", f"""
WITH wide AS ({_WIDE})
SELECT c_custkey, c_acctbal, round(coalesce(value, (SELECT median(value) FROM wide)), 6) AS value FROM wide
""")
def impute_median_q(spark, sf_dir):
    out = impute_median(_wide(spark, sf_dir), ["c_acctbal", "value"])
    return out.select("c_custkey", "c_acctbal", F.round("value", 6).alias("value"))


@query("impute_constant", f"""
WITH wide AS ({_WIDE})
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, round(coalesce(value, 0), 6) AS value,
       coalesce(event_type, 'MISSING') AS event_type, coalesce(props, 'MISSING') AS props FROM wide
""")
def impute_constant_q(spark, sf_dir):
    return impute_constant(_wide(spark, sf_dir)).withColumn("value", F.round("value", 6))


def _codes_sql(src, c):
    return (f"LEFT JOIN (SELECT v, (dense_rank() OVER (ORDER BY v) - 1)::BIGINT AS code "
            f"FROM (SELECT DISTINCT {c} AS v FROM {src} WHERE {c} IS NOT NULL)) k_{c} ON w.{c} = k_{c}.v")


@query("encode_category", f"""
WITH wide AS ({_WIDE})
SELECT w.c_custkey, coalesce(k_c_mktsegment.code, -1) AS c_mktsegment, coalesce(k_event_type.code, -1) AS event_type
FROM wide w {_codes_sql('wide', 'c_mktsegment')} {_codes_sql('wide', 'event_type')}
""")
def encode_category(spark, sf_dir):
    out = encode(_wide(spark, sf_dir), ["c_mktsegment", "event_type"])
    return out.select("c_custkey", "c_mktsegment", "event_type")


@query("to_numeric", """
SELECT event_id, TRY_CAST(props AS DOUBLE) AS props, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
FROM events
""")
def to_numeric_q(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "props",
                                               F.get_json_object("props", "$.k").alias("k"))
    return to_numeric(ev, ["props", "k"])


@query("clean_inf", """
SELECT event_id, round(ln(1 + CASE WHEN isinf(g) OR isnan(g) THEN 0 ELSE g END), 6) AS growth,
       round(ln(1 - CASE WHEN isinf(-g) OR isnan(-g) THEN 0 ELSE -g END), 6) AS decline
FROM (SELECT event_id, exp(value * 10) AS g FROM events)
""")
def clean_inf_q(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.exp(F.col("value") * 10).alias("growth"))
    out = clean_inf(ev.withColumn("decline", -F.col("growth")), ["growth", "decline"])
    # compared on a log scale: exp() differs between engines in the last bit
    return out.select("event_id", F.round(F.log(1 + F.col("growth")), 6).alias("growth"),
                      F.round(F.log(1 - F.col("decline")), 6).alias("decline"))


@query("prepare_target", """
SELECT c_custkey,
       (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::BIGINT AS c_mktsegment,
       coalesce(c_acctbal, (SELECT median(c_acctbal) FROM customer)) AS c_acctbal
FROM customer
""")
def prepare_target_q(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    c = prepare_target(c, "c_mktsegment", "classification")
    return prepare_target(c, "c_acctbal", "regression")


@query("null_check", f"""
WITH wide AS ({_WIDE})
SELECT 'raw' AS stage, (count(*) * 8 - count(c_custkey) - count(c_name) - count(c_nationkey) - count(c_acctbal)
        - count(c_mktsegment) - count(value) - count(event_type) - count(props))::BIGINT AS n_null_cells FROM wide
UNION ALL SELECT 'imputed', 0::BIGINT FROM (SELECT 1)
""")
def null_check(spark, sf_dir):
    w = _wide(spark, sf_dir)
    raw = null_cells(w).select(F.lit("raw").alias("stage"), "n_null_cells")
    filled = null_cells(impute_constant(impute_median(w))).select(F.lit("imputed").alias("stage"), "n_null_cells")
    return raw.unionByName(filled)


_LNUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("low_variance", union_all(
    f"SELECT '{c}' AS column, round(var_pop({c}::DOUBLE), 6) AS var_pop, var_pop({c}::DOUBLE) <= 0.1 AS low "
    f"FROM lineitem" for c in _LNUM))
def low_variance_q(spark, sf_dir):
    return variances(table(spark, sf_dir, "lineitem"), _LNUM).withColumn("var_pop", F.round("var_pop", 6))


@query("split_hash", """
SELECT c_custkey, (('0x' || substr(md5('1:' || c_custkey::VARCHAR), 1, 8))::BIGINT % 100) < 20 AS is_test
FROM customer
""")
def split_hash(spark, sf_dir):
    return split(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", test=0.2, seed=1)


@query("balance_classes", """
WITH minority AS (SELECT min(n) AS m FROM (SELECT quality, count(*) AS n FROM labels
                  WHERE quality IS NOT NULL AND quality <> 1 GROUP BY quality))
SELECT doc_id, quality, toxic FROM (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS r FROM labels WHERE quality = 1)
WHERE r <= (SELECT m FROM minority)
UNION ALL
SELECT doc_id, quality, toxic FROM labels WHERE quality <> 1 OR quality IS NULL
""")
def balance_classes(spark, sf_dir):
    return balance(table(spark, sf_dir, "labels"), "quality", "doc_id", major=1, seed=42)
