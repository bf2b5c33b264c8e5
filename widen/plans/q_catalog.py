"""Registered queries: joinable-table search and catalog frames.

The catalog is derived from the tables themselves: the value-containment
search (J6) over the candidate tables, turned into search-result JSON and
ingested back (C4), then cleaned, merged, admitted and ranked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from widen.functions.ranking import materialised
from widen.operators.profile import infer_task
from widen.plans.registry import query, table
from widen.plans.sqlgen import union_all
from widen.sources.catalog import (
    admit,
    clean_key_names,
    find_joinable,
    ingest_search_results,
    lookup_base,
    merge_catalog,
    next_table,
    pending,
    prune,
    to_search_results,
)
from widen.session import checkpoint_dir
from widen.sources.joinable_index import add_to_index, find_joinable_indexed

# key-like (integer / text) columns and column counts of the tables used
KEYLIKE = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
    "events": ["event_id", "user_id", "event_type", "props"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
}
# columns that are no text, and the text columns
VALUES = {"orders": (4, ["o_orderstatus", "o_orderpriority"]), "events": (4, ["event_type", "props"]),
          "supplier": (3, ["s_name"]), "nation": (2, ["n_name"])}
BASE_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CANDIDATES = ["orders", "events", "supplier", "nation"]
OLD_COLUMNS = ["c_custkey", "c_name"]  # base columns searched in an earlier run


def _joinable_sql() -> str:
    left = union_all(f"SELECT DISTINCT '{c}' AS left_column, {c}::VARCHAR AS value FROM customer "
                     f"WHERE {c} IS NOT NULL" for c in KEYLIKE["customer"])
    right = union_all(f"SELECT DISTINCT '{t}' AS dataset_name, '{c}' AS right_column, {c}::VARCHAR AS value "
                      f"FROM {t} WHERE {c} IS NOT NULL" for t in CANDIDATES for c in KEYLIKE[t])
    sizes = union_all(f"SELECT '{t}' AS dataset_name, (count(*) * {8 * VALUES[t][0]}"
                      + "".join(f" + coalesce(sum(strlen({c})), 0)" for c in VALUES[t][1]) + f")::BIGINT AS size FROM {t}"
                      for t in CANDIDATES)
    return f"""
SELECT sh.dataset_name, sh.left_column, sh.right_column, nb.n_base_values, sh.n_shared_values,
       sh.n_shared_values::DOUBLE / nb.n_base_values AS score, sz.size,
       (list_position({BASE_COLUMNS}, sh.left_column) - 1)::INTEGER AS join_key
FROM (SELECT left_column, dataset_name, right_column, count(*) AS n_shared_values
      FROM ({left}) l JOIN ({right}) r ON l.value = r.value GROUP BY left_column, dataset_name, right_column) sh
JOIN (SELECT left_column, count(*) AS n_base_values FROM ({left}) GROUP BY left_column) nb
  ON sh.left_column = nb.left_column
JOIN ({sizes}) sz ON sh.dataset_name = sz.dataset_name
WHERE sh.n_shared_values::DOUBLE / nb.n_base_values >= 0.5"""


JOINABLE = _joinable_sql()
CATALOG = f"""
SELECT dataset_name || '.' || right_column AS id, dataset_name, score,
       '[''' || left_column || ''']' AS left_columns_names, '[''' || right_column || ''']' AS right_columns_names,
       size, join_key, 'N/A' AS description, left_column
FROM ({JOINABLE})"""
CAT_COLS = "id, dataset_name, round(score, 6) AS score, left_columns_names, right_columns_names, size, join_key, description"
MERGED = f"""
SELECT * EXCLUDE (src, rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, score DESC, left_columns_names) AS rn FROM (
    SELECT *, 0 AS src FROM ({CATALOG}) WHERE left_column IN ({', '.join(f"'{c}'" for c in OLD_COLUMNS)})
    UNION ALL SELECT *, 1 AS src FROM ({CATALOG})))
WHERE rn = 1"""


def _joinable(spark, sf_dir):
    cands = {t: table(spark, sf_dir, t) for t in CANDIDATES}
    return find_joinable(table(spark, sf_dir, "customer"), cands)


def _catalog(spark, sf_dir, columns=None):
    j = _joinable(spark, sf_dir)
    if columns:
        j = j.filter(F.col("left_column").isin(columns))
    return ingest_search_results(to_search_results(j))


def _merged(spark, sf_dir):
    # one search; both catalogs read its rows
    j = materialised(_joinable(spark, sf_dir))
    old, new = (ingest_search_results(to_search_results(x)) for x in (j.filter(F.col("left_column").isin(OLD_COLUMNS)), j))
    return merge_catalog(old, new)


def _r6(df):
    return df.withColumn("score", F.round("score", 6))


@query("find_joinable", f"SELECT * EXCLUDE (score), round(score, 6) AS score FROM ({JOINABLE})")
def find_joinable_q(spark, sf_dir):
    return _r6(_joinable(spark, sf_dir))


@query("find_joinable_indexed", f"SELECT * EXCLUDE (score), round(score, 6) AS score FROM ({JOINABLE})")
def find_joinable_indexed_q(spark, sf_dir):
    """The same search over stored sketches of 512 hashes a column."""
    path = f"{checkpoint_dir(spark)}/joinable-{uuid.uuid4().hex}"
    for name in CANDIDATES:
        add_to_index(path, name, table(spark, sf_dir, name), k=512)
    out = find_joinable_indexed(table(spark, sf_dir, "customer"), spark.read.parquet(path),
                                lambda name: table(spark, sf_dir, name), k=512)
    return out.withColumn("score", F.round("score", 6))


@query("catalog_ingest", f"SELECT {CAT_COLS} FROM ({CATALOG})")
def catalog_ingest(spark, sf_dir):
    return _r6(_catalog(spark, sf_dir))


@query("catalog_clean", f"""
SELECT id, left_column AS left_columns_names, regexp_replace(right_columns_names, '[\\[\\]''"]+', '', 'g')
       AS right_columns_names, left_column AS left_keys FROM ({CATALOG})
""")
def catalog_clean(spark, sf_dir):
    c = clean_key_names(_catalog(spark, sf_dir))
    return c.select("id", "left_columns_names", "right_columns_names", F.array_join("left_keys", "|").alias("left_keys"))


@query("catalog_merge", f"SELECT {CAT_COLS} FROM ({MERGED})")
def catalog_merge(spark, sf_dir):
    return _r6(_merged(spark, sf_dir))


@query("catalog_admit", f"SELECT {CAT_COLS} FROM ({MERGED}) WHERE size BETWEEN 20000 AND 100000000 AND score >= 0.5")
def catalog_admit(spark, sf_dir):
    return _r6(admit(_merged(spark, sf_dir)))


_OLD_NAMES = f"SELECT DISTINCT dataset_name FROM ({CATALOG}) WHERE left_column IN ({', '.join(repr(c) for c in OLD_COLUMNS)})"


@query("catalog_pending", f"SELECT {CAT_COLS} FROM ({MERGED}) WHERE dataset_name NOT IN ({_OLD_NAMES})")
def catalog_pending(spark, sf_dir):
    present = _catalog(spark, sf_dir, OLD_COLUMNS).select("dataset_name")
    return _r6(pending(_merged(spark, sf_dir), present))


@query("catalog_pool", f"SELECT {CAT_COLS} FROM ({MERGED}) WHERE dataset_name IN ({_OLD_NAMES})")
def catalog_pool(spark, sf_dir):
    present = _catalog(spark, sf_dir, OLD_COLUMNS).select("dataset_name")
    return _r6(prune(_merged(spark, sf_dir), present))


@query("next_table", f"""
SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({MERGED})
""")
def next_table_q(spark, sf_dir):
    return _r6(next_table(_merged(spark, sf_dir), "score").select("id", "score", "rank"))


@query("next_table_last", f"""
SELECT id, row_number() OVER (ORDER BY join_key DESC, id) AS rank FROM ({MERGED})
""")
def next_table_last(spark, sf_dir):
    return next_table(_merged(spark, sf_dir)).select("id", "rank")


@query("next_table_size", f"SELECT id, row_number() OVER (ORDER BY size, id) AS rank FROM ({MERGED})")
def next_table_size(spark, sf_dir):
    return next_table(_merged(spark, sf_dir), "size").select("id", "rank")


_TASKS = [("customer", "c_mktsegment"), ("customer", "c_acctbal"), ("labels", "quality"), ("documents", "n_chars")]


@query("registry_lookup", union_all(
    f"SELECT 'customer' AS base_table_name, '{y}' AS target_attribute, CASE WHEN typeof(any_value({y})) = 'VARCHAR' "
    f"OR count(DISTINCT {y}) <= 10 THEN 'classification' ELSE 'regression' END AS description FROM {t}"
    for t, y in _TASKS if t == "customer"))
def registry_lookup(spark, sf_dir):
    reg = None
    for t, y in _TASKS:
        r = infer_task(table(spark, sf_dir, t), y).select(
            F.lit(t).alias("base_table_name"), F.col("target").alias("target_attribute"),
            F.col("task").alias("description"))
        reg = r if reg is None else reg.unionByName(r)
    return lookup_base(reg, "customer")
