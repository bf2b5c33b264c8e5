"""Registered queries: joins, reduction, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from widen.operators.join import augment, fanout, key_overlap, left_join, left_join_m1, project, reduce_by_key
from widen.operators.prep import target_int
from widen.operators.project import (
    drop_columns,
    drop_leaky,
    drop_leaky_tables,
    drop_null_target,
    filter_equals,
    sample_rows,
)
from widen.plans.registry import query, table
from widen.plans.sqlgen import augment_sql, union_all
from widen.sources.catalog import register_base
from widen.sources.tables import TableRef, zip_columns


def _round(df, cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


# -- J3 flagship: customer widened with order features ----------------------

ORDER_NUMS = ["o_totalprice"]
ORDER_CATS = ["o_orderpriority", "o_orderstatus"]


def augment_orders_df(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    out = augment(customer, orders, ORDER_NUMS + ORDER_CATS, left_keys="c_custkey", right_keys="o_custkey")
    return _round(out, ORDER_NUMS)


query("augment_orders", augment_sql("customer", "c_custkey", "orders", "o_custkey",
                                    ORDER_NUMS, ORDER_CATS))(augment_orders_df)

# -- J3: orders widened with line items (mixed numeric / text / timestamp) ---

LINE_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
LINE_CATS = ["l_returnflag", "l_linestatus", "l_shipdate"]


@query("augment_lineitem", augment_sql("orders", "o_orderkey", "lineitem", "l_orderkey", LINE_NUMS, LINE_CATS))
def augment_lineitem(spark, sf_dir):
    out = augment(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), LINE_NUMS + LINE_CATS,
                  left_keys="o_orderkey", right_keys="l_orderkey")
    return _round(out, LINE_NUMS)


# -- J3: customer widened with events (90 % of customers get nulls) ----------

EVENT_NUMS = ["value"]
EVENT_CATS = ["event_type", "props", "ts"]


@query("augment_events", augment_sql("customer", "c_custkey", "events", "user_id", EVENT_NUMS, EVENT_CATS))
def augment_events(spark, sf_dir):
    t = TableRef("events", table(spark, sf_dir, "events"), ["c_custkey"], ["user_id"])
    out = augment(table(spark, sf_dir, "customer"), t, EVENT_NUMS + EVENT_CATS)
    return _round(out, EVENT_NUMS)


# -- J3: a text key against a number key; twins of a key differ in padding -----


@query("augment_mixed_keys", augment_sql("customer", "c_custkey", "orders", "o_custkey", ORDER_NUMS, ORDER_CATS))
def augment_mixed_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey").cast("string")
    o = o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.lpad(k, 12, "0")).otherwise(F.concat(F.lit(" "), k)))
    out = augment(table(spark, sf_dir, "customer"), o, ORDER_NUMS + ORDER_CATS, left_keys="c_custkey", right_keys="o_custkey")
    return _round(out, ORDER_NUMS)


# -- J3: null keys that match; nine in ten base rows have one ------------------


@query("augment_null_keys", """
WITH e AS (SELECT user_id, min(event_type) AS k FROM events GROUP BY user_id),
b AS (SELECT c_custkey, e.k AS k FROM customer LEFT JOIN e ON c_custkey = user_id),
r AS (SELECT e.k AS k, o_totalprice, o_orderpriority FROM orders LEFT JOIN e ON o_custkey = user_id),
a AS (SELECT k, avg(o_totalprice) AS m FROM r GROUP BY k),
p AS (SELECT k, arg_min(v, (-n, v)) AS v FROM (
        SELECT k, o_orderpriority AS v, count(*) AS n FROM r GROUP BY k, o_orderpriority) GROUP BY k)
SELECT b.c_custkey, b.k, round(a.m, 6) AS o_totalprice, p.v AS o_orderpriority
FROM b LEFT JOIN a ON b.k IS NOT DISTINCT FROM a.k LEFT JOIN p ON b.k IS NOT DISTINCT FROM p.k
""")
def augment_null_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_type").alias("k"))
    base = left_join(table(spark, sf_dir, "customer").select("c_custkey"), e, "c_custkey", "user_id")
    right = left_join(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderpriority"), e,
                      "o_custkey", "user_id").withColumnRenamed("k", "rk")
    out = augment(base, right, ["o_totalprice", "o_orderpriority"], left_keys="k", right_keys="rk", null_keys="match")
    return _round(out, ["o_totalprice"])


# -- A1: NaN is undefined, so it counts as null --------------------------------


@query("reduce_nan", """
SELECT user_id, round(avg(CASE WHEN value > 50 THEN NULL ELSE value END), 6) AS x,
       count(*) FILTER (WHERE value > 50) = count(*) AS undefined
FROM events WHERE user_id IS NOT NULL GROUP BY user_id
""")
def reduce_nan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "user_id", F.when(F.col("value") > 50, float("nan")).otherwise(F.col("value")).alias("x"))
    return reduce_by_key(e, "user_id", ["x"]).select("user_id", F.round("x", 6).alias("x"), F.col("x").isNull().alias("undefined"))


# -- J1: unique right side, plain row-preserving join -------------------------


@query("join_m1_nation", """
SELECT c.*, n.n_name, n.n_regionkey FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
""")
def join_m1_nation(spark, sf_dir):
    return left_join_m1(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"),
                        "c_nationkey", "n_nationkey")


# -- J2: fan-out per (table, key) ---------------------------------------------

FANOUT = [("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("events", "user_id"),
          ("nation", "n_nationkey"), ("customer", "c_custkey")]


def _fanout_sql(t, k):
    return (f"SELECT '{t}' AS table_name, '{k}' AS key_name, count(*) AS n_keys, "
            f"count(*) FILTER (WHERE n > 1) AS n_dup_keys, coalesce(max(n), 0)::BIGINT AS max_rows_per_key "
            f"FROM (SELECT {k}, count(*) AS n FROM {t} WHERE {k} IS NOT NULL GROUP BY {k})")


@query("fanout_keys", union_all(_fanout_sql(t, k) for t, k in FANOUT))
def fanout_keys(spark, sf_dir):
    out = None
    for t, k in FANOUT:
        f = fanout(table(spark, sf_dir, t), k).select(F.lit(t).alias("table_name"), F.lit(k).alias("key_name"), "*")
        out = f if out is None else out.unionByName(f)
    return out


# -- J4: fan-out left join ----------------------------------------------------


@query("left_join_fanout", """
SELECT c.*, o.o_orderkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
""")
def left_join_fanout(spark, sf_dir):
    return left_join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


# -- J5: key overlap ----------------------------------------------------------


@query("key_overlap", """
SELECT count(*) AS n_rows, count(e.k) AS n_matched, round(count(e.k)::DOUBLE / count(*), 6) AS overlap
FROM customer c LEFT JOIN (SELECT DISTINCT user_id AS k FROM events WHERE user_id IS NOT NULL) e ON c.c_custkey = e.k
""")
def key_overlap_q(spark, sf_dir):
    out = key_overlap(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "events"), "user_id")
    return out.withColumn("overlap", F.round("overlap", 6))


# -- P1, P5, P6, P8, C13 ------------------------------------------------------


@query("feature_project", "SELECT p_partkey, p_name, p_size FROM part")
def feature_project(spark, sf_dir):
    t = TableRef("part", table(spark, sf_dir, "part"), ["p_partkey"], ["p_partkey"])
    # an unknown name ("p_color") falls out, the key is always kept
    return project(t, ["p_name", "p_size", "p_color"])


@query("drop_leaky", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def drop_leaky_q(spark, sf_dir):
    return drop_leaky(table(spark, sf_dir, "orders"), "date")


@query("head_sample", """
SELECT row_number() OVER (ORDER BY n_nationkey) AS rank,
       to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})::VARCHAR AS row_json
FROM nation ORDER BY n_nationkey LIMIT 3
""")
def head_sample(spark, sf_dir):
    return sample_rows(table(spark, sf_dir, "nation"), "n_nationkey", 3)


@query("head_sample_orders", """
SELECT row_number() OVER (ORDER BY o_orderkey) AS rank,
       to_json({'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus,
                'o_totalprice': o_totalprice, 'o_orderpriority': o_orderpriority})::VARCHAR AS row_json
FROM orders ORDER BY o_orderkey LIMIT 3
""")
def head_sample_orders(spark, sf_dir):
    # the same sample of a table that grows
    return sample_rows(table(spark, sf_dir, "orders").drop("o_orderdate"), "o_orderkey", 3)


@query("drop_null_target", """
SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL
""")
def drop_null_target_q(spark, sf_dir):
    joined = zip_columns(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    return drop_null_target(joined, "quality")


@query("zip_columns", "SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def zip_columns_q(spark, sf_dir):
    return zip_columns(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


# -- P2: columns whose name the base has stay the base's ------------------------


@query("augment_collisions", """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, round(l.q, 6) AS l_quantity
FROM orders o LEFT JOIN (SELECT l_orderkey, avg(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) l
  ON o.o_orderkey = l.l_orderkey
""")
def augment_collisions(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    right = table(spark, sf_dir, "lineitem").withColumnRenamed("l_extendedprice", "O_TOTALPRICE")
    return _round(augment(base, right, ["O_TOTALPRICE", "l_quantity"], "o_orderkey", "l_orderkey"), ["l_quantity"])


# -- P4, P5 over a pool, P7, E6, C12 --------------------------------------------


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def drop_columns_q(spark, sf_dir):
    return drop_columns(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderdate", "not a column"])


@query("drop_leaky_pool", """
SELECT 'orders' AS name, count(*) AS n, sum(o_custkey)::BIGINT AS keys, 5::BIGINT AS n_columns FROM orders
UNION ALL SELECT 'events', count(*), sum(user_id)::BIGINT, 6 FROM events
""")
def drop_leaky_pool(spark, sf_dir):
    pool = [TableRef("orders", table(spark, sf_dir, "orders"), ["c_custkey"], ["o_custkey"]),
            TableRef("events", table(spark, sf_dir, "events"), ["c_custkey"], ["user_id"])]
    out = None
    for t in drop_leaky_tables(pool, "total"):
        r = t.df.agg(F.lit(t.name).alias("name"), F.count("*").alias("n"), F.sum(t.right_keys[0]).alias("keys")).withColumn(
            "n_columns", F.lit(len(t.df.columns)).cast("bigint"))
        out = r if out is None else out.unionByName(r)
    return out


@query("filter_equals", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
""")
def filter_equals_q(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return filter_equals(filter_equals(o, "o_orderstatus", "O"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("target_int", """
SELECT d.doc_id, l.quality::INTEGER AS quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL
""")
def target_int_q(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    l = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return target_int(left_join(d, l.withColumnRenamed("doc_id", "k"), "doc_id", "k"), "quality")


@query("registry_append", """
SELECT 'orders' AS base_table_name, o_orderstatus AS target_attribute, count(*) AS n FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'lineitem', l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag
""")
def registry_append(spark, sf_dir):
    def rows(t, c):
        return table(spark, sf_dir, t).groupBy(F.lit(t).alias("base_table_name"), F.col(c).alias("target_attribute")).agg(
            F.count("*").alias("n"))

    return register_base(rows("orders", "o_orderstatus"),
                         rows("lineitem", "l_returnflag").select("n", "target_attribute", "base_table_name"))
