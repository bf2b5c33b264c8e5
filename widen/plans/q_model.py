"""Registered queries: model scores and the greedy loop.

Model scores are not SQL-expressible (rows-only checks); the metric
arithmetic they use (M5-M8) is checked exactly in ``q_recommend``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from widen.operators.aggregate import distinct_counts
from widen.operators.boost import fit_boosted, stump_table
from widen.operators.join import augment
from widen.operators.metrics import confusion
from widen.operators.project import drop_null_target
from widen.plans.evaluate import score_boosted, score_rf, score_rf_reg, score_search, select_importance
from widen.plans.loop import METHODS, RECOMMENDED, accept_history, best, compare, method_status, run
from widen.plans.q_select import DOC_SHARES, DOC_SHARES_SQL, document_shares
from widen.plans.registry import query, table
from widen.session import checkpoint_dir
from widen.sources.catalog import find_joinable, ingest_search_results, load_pool, to_search_results
from widen.sources.tables import zip_columns


def _docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return drop_null_target(zip_columns(d, table(spark, sf_dir, "labels"), "doc_id"), "quality").drop("toxic")


def _score_frame(spark, name, s):
    return spark.createDataFrame([(name, s.metric, float(s.value), s.higher_is_better)],
                                 "scorer string, metric string, score double, higher_is_better boolean")


@query("rf_classifier")
def rf_classifier(spark, sf_dir):
    return _score_frame(spark, "rf_classifier", score_rf(_docs(spark, sf_dir), "quality", "doc_id"))


@query("boosted_balanced")
def boosted_balanced(spark, sf_dir):
    return _score_frame(spark, "boosted_balanced", score_boosted(_docs(spark, sf_dir), "quality", "doc_id"))


# -- M2: rounds of the boosted stumps, computed in SQL as well ----------------------

_BINS = 16


def boosted_sql(src: str, target: str, feats, rounds: int, last: str) -> str:
    """CTEs of ``rounds`` rounds of SAMME on binned features, then ``last``."""
    bins = ", ".join(
        f"least({_BINS - 1}, floor(({f} - (SELECT min({f}) FROM s)) / (((SELECT max({f}) FROM s) - (SELECT min({f}) FROM s)) "
        f"/ {_BINS})))::INTEGER AS b{i}" for i, f in enumerate(feats))
    long = " UNION ALL ".join(f"SELECT id, y, {i} AS f, '{f}' AS feature, b{i} AS b FROM bins" for i, f in enumerate(feats))
    out = [f"s AS ({src})", f"bins AS (SELECT row_number() OVER () AS id, {target} AS y, {bins} FROM s WHERE {target} IS NOT NULL)",
           f"l AS ({long})", "k AS (SELECT DISTINCT y FROM bins)", "w1 AS (SELECT id, 1.0::DOUBLE AS w FROM bins)"]
    for t in range(1, rounds + 1):
        share = f"(SELECT sum(w) FROM w{t})"
        out += [
            f"c{t} AS (SELECT f, feature, b, y, sum(w) AS w FROM l JOIN w{t} ON l.id = w{t}.id GROUP BY f, feature, b, y)",
            f"p{t} AS (SELECT g.f, g.feature, g.b, k.y, coalesce(sum(c.w) FILTER (WHERE c.b <= g.b), 0) / {share} AS lw, "
            f"coalesce(sum(c.w) FILTER (WHERE c.b > g.b), 0) / {share} AS rw FROM (SELECT DISTINCT f, feature, b FROM c{t}) g "
            f"CROSS JOIN k LEFT JOIN c{t} c ON c.f = g.f AND c.y = k.y "
            f"WHERE g.b < (SELECT max(b) FROM c{t} m WHERE m.f = g.f) GROUP BY ALL)",
            f"s{t} AS (SELECT f, feature, b, (list(y ORDER BY round(lw, 9) DESC, y))[1] AS low, "
            f"(list(y ORDER BY round(rw, 9) DESC, y))[1] AS high, "
            f"round(1 - (list(lw ORDER BY round(lw, 9) DESC, y))[1] - (list(rw ORDER BY round(rw, 9) DESC, y))[1], 9) AS error "
            f"FROM p{t} GROUP BY f, feature, b)",
            f"h{t} AS (SELECT *, ln((1 - error) / error) + ln((SELECT count(*) FROM k) - 1) AS alpha FROM s{t} "
            f"ORDER BY error, f, b LIMIT 1)",
            f"w{t + 1} AS (SELECT w{t}.id, w * CASE WHEN (CASE WHEN l.b <= h{t}.b THEN low ELSE high END) <> l.y THEN exp(alpha) "
            f"ELSE 1.0 END AS w FROM w{t} JOIN l ON l.id = w{t}.id JOIN h{t} ON l.f = h{t}.f)"]
    sep = "" if last.lstrip().startswith(",") else " "
    return f"WITH {', '.join(out)}{sep}{last.lstrip()}"


@query("boosted_rounds", boosted_sql(DOC_SHARES_SQL, "lang", DOC_SHARES, 3, " UNION ALL ".join(
    f"SELECT {t}::INTEGER AS round, feature, b AS bin, low, high, round(error, 6) AS error, round(alpha, 6) AS alpha FROM h{t}"
    for t in (1, 2, 3))))
def boosted_rounds(spark, sf_dir):
    """The first three stumps that tell documents' languages by letters."""
    model = fit_boosted(document_shares(spark, sf_dir), DOC_SHARES, "lang", rounds=3, bins=_BINS)
    return stump_table(spark, model).withColumn("error", F.round("error", 6)).withColumn("alpha", F.round("alpha", 6))


_VOTES = " UNION ALL ".join(
    f"SELECT l.id, l.y, CASE WHEN l.b <= h{t}.b THEN low ELSE high END AS c, alpha FROM l JOIN h{t} ON l.f = h{t}.f" for t in (1, 2, 3))


@query("boosted_confusion", boosted_sql(DOC_SHARES_SQL, "lang", DOC_SHARES, 3, f"""
, votes AS ({_VOTES}),
sums AS (SELECT v.id, v.y, k.y AS c, round(coalesce(sum(alpha) FILTER (WHERE v.c = k.y), 0), 9) AS a FROM votes v CROSS JOIN k
         GROUP BY v.id, v.y, k.y),
said AS (SELECT id, y, (list(c ORDER BY a DESC, c))[1] AS yhat FROM sums GROUP BY id, y)
SELECT y, yhat, count(*) AS n FROM said GROUP BY y, yhat"""))
def boosted_confusion(spark, sf_dir):
    """What the three stumps say together, against the languages."""
    docs = document_shares(spark, sf_dir)
    model = fit_boosted(docs, DOC_SHARES, "lang", rounds=3, bins=_BINS)
    return confusion(model.predict(docs), "lang", "prediction")


@query("rf_regressor")
def rf_regressor(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    wide = augment(c, table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderpriority", "o_orderstatus"],
                   left_keys="c_custkey", right_keys="o_custkey")
    return _score_frame(spark, "rf_regressor", score_rf_reg(wide, "c_acctbal", "c_custkey"))


@query("model_search")
def model_search(spark, sf_dir):
    return _score_frame(spark, "model_search", score_search(_docs(spark, sf_dir), "quality", "doc_id"))


def _history(spark, sf_dir):
    """A run over the tables that the catalog names, logged round by round in the
    checkpoint folder. The catalog comes from the value search. Each query runs
    the loop itself; none reads another one's log."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    lake = {name: table(spark, sf_dir, name) for name in ("orders", "events", "nation")}
    keys = {"orders": ["o_custkey"], "events": ["user_id"], "nation": ["n_nationkey"]}
    found = find_joinable(base, {n: df.select(*keys[n], *[c for c in df.columns if c not in keys[n] and c not in _KEY_LIKE])
                                 for n, df in lake.items()}, ["c_custkey", "c_nationkey"], min_score=0.0)
    catalog = ingest_search_results(to_search_results(found))
    pool = load_pool(catalog, lake.__getitem__, policy="score")
    wanted = _recommended(spark, [p.table() for p in pool])
    return run(base, "c_mktsegment", "c_custkey", pool, methods=(*METHODS, RECOMMENDED), scorer=score_rf,
               recommendations=wanted, history_path=f"{checkpoint_dir(spark)}/history-{uuid.uuid4().hex}")


# columns of whole numbers and texts that are no keys of the customers
_KEY_LIKE = ("o_orderkey", "o_orderstatus", "o_orderpriority", "event_id", "event_type", "props", "n_name", "n_regionkey")


def _recommended(spark, pool):
    """Recommendations as the reply ingestion gives them, from the tables: the
    columns with few enough values to be told apart by a model."""
    out = None
    for t in pool:
        d = distinct_counts(t.df.select(*t.features()), t.features())
        r = d.select(F.lit(t.name).alias("table"), F.col("column").alias("feature"),
                     (F.col("n_distinct") <= 100).alias("recommended"))
        out = r if out is None else out.unionByName(r)
    return out


@query("augment_run")
def augment_run(spark, sf_dir):
    return _history(spark, sf_dir).drop("timestamp")


@query("method_status")
def method_status_q(spark, sf_dir):
    return method_status(_history(spark, sf_dir))


@query("compare_methods")
def compare_methods(spark, sf_dir):
    return compare(_history(spark, sf_dir)).withColumn("performance_history", F.to_json("performance_history")).withColumn(
        "feature_history", F.to_json("feature_history"))


@query("best_method")
def best_method(spark, sf_dir):
    return best(compare(_history(spark, sf_dir))).drop("performance_history", "feature_history")


# -- G3, G6-G8 on scores that SQL can compute -----------------------------------
# Rounds are the numeric columns of lineitem, a method's score in a round is the
# mean of the column over the lines of one ship mode of return (flag), scaled.

_EVALS = """
SELECT l_returnflag AS method, r AS round, round(x, 6) AS score FROM (
  SELECT l_returnflag, 1 AS r, avg(l_quantity) / 50 AS x FROM lineitem GROUP BY l_returnflag
  UNION ALL SELECT l_returnflag, 2, avg(l_discount) * 10 FROM lineitem GROUP BY l_returnflag
  UNION ALL SELECT l_returnflag, 3, avg(l_tax) * 13 FROM lineitem GROUP BY l_returnflag
  UNION ALL SELECT l_returnflag, 4, avg(l_extendedprice) / 70000 FROM lineitem GROUP BY l_returnflag)"""

_ACCEPT = f"""
SELECT method, round, score, greatest(0.5, coalesce(max(score) OVER (
         PARTITION BY method ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5)) AS current_before
FROM ({_EVALS})"""

_REPORT = f"""
SELECT method, greatest(0.5, coalesce(max(score) FILTER (WHERE score > current_before), 0.5)) AS final_score,
       coalesce(max(round) FILTER (WHERE score > current_before), 0)::INTEGER AS last_round,
       count(*) FILTER (WHERE score > current_before)::INTEGER AS rounds_improved
FROM ({_ACCEPT}) GROUP BY method"""


def _evals(spark, sf_dir):
    rows = [(1, F.avg("l_quantity") / 50), (2, F.avg("l_discount") * 10), (3, F.avg("l_tax") * 13),
            (4, F.avg("l_extendedprice") / 70000)]
    one = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(
        *[c.alias(f"s{r}") for r, c in rows])
    return one.select("method", F.inline(F.array(*[
        F.struct(F.lit(r).alias("round"), F.round(f"s{r}", 6).alias("score")) for r, _ in rows])))


def _accepted(spark, sf_dir):
    """A history as the loop writes it, from the scores above."""
    h = accept_history(_evals(spark, sf_dir), 0.5)
    return (h.withColumn("initial_score", F.lit(0.5)).withColumn("higher_is_better", F.lit(True))
            .withColumn("num_joined", F.col("round")).withColumn("current_features_num", F.col("round")))


@query("accept_history", f"""
SELECT method, round, score, current_before, round(score - current_before, 6) AS improvement,
       score > current_before AS accepted FROM ({_ACCEPT})""")
def accept_history_q(spark, sf_dir):
    return accept_history(_evals(spark, sf_dir), 0.5).withColumn("improvement", F.round("improvement", 6))


@query("status_exact", f"SELECT method, final_score AS score, last_round, last_round AS n_features FROM ({_REPORT})")
def status_exact(spark, sf_dir):
    return method_status(_accepted(spark, sf_dir))


@query("compare_exact", f"""
SELECT method, final_score, round(final_score - 0.5, 6) AS total_improvement, rounds_improved FROM ({_REPORT})""")
def compare_exact(spark, sf_dir):
    return compare(_accepted(spark, sf_dir)).select("method", "final_score", F.round("total_improvement", 6).alias(
        "total_improvement"), "rounds_improved")


@query("best_exact", f"""
SELECT method, final_score FROM ({_REPORT}) ORDER BY final_score DESC, method LIMIT 1""")
def best_exact(spark, sf_dir):
    return best(compare(_accepted(spark, sf_dir))).select("method", "final_score")


@query("select_importance")
def select_importance_q(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    wide = augment(c, table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderpriority", "o_orderstatus"],
                   left_keys="c_custkey", right_keys="o_custkey")
    return select_importance(wide, "c_mktsegment", "c_custkey")
