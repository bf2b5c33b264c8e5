"""Registered queries: feature scores and selection methods."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from widen.operators.join import augment
from widen.operators.score import cramers_v, missing_ratios, mutual_info, pearson
from widen.operators.select import chosen, leak_scan, select_all, select_filter, select_mutual_info, select_random
from widen.operators.wrapper import select_forward
from widen.plans.registry import query, table
from widen.plans.sqlgen import augment_sql, union_all
from widen.sources.tables import TableRef

NUMS = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATS = ["l_returnflag", "l_linestatus", "l_shipdate"]
FEATS = NUMS + CATS  # lineitem column order without the key
KINDS = {**{f: "numeric" for f in NUMS}, "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "temporal"}

WIDE = augment_sql("orders", "o_orderkey", "lineitem", "l_orderkey", NUMS, CATS,
                   base_cols="b.o_orderkey, b.o_orderstatus, b.o_totalprice", round_means=False)


def _lineitem(spark, sf_dir):
    return TableRef("lineitem", table(spark, sf_dir, "lineitem"), ["o_orderkey"], ["l_orderkey"])


def _wide(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return augment(base, _lineitem(spark, sf_dir), FEATS)


def _r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


# -- SQL builders for the contingency-table scores ------------------------------


def bins_sql(src: str, f: str, bins: int = 16, fill_median: bool = True) -> str:
    x = f"coalesce({f}, (SELECT median({f}) FROM {src}))" if fill_median else f
    lo, hi = f"(SELECT min({f}) FROM {src})", f"(SELECT max({f}) FROM {src})"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {hi} = {lo} THEN 0 "
            f"ELSE least(floor(({x} - {lo}) / ({hi} - {lo}) * {bins}), {bins - 1}) END)::BIGINT::VARCHAR")


def cells_sql(src: str, exprs: dict, y: str, drop_nulls: bool) -> str:
    lf = union_all(f"SELECT '{f}' AS feature, {e} AS x, {y} AS y FROM {src}" for f, e in exprs.items())
    where = "WHERE x IS NOT NULL AND y IS NOT NULL" if drop_nulls else ""
    return f"SELECT feature, x, y, count(*) AS o FROM ({lf}) {where} GROUP BY feature, x, y"


def cramers_sql(wide: str, exprs: dict, y: str) -> str:
    return f"""
WITH wide AS ({wide}),
cells AS ({cells_sql('wide', exprs, y, True)}),
r AS (SELECT feature, x, sum(o) AS r FROM cells GROUP BY feature, x),
c AS (SELECT feature, y, sum(o) AS c FROM cells GROUP BY feature, y),
rs AS (SELECT feature, count(*) AS n_rows, sum(r)::DOUBLE AS n, sum(1.0::DOUBLE / r) AS ir FROM r GROUP BY feature),
cs AS (SELECT feature, count(*) AS n_cols, sum(1.0::DOUBLE / c) AS ic FROM c GROUP BY feature),
m AS (SELECT cells.feature, o::DOUBLE AS o, r::DOUBLE AS r, c::DOUBLE AS c, rs.n AS n FROM cells
      JOIN r ON cells.feature = r.feature AND cells.x = r.x
      JOIN c ON cells.feature = c.feature AND cells.y = c.y
      JOIN rs ON cells.feature = rs.feature),
st AS (SELECT feature, sum(o * o / (r * c)) AS s, max(abs(o - r * c / n)) AS d FROM m GROUP BY feature),
k AS (SELECT rs.feature, n, n_rows, n_cols,
             greatest(CASE WHEN n_rows = 2 AND n_cols = 2 THEN (d - least(0.5, d)) * (d - least(0.5, d)) * n * ic * ir
                           ELSE n * (s - 1.0) END, 0.0) AS chi2
      FROM rs JOIN cs ON rs.feature = cs.feature JOIN st ON rs.feature = st.feature)
SELECT feature, n::BIGINT AS n, n_rows, n_cols, round(chi2, 6) AS chi2,
       round(CASE WHEN n_rows < 2 OR n_cols < 2 THEN 0.0
                  ELSE sqrt(chi2 / (n * (least(n_rows, n_cols) - 1))) END, 6) AS cramers_v
FROM k"""


def mi_sql(wide: str, exprs: dict, y: str) -> str:
    return f"""
WITH wide AS ({wide}),
cells AS ({cells_sql('wide', exprs, y, False)}),
r AS (SELECT feature, x, sum(o) AS r FROM cells GROUP BY feature, x),
c AS (SELECT feature, y, sum(o) AS c FROM cells GROUP BY feature, y),
n AS (SELECT feature, sum(r) AS n FROM r GROUP BY feature)
SELECT cells.feature, sum(o::DOUBLE / n.n * ln(o::DOUBLE * n.n / (r.r * c.c))) AS mutual_info
FROM cells JOIN r ON cells.feature = r.feature AND cells.x IS NOT DISTINCT FROM r.x
JOIN c ON cells.feature = c.feature AND cells.y IS NOT DISTINCT FROM c.y
JOIN n ON cells.feature = n.feature GROUP BY cells.feature"""


def _cat(f, token=None):
    return f"coalesce({f}::VARCHAR, '{token}')" if token else f"{f}::VARCHAR"


MI_EXPRS = {**{f: bins_sql("wide", f) for f in NUMS}, **{f: _cat(f, "MISSING") for f in CATS}}
MI_Y = _cat("o_orderstatus", "MISSING")

# -- F1 ----------------------------------------------------------------------------


@query("missing_filter", f"""
WITH wide AS ({WIDE})
{union_all(f"SELECT '{f}' AS feature, round(avg(({f} IS NULL)::INT::DOUBLE), 6) AS missing_ratio, "
           f"avg(({f} IS NULL)::INT::DOUBLE) <= 0.3 AS kept FROM wide" for f in FEATS)}
""")
def missing_filter(spark, sf_dir):
    m = missing_ratios(_wide(spark, sf_dir), FEATS)
    return m.select("feature", F.round("missing_ratio", 6).alias("missing_ratio"),
                    (F.col("missing_ratio") <= 0.3).alias("kept"))


# -- F2 ----------------------------------------------------------------------------


def _pearson_sql(f, y):
    xm = f"CASE WHEN {y} IS NOT NULL THEN {f} END"
    ym = f"CASE WHEN {f} IS NOT NULL THEN {y} END"
    return (f"SELECT '{f}' AS feature, round(covar_pop({xm}, {ym}) / "
            f"nullif(stddev_pop({xm}) * stddev_pop({ym}), 0), 6) AS pearson FROM wide")


@query("pearson", f"WITH wide AS ({WIDE}) " + union_all(_pearson_sql(f, "o_totalprice") for f in NUMS))
def pearson_q(spark, sf_dir):
    return _r6(pearson(_wide(spark, sf_dir), NUMS, "o_totalprice"), "pearson")


# -- F3 ----------------------------------------------------------------------------


@query("cramers_v", cramers_sql(WIDE, {f: _cat(f) for f in CATS}, "o_orderstatus::VARCHAR"))
def cramers_v_q(spark, sf_dir):
    return _r6(cramers_v(_wide(spark, sf_dir), CATS, "o_orderstatus"), "chi2", "cramers_v")


@query("cramers_v_2x2", cramers_sql("SELECT * FROM labels", {"toxic": _cat("toxic")}, "quality::VARCHAR"))
def cramers_v_2x2(spark, sf_dir):
    return _r6(cramers_v(table(spark, sf_dir, "labels"), ["toxic"], "quality"), "chi2", "cramers_v")


@query("cramers_v_binned", cramers_sql(WIDE, {f: bins_sql("wide", f, fill_median=False) for f in NUMS},
                                       "o_orderstatus::VARCHAR"))
def cramers_v_binned(spark, sf_dir):
    return _r6(cramers_v(_wide(spark, sf_dir), NUMS, "o_orderstatus", numeric="bin"), "chi2", "cramers_v")


# -- F4 ----------------------------------------------------------------------------

_POS_SQL = "CASE feature " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(FEATS)) + " END"
_KIND_SQL = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{KINDS[f]}'" for f in FEATS) + " END"
_MISS_SQL = union_all(f"SELECT '{f}' AS feature, avg(({f} IS NULL)::INT::DOUBLE) AS missing_ratio FROM wide"
                      for f in FEATS)


@query("filter_select", f"""
WITH v AS ({cramers_sql(WIDE, {f: _cat(f) for f in CATS}, "o_orderstatus::VARCHAR")}),
wide AS ({WIDE}),
miss AS ({_MISS_SQL}),
sc AS (SELECT feature, 'cramers_v' AS measure, cramers_v AS score FROM v
       UNION ALL {union_all(f"SELECT '{f}', 'none', 0.0" for f in NUMS)})
SELECT {_POS_SQL} AS pos, feature, {_KIND_SQL} AS kind, round(missing_ratio, 6) AS missing_ratio, measure,
       round(score, 6) AS score, false AS duplicate_name, (missing_ratio <= 0.3 AND abs(score) >= 0.1) AS selected
FROM (SELECT miss.feature, missing_ratio, measure, score FROM miss JOIN sc ON miss.feature = sc.feature)
""")
def filter_select(spark, sf_dir):
    base = table(spark, sf_dir, "orders")
    out = select_filter(base, _lineitem(spark, sf_dir), "o_orderstatus")
    return _r6(out, "missing_ratio", "score")


# -- F5 / F6 -------------------------------------------------------------------


@query("mutual_info", f"SELECT feature, round(mutual_info, 6) AS mutual_info FROM ({mi_sql(WIDE, MI_EXPRS, MI_Y)})")
def mutual_info_q(spark, sf_dir):
    return _r6(mutual_info(_wide(spark, sf_dir), FEATS, "o_orderstatus", "classification"), "mutual_info")


@query("mi_topk", f"""
SELECT {_POS_SQL} AS pos, feature, round(mutual_info, 6) AS mutual_info,
       row_number() OVER (ORDER BY mutual_info DESC, feature) <= {len(FEATS) // 2} AS selected
FROM ({mi_sql(WIDE, MI_EXPRS, MI_Y)})
""")
def mi_topk(spark, sf_dir):
    out = select_mutual_info(table(spark, sf_dir, "orders"), _lineitem(spark, sf_dir), "o_orderstatus")
    return _r6(out, "mutual_info")


# -- F7 / F8 -------------------------------------------------------------------

# -- F7, F8: the chosen features are joined; the base keeps its rows ------------

_RANDOM = sorted(sorted(FEATS, key=lambda f: (hashlib.md5(f"42:{f}".encode()).hexdigest(), f))[:len(FEATS) // 2],
                 key=FEATS.index)


def _widened(spark, sf_dir, selection):
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    names = chosen(selection)
    return _r6(augment(base, _lineitem(spark, sf_dir), names), *[f for f in names if f in NUMS])


@query("select_all", augment_sql("orders", "o_orderkey", "lineitem", "l_orderkey", NUMS, CATS,
                                 base_cols="b.o_orderkey, b.o_orderstatus"))
def select_all_q(spark, sf_dir):
    return _widened(spark, sf_dir, select_all(_lineitem(spark, sf_dir)))


@query("select_random", augment_sql("orders", "o_orderkey", "lineitem", "l_orderkey", [f for f in _RANDOM if f in NUMS],
                                    [f for f in _RANDOM if f in CATS], base_cols="b.o_orderkey, b.o_orderstatus"))
def select_random_q(spark, sf_dir):
    return _widened(spark, sf_dir, select_random(_lineitem(spark, sf_dir), seed=42))


# -- F5: infinities count as 0 ---------------------------------------------------

_INF = "SELECT c_mktsegment, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS x FROM customer"


@query("mutual_info_inf", "SELECT feature, round(mutual_info, 6) AS mutual_info FROM ("
       + mi_sql(_INF, {"x": bins_sql("wide", "x")}, "coalesce(c_mktsegment, 'MISSING')") + ")")
def mutual_info_inf(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        "c_mktsegment", F.when(F.col("c_acctbal") < 0, float("inf")).otherwise(F.col("c_acctbal")).alias("x"))
    return _r6(mutual_info(c, ["x"], "c_mktsegment"), "mutual_info")


# -- J7 -------------------------------------------------------------------------

_LEAK_EXPRS = {**{f: bins_sql("wide", f, fill_median=False) for f in NUMS}, **{f: _cat(f) for f in CATS}}


@query("leak_scan", f"""
SELECT feature, 'cramers_v' AS measure, cramers_v AS score, cramers_v >= 0.5 AS flagged
FROM ({cramers_sql(WIDE, _LEAK_EXPRS, "o_orderstatus::VARCHAR")})
""")
def leak_scan_q(spark, sf_dir):
    out = leak_scan(table(spark, sf_dir, "orders"), _lineitem(spark, sf_dir), "o_orderstatus")
    return out.withColumn("score", F.round("score", 6)).withColumn("flagged", F.col("score") >= 0.5)

# -- F11: forward selection by the held-out error of least squares ---------------
# The first two picks in closed form: slopes from variances and covariances of the
# training rows, errors summed over the held-out rows (and over classes).


def forward_sql(wide: str, key: str, target: str, feats, by_class: bool) -> str:
    filled = ", ".join(f"coalesce({f}, (SELECT median({f}) FROM wide)) AS {f}" for f in feats)
    y = (f"SELECT w.k, w.is_test, c.c, (w.t = c.c)::INT::DOUBLE AS y FROM w, (SELECT DISTINCT t AS c FROM w) c" if by_class
         else "SELECT k, is_test, 0 AS c, t::DOUBLE AS y FROM w")
    return f"""
WITH wide AS ({wide}),
w AS (SELECT {key} AS k, {target} AS t, {filled},
             (('0x' || substr(md5('1:' || {key}::VARCHAR), 1, 8))::BIGINT % 100) < 33 AS is_test
      FROM wide WHERE {target} IS NOT NULL),
l AS ({union_all(f"SELECT k, '{f}' AS feature, {f}::DOUBLE AS x FROM w" for f in feats)}),
y AS ({y}),
my AS (SELECT c, avg(y) AS m FROM y WHERE NOT is_test GROUP BY c),
base AS (SELECT sum((y.y - my.m) * (y.y - my.m)) AS e FROM y JOIN my ON y.c = my.c WHERE y.is_test),
s1 AS (SELECT c, feature, covar_pop(y, x) / var_pop(x) AS b, avg(x) AS mx, avg(y) AS m
       FROM y JOIN l ON y.k = l.k WHERE NOT is_test GROUP BY c, feature HAVING var_pop(x) > 0),
e1 AS (SELECT l.feature, 1 - sum((y - m - b * (x - mx)) * (y - m - b * (x - mx))) / (SELECT e FROM base) AS score
       FROM y JOIN l ON y.k = l.k JOIN s1 ON s1.c = y.c AND s1.feature = l.feature WHERE is_test GROUP BY l.feature),
p1 AS (SELECT feature, score FROM e1 ORDER BY score DESC, feature LIMIT 1),
z AS (SELECT y.*, a.x AS x1, l.feature, l.x AS x2 FROM y JOIN l a ON a.k = y.k AND a.feature = (SELECT feature FROM p1)
      JOIN l ON l.k = y.k AND l.feature <> a.feature),
s2 AS (SELECT c, feature, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS m, var_pop(x1) AS v1, var_pop(x2) AS v2,
              covar_pop(x1, x2) AS v12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2
       FROM z WHERE NOT is_test GROUP BY c, feature),
b2 AS (SELECT *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS b1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS b2
       FROM s2 WHERE v1 * v2 - v12 * v12 > 1e-9 * v1 * v2),
r2 AS (SELECT z.feature, y - m - b1 * (x1 - m1) - b2 * (x2 - m2) AS r FROM z
       JOIN b2 ON b2.c = z.c AND b2.feature = z.feature WHERE is_test),
e2 AS (SELECT feature, 1 - sum(r * r) / (SELECT e FROM base) AS score FROM r2 GROUP BY feature),
p2 AS (SELECT feature, score FROM e2 ORDER BY score DESC, feature LIMIT 1)
SELECT 1::INTEGER AS step, 'pick' AS action, feature, round(score, 6) AS score, round(score, 6) AS gain FROM p1 WHERE score > 0
UNION ALL
SELECT 2, 'pick', p2.feature, round(p2.score, 6), round(p2.score - p1.score, 6) FROM p2, p1 WHERE p2.score > p1.score AND p1.score > 0"""


@query("select_forward", forward_sql(WIDE, "o_orderkey", "o_totalprice", NUMS, False))
def select_forward_q(spark, sf_dir):
    wide = _wide(spark, sf_dir).drop("o_orderstatus")
    return _r6(select_forward(wide, "o_totalprice", "o_orderkey", "regression", NUMS, k=2), "score", "gain")


_LETTERS = "aehos"
DOC_SHARES_SQL = ("SELECT doc_id, lang, n_chars, " + ", ".join(
    f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE / greatest(length(text), 1) AS share_{c}" for c in _LETTERS)
    + " FROM documents")
DOC_SHARES = ["n_chars", *(f"share_{c}" for c in _LETTERS)]


def document_shares(spark, sf_dir):
    """Documents by their length and shares of letters."""
    shares = [((F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("double")
               / F.greatest(F.length("text"), F.lit(1))).alias(f"share_{c}") for c in _LETTERS]
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", *shares)


@query("select_forward_class", forward_sql(DOC_SHARES_SQL, "doc_id", "lang", DOC_SHARES, True))
def select_forward_class(spark, sf_dir):
    """Classes: documents by language."""
    return _r6(select_forward(document_shares(spark, sf_dir), "lang", "doc_id", "classification", DOC_SHARES, k=2),
               "score", "gain")
