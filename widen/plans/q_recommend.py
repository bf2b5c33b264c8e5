"""Registered queries: recommendation tables (R1-R4, F9, F10) and metrics (M5-M8).

Reply tables are derived from the data: a deterministic recommender reads the
candidate profiles and answers in the reply formats (JSON, fenced or bare;
relevance verdicts; column descriptions); assistant turns of
``conversations`` are ingested as verdict and description texts too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from widen.operators.join import key_overlap
from widen.operators.metrics import binary_f1, confusion, macro_f1, mae
from widen.operators.profile import profile
from widen.operators.recommend import (
    ASKS,
    ingest_descriptions,
    ingest_replies,
    ingest_summaries,
    ingest_verdicts,
    prompt_frame,
    prompt_kinds,
    sample_lines,
)
from widen.operators.select import gate_tables, select_recommended
from widen.plans.registry import query, table
from widen.plans.sqlgen import union_all
from widen.sources.tables import TableRef

BASE, TARGET, TASK = "customer", "c_mktsegment", "classification"
SCHEMAS = {
    "customer": [("c_custkey", "bigint", "num"), ("c_name", "string", "txt"), ("c_nationkey", "int", "num"),
                 ("c_acctbal", "double", "num"), ("c_mktsegment", "string", "txt")],
    "orders": [("o_orderkey", "bigint", "num"), ("o_custkey", "bigint", "num"), ("o_orderstatus", "string", "txt"),
               ("o_totalprice", "double", "num"), ("o_orderdate", "timestamp_ntz", "txt"),
               ("o_orderpriority", "string", "txt")],
    "events": [("event_id", "bigint", "num"), ("ts", "timestamp_ntz", "txt"), ("user_id", "bigint", "num"),
               ("event_type", "string", "txt"), ("value", "double", "num"), ("props", "string", "txt")],
    "nation": [("n_nationkey", "int", "num"), ("n_name", "string", "txt"), ("n_regionkey", "int", "num")],
}
POOL = ["orders", "events", "nation"]
KEYS = {"orders": ("c_custkey", "o_custkey"), "events": ("c_custkey", "user_id"), "nation": ("c_nationkey", "n_nationkey")}


def _profiles(spark, sf_dir):
    out = None
    for t, cols in SCHEMAS.items():
        df = table(spark, sf_dir, t).select(*[c for c, _, _ in cols])
        p = profile(df).withColumn("table", F.lit(t))
        out = p if out is None else out.unionByName(p)
    return out


def _profile_sql() -> str:
    parts = []
    for t, cols in SCHEMAS.items():
        for i, (c, dt, kind) in enumerate(cols):
            if kind == "num":
                parts.append(f"SELECT '{t}' AS tbl, {i} AS pos, '{c}' AS col, '{dt}' AS dtype, "
                             f"min({c})::DECIMAL(38,4)::VARCHAR AS mn, max({c})::DECIMAL(38,4)::VARCHAR AS mx, "
                             f"NULL::BIGINT AS uc, NULL::VARCHAR AS ex FROM {t}")
            else:
                parts.append(
                    f"SELECT '{t}', {i}, '{c}', '{dt}', NULL, NULL, (SELECT count(DISTINCT {c}) FROM {t}), "
                    f"(SELECT string_agg(v, ' | ' ORDER BY rk) FROM (SELECT v, row_number() OVER (ORDER BY n DESC, v) "
                    f"AS rk FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)) "
                    f"WHERE rk <= 3)")
    return union_all(parts)


PROFILE = _profile_sql()
LINES = f"""SELECT tbl, pos, col, dtype, uc, CASE WHEN uc IS NULL THEN printf('%s (%s): min %s, max %s', col, dtype, mn, mx)
       ELSE printf('%s (%s): %s distinct, e.g. %s', col, dtype, uc::VARCHAR, ex) END AS line FROM ({PROFILE})"""


# -- R1 -------------------------------------------------------------------------


@query("prompt_frame", f"""
WITH txt AS (SELECT tbl, string_agg(line, chr(10) ORDER BY pos) AS text FROM ({LINES}) GROUP BY tbl)
SELECT c.tbl AS "table", 'features' AS kind,
       'Base table {BASE}; target {TARGET} ({TASK}).' || chr(10) || b.text || chr(10) || 'Candidate table ' || c.tbl
       || ':' || chr(10) || c.text || chr(10)
       || 'Answer in JSON with feature_scores, feature_ranking and recommended_features.' AS prompt
FROM txt c, (SELECT text FROM txt WHERE tbl = '{BASE}') b WHERE c.tbl <> '{BASE}'
""")
def prompt_frame_q(spark, sf_dir):
    return prompt_frame(_profiles(spark, sf_dir), BASE, TARGET, TASK)


_ASK_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '" + v.replace("\n", "' || chr(10) || '") + "'" for k, v in ASKS.items()) + " END"
_SAMPLE_COLS = {"customer": ["c_custkey", "c_name"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
                "nation": ["n_nationkey", "n_name"]}
_SAMPLE_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, (SELECT string_agg(line, chr(10) ORDER BY k) FROM (SELECT {cols[0]} AS k, "
    + " || '; ' || ".join(f"'{c}=' || coalesce({c}::VARCHAR, '')" for c in cols)
    + f" AS line FROM {t} ORDER BY {cols[0]} LIMIT 2)) AS sample" for t, cols in _SAMPLE_COLS.items())
_DESCRIBED = ["customer", "orders"]


@query("prompt_kinds", f"""
WITH d AS ({' UNION ALL '.join(f"SELECT '{t}' AS tbl, count(*)::VARCHAR || ' rows' AS description FROM {t}" for t in _DESCRIBED)}),
s AS ({_SAMPLE_SQL}),
t AS (SELECT tbl, string_agg(line, chr(10) ORDER BY pos) AS text FROM ({LINES}) GROUP BY tbl),
a AS (SELECT t.tbl, coalesce('Name: ' || t.tbl || chr(10) || 'Description: ' || d.description || chr(10), '') AS about, text, sample
      FROM t LEFT JOIN d ON t.tbl = d.tbl LEFT JOIN s ON t.tbl = s.tbl),
k AS (SELECT unnest({list(ASKS)}) AS kind),
x AS (SELECT tbl, kind, about || CASE WHEN kind = 'samples' THEN sample ELSE text END AS text FROM a, k)
SELECT x.tbl AS "table", x.kind, 'Base table {BASE}; target {TARGET} ({TASK}).' || chr(10) || b.text || chr(10)
       || 'Candidate table ' || x.tbl || ':' || chr(10) || x.text || chr(10) || {_ASK_SQL.replace('kind', 'x.kind', 1)} AS prompt
FROM x JOIN x b ON b.kind = x.kind AND b.tbl = '{BASE}' WHERE x.tbl <> '{BASE}' AND x.text IS NOT NULL
""")
def prompt_kinds_q(spark, sf_dir):
    """All five kinds; customer and orders are described, nation is sampled too."""
    described = sampled = None
    for t in _DESCRIBED:
        d = table(spark, sf_dir, t).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" rows")).alias("description"))
        d = d.select(F.lit(t).alias("table"), "description")
        described = d if described is None else described.unionByName(d)
    for t, cols in _SAMPLE_COLS.items():
        x = sample_lines(table(spark, sf_dir, t).select(*cols), cols[0], 2).select(F.lit(t).alias("table"), "sample")
        sampled = x if sampled is None else sampled.unionByName(x)
    return prompt_kinds(_profiles(spark, sf_dir), BASE, TARGET, TASK, descriptions=described, samples=sampled)


@query("ingest_summaries", """
WITH l AS (SELECT doc_id::VARCHAR AS tbl, generate_subscripts(string_split(text, chr(10)), 1) AS n,
                  unnest(string_split(text, chr(10))) AS line FROM documents),
r AS (SELECT * FROM l WHERE NOT (contains(line, ':') AND contains(line, '('))),
f AS (SELECT tbl, min(n) AS first FROM r WHERE starts_with(line, 'The ') OR starts_with(line, 'Der ') GROUP BY tbl)
SELECT r.tbl AS "table", string_agg(line, chr(10) ORDER BY n) || chr(10) AS summary
FROM r JOIN f ON r.tbl = f.tbl AND n >= first GROUP BY r.tbl
""")
def ingest_summaries_q(spark, sf_dir):
    """Documents as replies whose summary begins with an article."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("table"), F.col("text").alias("reply"))
    return ingest_summaries(d, prefixes=("The ", "Der "))


# -- R2: replies from a deterministic profile-driven recommender ----------------


def _replies(spark, sf_dir):
    """One JSON reply per candidate table: every column ranked by position,
    scored 1/(pos+1), recommended when numeric or with at most 10 values.
    Tables with an even column count answer inside a fenced block."""
    p = _profiles(spark, sf_dir).filter(F.col("table") != BASE)
    rec = F.col("unique_count").isNull() | (F.col("unique_count") <= 10)
    per = p.groupBy("table").agg(
        F.sort_array(F.collect_list(F.struct("pos", "column", rec.alias("rec")))).alias("c"))
    body = F.to_json(F.struct(
        F.map_from_arrays(F.col("c.column"), F.transform("c.pos", lambda x: F.round(1.0 / (x + 1), 4)))
        .alias("feature_scores"),
        F.col("c.column").alias("feature_ranking"),
        F.transform(F.filter("c", lambda s: s["rec"]), lambda s: s["column"]).alias("recommended_features")))
    fenced = F.size("c") % 2 == 0
    reply = F.when(fenced, F.concat(F.lit("Here is my answer:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    return per.select("table", reply.alias("reply"))


REC_SQL = f"""SELECT tbl AS "table", col AS feature, round(1.0 / (pos + 1), 4) AS score, (pos + 1) AS rank,
       (uc IS NULL OR uc <= 10) AS recommended FROM ({PROFILE}) WHERE tbl <> '{BASE}'"""


@query("ingest_replies", REC_SQL)
def ingest_replies_q(spark, sf_dir):
    good, _ = ingest_replies(_replies(spark, sf_dir))
    return good


# -- R3: verdicts ---------------------------------------------------------------


def _verdict_texts(spark, sf_dir):
    base = table(spark, sf_dir, BASE)
    out = None
    for t in POOL:
        lk, rk = KEYS[t]
        o = key_overlap(base, lk, table(spark, sf_dir, t), rk).select(
            F.lit(t).alias("table"),
            F.concat(F.lit("Table Analysis: "), F.format_string("%.4f", "overlap"), F.lit(" of base keys found\n"),
                     F.lit("Conclusion: "), F.when(F.col("overlap") >= 0.5, "yes").otherwise("NO")).alias("reply"))
        out = o if out is None else out.unionByName(o)
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select(
        F.concat(F.lit("conv"), F.col("conv_id"), F.lit(":"), F.col("turn")).alias("table"), F.col("text").alias("reply"))
    return out.unionByName(conv)


def _verdict_sql():
    parts = []
    for t in POOL:
        lk, rk = KEYS[t]
        ov = (f"(SELECT count(e.k)::DOUBLE / count(*) FROM {BASE} c LEFT JOIN (SELECT DISTINCT {rk} AS k FROM {t} "
              f"WHERE {rk} IS NOT NULL) e ON c.{lk} = e.k)")
        parts.append(f"SELECT '{t}' AS \"table\", printf('%.4f', {ov}) || ' of base keys found' AS analysis, "
                     f"CASE WHEN {ov} >= 0.5 THEN 'Yes' ELSE 'No' END AS conclusion")
    conc = "regexp_extract_all(text, '(?m)^[ \\t]*Conclusion:[ \\t]*(.*?)[ \\t]*$', 1)"
    ana = "regexp_extract_all(text, '(?m)^[ \\t]*Table Analysis:[ \\t]*(.*?)[ \\t]*$', 1)"
    parts.append(f"SELECT 'conv' || conv_id || ':' || turn, {ana}[1], CASE WHEN lower({conc}[-1]) = 'yes' THEN 'Yes' "
                 f"ELSE 'No' END FROM conversations WHERE role = 'assistant'")
    return union_all(parts)


VERDICTS = _verdict_sql()


@query("ingest_verdicts", VERDICTS)
def ingest_verdicts_q(spark, sf_dir):
    return ingest_verdicts(_verdict_texts(spark, sf_dir))


# -- R4: column descriptions ----------------------------------------------------


def _description_texts(spark, sf_dir):
    p = _profiles(spark, sf_dir).filter(F.col("table") != BASE)
    line = F.when(F.col("unique_count").isNull(),
                  F.format_string("%s: (%s) - from %s to %s", "column", "dtype", F.col("min").cast("string"),
                                  F.col("max").cast("string"))
                  ).otherwise(F.format_string("%s: (%s) - %s distinct values", "column", "dtype",
                                              F.col("unique_count").cast("string")))
    per = p.groupBy("table").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("l")))).alias("ls"))
    text = F.concat(F.lit("Columns of "), F.col("table"), F.lit("\n"), F.array_join(F.col("ls.l"), "\n"),
                    F.lit("\nSummary: a table of "), F.size("ls").cast("string"), F.lit(" columns"))
    derived = per.select("table", text.alias("reply"))
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select(
        F.concat(F.lit("conv"), F.col("conv_id"), F.lit(":"), F.col("turn")).alias("table"), F.col("text").alias("reply"))
    return derived.unionByName(conv)


@query("ingest_descriptions", f"""
SELECT tbl AS "table", (pos + 1)::BIGINT AS line_no, col AS column,
       CASE WHEN uc IS NULL THEN printf('(%s) - from %s to %s', dtype, mn, mx)
            ELSE printf('(%s) - %s distinct values', dtype, uc::VARCHAR) END AS description
FROM ({PROFILE}) WHERE tbl <> '{BASE}'
UNION ALL
SELECT "table", line_no, trim(split_part(line, ':', 1)), trim(substr(line, instr(line, ':') + 1)) FROM (
  SELECT 'conv' || conv_id || ':' || turn AS "table", unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10)))))::BIGINT AS line_no
  FROM conversations WHERE role = 'assistant')
WHERE contains(line, ':') AND contains(line, '(')
""")
def ingest_descriptions_q(spark, sf_dir):
    return ingest_descriptions(_description_texts(spark, sf_dir))


# -- F9 / F10 ---------------------------------------------------------------------


@query("select_recommended", f"""
SELECT CASE WHEN pos > 1 THEN pos - 1 ELSE pos END AS pos, col AS feature, (uc IS NULL OR uc <= 10) AS selected
FROM ({PROFILE})
WHERE tbl = 'orders' AND col <> 'o_custkey'
""")
def select_recommended_q(spark, sf_dir):
    recs, _ = ingest_replies(_replies(spark, sf_dir))
    t = TableRef("orders", table(spark, sf_dir, "orders"), ["c_custkey"], ["o_custkey"])
    return select_recommended(t, recs)


@query("gate_tables", f"""
SELECT r.* FROM ({REC_SQL}) r JOIN ({VERDICTS}) v ON r."table" = v."table" WHERE v.conclusion = 'Yes'
""")
def gate_tables_q(spark, sf_dir):
    recs, _ = ingest_replies(_replies(spark, sf_dir))
    return gate_tables(recs, ingest_verdicts(_verdict_texts(spark, sf_dir)))


# -- M5-M8: rule "quality = not toxic" as the prediction ---------------------------

PRED = "SELECT doc_id, quality AS y, 1 - toxic AS yhat FROM labels"


def _pred(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), (1 - F.col("toxic")).alias("yhat"))


@query("confusion", f"SELECT y, yhat, count(*) AS n FROM ({PRED}) GROUP BY y, yhat")
def confusion_q(spark, sf_dir):
    return confusion(_pred(spark, sf_dir), "y", "yhat")


@query("macro_f1", f"""
WITH cm AS (SELECT y, yhat, count(*) AS n FROM ({PRED}) GROUP BY y, yhat),
lab AS (SELECT y AS label FROM cm UNION SELECT yhat FROM cm),
s AS (SELECT label, coalesce(sum(n) FILTER (WHERE y = label AND yhat = label), 0) AS tp,
             coalesce(sum(n) FILTER (WHERE yhat = label), 0) AS n_pred, coalesce(sum(n) FILTER (WHERE y = label), 0) AS n_true
      FROM lab, cm GROUP BY label)
SELECT round(avg(coalesce(2.0 * tp / nullif(n_pred + n_true, 0), 0)), 6) AS macro_f1, count(*) AS n_classes FROM s
""")
def macro_f1_q(spark, sf_dir):
    return macro_f1(_pred(spark, sf_dir), "y", "yhat").withColumn("macro_f1", F.round("macro_f1", 6))


@query("binary_f1", f"""
SELECT tp, fp, fn, tn, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6)
       AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1
FROM (SELECT count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND yhat = 1) AS fp,
             count(*) FILTER (WHERE y = 1 AND yhat <> 1) AS fn, count(*) FILTER (WHERE y <> 1 AND yhat <> 1) AS tn
      FROM ({PRED}))
""")
def binary_f1_q(spark, sf_dir):
    out = binary_f1(_pred(spark, sf_dir), "y", "yhat")
    for c in ("precision", "recall", "f1"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("mae", """
SELECT round(avg(abs(c.c_acctbal - s.m)), 6) AS mae, count(*) AS n
FROM customer c JOIN (SELECT c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY c_mktsegment) s
  ON c.c_mktsegment = s.c_mktsegment
""")
def mae_q(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    seg = c.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("pred"))
    return mae(c.join(seg, "c_mktsegment"), "c_acctbal", "pred").withColumn("mae", F.round("mae", 6))
