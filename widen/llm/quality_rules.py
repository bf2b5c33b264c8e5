"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression over one text (lengths, symbols, stop
words, lines, repeated windows); a rule is a row ``(name, metric, low, high)``.
:func:`quality_rules` computes the metrics and compiles the whole table into
one projection, one pass over the documents, no shuffle, no user function.

Defined results: a null or empty text has no words, zero in every count and
fails the base rule; repeated rows are each judged; an empty table gives an
empty result; other columns of the input are kept, and an input column that
has the name of a result column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for was on as "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur "
    "el que y los se del las por con no su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Production thresholds. They are wide on purpose: each bound lies well
#: outside what prose shows, so that only junk falls.
RULES = (
    Rule("symbol_ratio", "symbol_ratio", high=0.25),
    Rule("mean_word_length", "mean_word_length", low=2.0, high=14.0),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("shout_ratio", "shout_ratio", high=0.3),
    Rule("bullet_lines", "bullet_line_ratio", high=0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", high=0.3),
    Rule("duplicate_lines", "dup_line_ratio", high=0.7),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _repeat_words(words: str, n: int) -> list[tuple[str, Column]]:
    """Steps that end in column n_repeat_words: words covered by n-word windows
    found twice or more.

    Windows are sorted as longs: 64-bit hash above, start below, with just as
    many low bits as the document's starts need; neighbours of equal hash are
    compared word by word, so a hash collision is no repeat. A window repeats
    if it equals its neighbour below or above in that order.
    """
    m = F.greatest(F.size(words) - F.lit(n - 1), F.lit(0))
    mask = F.expr(f"coalesce(shiftleft(1L, cast(ceil(log2(__m + 1)) as int)) - 1L, 0L)")
    hashes = ", ".join(f"{words}[i + {k}]" for k in range(n))
    packed = F.expr(
        f"CASE WHEN __m > 0 THEN transform(sequence(0, __m - 1), "
        f"i -> coalesce((xxhash64({hashes}) & ~__mask) | i, 0L)) ELSE cast(array() as array<bigint>) END")

    def equal_to(d: int, inside: str) -> str:
        same = " AND ".join(f"{words}[cast(p & __mask as int) + {k}] = {words}[cast(__s[j + {d}] & __mask as int) + {k}]"
                            for k in range(n))
        return f"filter(__s, (p, j) -> {inside} AND (__s[j + {d}] | __mask) = (p | __mask) AND {same})"

    below = F.expr(equal_to(-1, "j > 0"))
    starts = F.expr(f"CASE WHEN size(__b) = 0 THEN __b ELSE sort_array(transform("
                    f"array_union(__b, {equal_to(1, 'j < __m - 1')}), p -> coalesce(p & __mask, 0L))) END")
    covered = F.expr(
        f"aggregate(transform(__p, (p, j) -> least({n}L, coalesce(get(__p, j + 1) - p, {n}L))), 0L, (a, x) -> a + x)")
    return [("__m", m), ("__mask", mask), ("__s", F.sort_array(packed)), ("__b", below), ("__p", starts),
            ("n_repeat_words", covered)]


METRICS = (*BASE, "n_stop_words", "symbol_ratio", "mean_word_length", "shout_ratio", "bullet_line_ratio",
           "ellipsis_line_ratio", "dup_line_ratio")


def text_metrics(docs: DataFrame, text: str = "text", window: int = 3) -> DataFrame:
    """Add the metric columns that rules can name (:data:`METRICS`).

    Words are maximal runs without white space; a null text has none.
    """
    df = docs.drop(*[c for c in docs.columns if c.lower() in METRICS])
    # input columns travel in one struct, so that their names meet no others
    df = df.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("x"),
                   F.coalesce(F.col("`" + text.replace("`", "``") + "`"), F.lit("")).alias("t"))
    t, blank = F.col("t"), F.lit("")
    df = df.select("*", F.filter(F.split(t, SPACE + "+"), lambda x: x != blank).alias("__w"),
                   F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("__l"))
    for name, c in _repeat_words("__w", window):
        df = df.withColumn(name, c)
    lines, words = F.size("__l"), F.size("__w")
    stop = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    df = df.select(
        "*",
        words.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (lines - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_intersect(stop, "__w")).cast("long").alias("n_stop_words"),
        ((F.length(t) - F.length(F.replace(t, F.lit("!!"), F.lit("")))) / 2).alias("__shout"),
        F.size(F.filter("__l", lambda x: x.rlike(r"^[\x20\t]*[-*•]"))).alias("__bullets"),
        F.size(F.filter("__l", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("__dots"))
    metrics = [
        *[F.col(c) for c in (*BASE, "n_stop_words")],
        _ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_length"),
        _ratio(F.col("__shout"), F.col("n_words")).alias("shout_ratio"),
        _ratio(F.col("__bullets"), lines).alias("bullet_line_ratio"),
        _ratio(F.col("__dots"), lines).alias("ellipsis_line_ratio"),
        _ratio(F.col("n_dup_lines"), lines).alias("dup_line_ratio")]
    # as a generated row the metrics are computed once: a later filter on them
    # would otherwise be pushed down with copies of all the steps above in it
    return df.select("x.*", F.inline(F.array(F.struct(*metrics))))


def compile_rules(rules=RULES) -> Column:
    """The threshold table as one array expression: names of the rules that a
    document fails, in the order of the table."""
    def failed(r: Rule) -> Column:
        c = F.lit(False)
        if r.low is not None:
            c = c | (F.col(r.metric) < F.lit(r.low))
        if r.high is not None:
            c = c | (F.col(r.metric) > F.lit(r.high))
        return F.when(c, F.lit(r.name))

    if not rules:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[failed(r) for r in rules]), lambda x: x.isNotNull())


def quality_rules(docs: DataFrame, rules=RULES, text: str = "text", min_words: int = 50,
                  max_repeat_pct: int = 50) -> DataFrame:
    """Input columns, metrics, base_failed, failed_rules and kept."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"base_failed", "failed_rules", "kept"}])
    df = text_metrics(docs, text)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return (df.withColumn("base_failed", base)
            .withColumn("failed_rules", compile_rules(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", *BASE, "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
m AS (
  SELECT doc_id, len(w) AS n_words,
         len(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
         len(list_distinct(list_filter(w, lambda x: x IN ({_STOP})))) AS n_stop,
         (len(text) - len(replace(text, '!!', ''))) / 2 AS n_shout,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\t]*[-*•]'))) AS n_bullet,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\x20*$'))) AS n_dots
  FROM d),
win AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n >= 2),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
j AS (
  SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         coalesce(n_symbols / nullif(n_words, 0), 0) <= 0.25
         AND coalesce(word_chars / nullif(n_words, 0), 0) BETWEEN 2.0 AND 14.0
         AND n_stop >= 2
         AND coalesce(n_shout / nullif(n_words, 0), 0) <= 0.3
         AND coalesce(n_bullet / nullif(n_lines, 0), 0) <= 0.9
         AND coalesce(n_dots / nullif(n_lines, 0), 0) <= 0.3
         AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.7 AS verdict
  FROM j)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, (NOT base_failed AND verdict) AS kept
FROM b
"""

QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": SQL}
