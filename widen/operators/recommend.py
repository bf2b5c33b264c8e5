"""Recommendation tables: the data side of an outside recommender.

Calling a language model is not part of the engine. The engine builds the
request text per candidate table from profiles (R1) and ingests replies that
arrive as a table ``(table, reply)`` (R2-R4), one row per reply, with every
step a column expression so a million replies parse in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLY_SCHEMA = ("feature_scores map<string,double>, feature_ranking array<string>, "
                "recommended_features array<string>, analysis map<string,string>")

# Fixed patterns of the reply formats.
FENCE = r"(?s)```(?:json)?\s*(.*?)```"
CONCLUSION = r"(?m)^[ \t]*Conclusion:[ \t]*(.*?)[ \t]*$"
ANALYSIS = r"(?m)^[ \t]*Table Analysis:[ \t]*(.*?)[ \t]*$"


def profile_lines(profiles: DataFrame) -> DataFrame:
    """One text line per profiled column: ``(table, pos, line)``."""
    num = F.format_string("%s (%s): min %s, max %s", "column", "dtype",
                          F.col("min").cast("string"), F.col("max").cast("string"))
    txt = F.format_string("%s (%s): %s distinct, e.g. %s", "column", "dtype", F.col("unique_count").cast("string"),
                          F.array_join("cell_examples", " | "))
    return profiles.select("table", "pos", F.when(F.col("unique_count").isNull(), num).otherwise(txt).alias("line"))


def prompt_frame(profiles: DataFrame, base: str, target: str, task: str) -> DataFrame:
    """One request per candidate table: ``(table, kind, prompt)``.

    ``profiles`` holds K1 rows of the base and of every candidate with a
    ``table`` column. Lines are gathered per table (bounded by its column
    count) and ordered by column position.
    """
    lines = profile_lines(profiles)
    per = lines.groupBy("table").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("pos", "line"))).getField("line"), "\n").alias("text"))
    base_text = per.filter(F.col("table") == base).select(F.col("text").alias("base_text"))
    cands = per.filter(F.col("table") != base)
    head = F.lit(f"Base table {base}; target {target} ({task}).\n")
    prompt = F.concat(head, F.col("base_text"), F.lit("\nCandidate table "), F.col("table"), F.lit(":\n"),
                      F.col("text"),
                      F.lit("\nAnswer in JSON with feature_scores, feature_ranking and recommended_features."))
    # base_text is one row
    return (cands.withColumn("__j", F.lit(1)).join(F.broadcast(base_text.withColumn("__j", F.lit(1))), "__j")
            .select("table", F.lit("features").alias("kind"), prompt.alias("prompt")))


#: What each kind of request asks for (wording of our own).
ASKS = {
    "features": "Answer in JSON with feature_scores, feature_ranking and recommended_features.",
    "score": "Score every candidate feature from 0 to 1. Answer in JSON with feature_scores and recommended_features.",
    "analysis": "Say of every candidate feature what it tells about the target, then answer in JSON with analysis, "
                "feature_scores, feature_ranking and recommended_features.",
    "relevance": "Say whether the candidate table helps to predict the target, in two lines.\n"
                 "Table Analysis: how the tables relate\nConclusion: Yes or No",
    "samples": "Answer in JSON with feature_scores, feature_ranking and recommended_features.",
}


def sample_lines(df: DataFrame, order_by, n: int = 3) -> DataFrame:
    """The first ``n`` rows by ``order_by`` as text, in one row: ``(sample)``.
    A row is ``column=value`` joined by ``; ``, nulls as ``column=``."""
    order = [F.col("`" + c.replace("`", "``") + "`") for c in ([order_by] if isinstance(order_by, str) else order_by)]
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.col("`" + c.replace("`", "``") + "`").cast("string"), F.lit("")))
             for c in df.columns]
    rows = df.select(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.array_join(F.array(*cells), "; ").alias("line"))
    first = rows.orderBy(*[f"o{i}" for i in range(len(order))], "line").limit(n)  # a handful of rows
    return first.agg(F.array_join(F.sort_array(F.collect_list(F.struct(*[f"o{i}" for i in range(len(order))], "line")))
                                  .getField("line"), "\n").alias("sample"))


def prompt_kinds(profiles: DataFrame, base: str, target: str, task: str, kinds=tuple(ASKS),
                 descriptions: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """R1, every kind: ``(table, kind, prompt)``, a request per candidate table
    and kind.

    ``descriptions`` (table, description) adds a block with name and description
    before a table's columns; tables without one have their columns alone.
    ``samples`` (table, sample) serves the kind ``samples``, which shows rows in
    the place of column profiles; tables without a sample have no such request.
    """
    unknown = set(kinds) - set(ASKS)
    if unknown:
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    spark = profiles.sparkSession
    lines = profile_lines(profiles)
    per = lines.groupBy("table").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("pos", "line"))).getField("line"), "\n").alias("text"))
    none = spark.createDataFrame([], "table string, text string")
    described = (descriptions.select("table", "description") if descriptions is not None else none.toDF("table", "description"))
    sampled = samples.select("table", "sample") if samples is not None else none.toDF("table", "sample")
    per = per.join(described, "table", "left").join(sampled, "table", "left")
    about = F.coalesce(F.concat(F.lit("Name: "), F.col("table"), F.lit("\nDescription: "), F.col("description"), F.lit("\n")),
                       F.lit(""))
    per = per.select("table", F.concat(about, "text").alias("columns"), F.concat(about, "sample").alias("rows"))
    shown = per.select("table", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col("rows" if k == "samples" else "columns").alias("text")) for k in kinds])).alias("x"))
    shown = shown.select("table", "x.kind", "x.text").filter(F.col("text").isNotNull())
    own = shown.filter(F.col("table") == base).select("kind", F.col("text").alias("base_text"))  # a row a kind
    ask = F.create_map(*[x for k, v in ASKS.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]
    prompt = F.concat(F.lit(f"Base table {base}; target {target} ({task}).\n"), "base_text", F.lit("\nCandidate table "),
                      F.col("table"), F.lit(":\n"), "text", F.lit("\n"), ask)
    return (shown.filter(F.col("table") != base).join(F.broadcast(own), "kind")
            .select("table", "kind", prompt.alias("prompt")))


def reply_body(reply) -> F.Column:
    """The fenced block when there is one, else the whole text."""
    fenced = F.regexp_extract(reply, FENCE, 1)
    return F.when(fenced != "", fenced).otherwise(reply)


def parse_replies(replies: DataFrame, text_col: str = "reply") -> DataFrame:
    """``(table, reply, parsed, ok)``: bad JSON yields a struct of nulls, not a
    null struct, so a reply counts as parsed when any field is present and a
    recommendation list exists (the reference fails without one)."""
    parsed = F.from_json(reply_body(F.col(text_col)), REPLY_SCHEMA, {"allowUnquotedControlChars": "true"})
    out = replies.withColumn("parsed", parsed)
    ok = F.col("parsed.recommended_features").isNotNull()
    return out.withColumn("ok", F.coalesce(ok, F.lit(False)))


def ingest_replies(replies: DataFrame, text_col: str = "reply") -> tuple[DataFrame, DataFrame]:
    """R2: replies -> ``(table, feature, score, rank, recommended)`` and rejects ``(table, reply)``."""
    p = parse_replies(replies, text_col)
    good = p.filter("ok")
    rejects = p.filter(~F.col("ok")).select("table", F.col(text_col).alias("reply"))
    feats = F.array_distinct(F.concat(
        F.coalesce("parsed.feature_ranking", F.array().cast("array<string>")),
        F.col("parsed.recommended_features"),
        F.coalesce(F.map_keys("parsed.feature_scores"), F.array().cast("array<string>"))))
    rows = good.select("table", "parsed", F.explode(feats).alias("feature"))
    rank = F.array_position(F.col("parsed.feature_ranking"), F.col("feature"))
    return rows.select(
        "table", "feature",
        F.col("parsed.feature_scores")[F.col("feature")].alias("score"),
        F.when(rank > 0, rank).alias("rank"),
        F.array_contains("parsed.recommended_features", F.col("feature")).alias("recommended"),
    ), rejects


def ingest_verdicts(texts: DataFrame, text_col: str = "reply") -> DataFrame:
    """``(table, analysis, conclusion)``; the last ``Conclusion:`` line wins,
    yes/no in any case; anything else or no such line -> ``No``."""
    last = F.try_element_at(F.regexp_extract_all(F.col(text_col), F.lit(CONCLUSION), 1), F.lit(-1))
    first = F.try_element_at(F.regexp_extract_all(F.col(text_col), F.lit(ANALYSIS), 1), F.lit(1))
    word = F.initcap(F.lower(last))
    return texts.select("table", first.alias("analysis"),
                        F.when(word.isin("Yes", "No"), word).otherwise(F.lit("No")).alias("conclusion"))


def ingest_descriptions(texts: DataFrame, text_col: str = "reply") -> DataFrame:
    """Lines with ``:`` and ``(`` -> ``(table, line_no, column, description)``."""
    lines = texts.select("table", F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    hit = lines.filter(F.col("line").contains(":") & F.col("line").contains("("))
    return hit.select("table", F.col("line_no").cast("bigint").alias("line_no"),
                      F.trim(F.substring_index("line", ":", 1)).alias("column"),
                      F.trim(F.expr("substr(line, instr(line, ':') + 1)")).alias("description"))


# How the summary of a description reply begins.
SUMMARY_PREFIXES = ("数据规模", "主要包含")


def ingest_summaries(texts: DataFrame, text_col: str = "reply", prefixes=SUMMARY_PREFIXES) -> DataFrame:
    """``(table, summary)`` of the replies that have one: from the first line
    that begins with a prefix, all lines that describe no column, each with its
    line end."""
    lines = texts.select("table", F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    rest = lines.filter(~(F.col("line").contains(":") & F.col("line").contains("(")))
    begins = F.lit(False)
    for p in prefixes:
        begins = begins | F.col("line").startswith(p)
    rows = F.sort_array(F.collect_list(F.struct("line_no", "line")))  # the lines of one reply
    one = rest.groupBy("table").agg(rows.alias("lines"), F.min(F.when(begins, F.col("line_no"))).alias("first"))
    kept = F.filter("lines", lambda x: x["line_no"] >= F.col("first"))
    return one.filter("first IS NOT NULL").select(
        "table", F.concat(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), F.lit("\n")).alias("summary"))
