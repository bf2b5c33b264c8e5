"""Feature selection methods (F4, F6-F10) and the leak scan.

Every method returns a DataFrame of candidate features with its decision, so
the choice stays inspectable and joinable; :func:`chosen` turns it into the
short list of names the augmentation join needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widen.functions.columns import OTHER, as_list, classes, col, hash_order
from widen.functions.ranking import materialised
from widen.operators.join import augment, plan_features
from widen.operators.score import mutual_info, scores
from widen.sources.tables import TableRef

# Fixed values that must equal the reference's.
MIN_CORRELATION = 0.1
MAX_MISSING = 0.3


def feature_frame(spark, names) -> DataFrame:
    """A one-column frame of feature names (schema-sized, built on the driver)."""
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, feature string")


def chosen(selection: DataFrame, flag: str = "selected") -> list[str]:
    return [r["feature"] for r in selection.filter(F.col(flag)).orderBy("pos").collect()]


def _joined(base: DataFrame, t: TableRef, target: str, features) -> DataFrame:
    """The base's target and the joined features."""
    return augment(base.select(*dict.fromkeys([*t.left_keys, target])), t, list(features)).select(*_once(target, features))


def _once(target: str, features) -> list:
    return [col(c) for c in dict.fromkeys([target, *features])]


def _scorable(t: TableRef, features) -> tuple[list, list]:
    """Features that can be scored, and those that cannot: arrays, maps, structs."""
    kinds = classes(t.df)
    return [f for f in features if kinds[f] != OTHER], [f for f in features if kinds[f] == OTHER]


def select_all(t: TableRef) -> DataFrame:
    """every non-key column."""
    return feature_frame(t.df.sparkSession, t.features()).withColumn("selected", F.lit(True))


def select_random(t: TableRef, seed: int = 42, fraction: float = 0.5) -> DataFrame:
    """F8: ``n // 2`` features chosen by md5(seed:name) order, without replacement."""
    feats = t.features()
    k = int(len(feats) * fraction)
    ff = feature_frame(t.df.sparkSession, feats)
    picked = ff.orderBy(hash_order(seed, F.col("feature")), "feature").limit(k).select("feature")
    return ff.join(picked.withColumn("selected", F.lit(True)), "feature", "left").select(
        "pos", "feature", F.coalesce("selected", F.lit(False)).alias("selected"))


def select_filter(
    base: DataFrame,
    t: TableRef,
    target: str,
    min_corr: float = MIN_CORRELATION,
    max_missing: float = MAX_MISSING,
    numeric_vs_class: str = "skip",
    wide=None,
) -> DataFrame:
    """join every feature (J3), then keep features with missing ratio
    ``<= max_missing`` and ``|score| >= min_corr`` (Pearson / Cramér's V).

    Features whose name the base already has are reported as
    ``duplicate_name``, arrays, maps and structs with the measure
    ``unsupported``; neither is ever selected. ``wide`` gives a checkpoint of the
    base with those features where there is one.
    """
    plan = plan_features(base.columns, t.df.columns, t.right_keys, None)
    kept, odd = _scorable(t, plan.kept)
    # computed once: every score reads the checkpoint, not the join
    sc = None
    if kept:
        joined = wide(kept).select(*_once(target, kept)) if wide else materialised(_joined(base, t, target, kept))
        sc = scores(joined, kept, target, numeric_vs_class)
    names = t.features()
    ff = feature_frame(base.sparkSession, names)
    dup = F.col("feature").isin(list(plan.collisions)) if plan.collisions else F.lit(False)
    if sc is None:
        return ff.select("pos", "feature", F.lit(None).cast("string").alias("kind"),
                         F.lit(None).cast("double").alias("missing_ratio"),
                         _unsupported(F.lit(None).cast("string"), odd).alias("measure"),
                         F.lit(None).cast("double").alias("score"),
                         dup.alias("duplicate_name"), F.lit(False).alias("selected"))
    out = ff.join(sc, "feature", "left")
    ok = (~dup & (F.col("missing_ratio") <= max_missing)
          & (F.abs(F.coalesce(F.col("score"), F.lit(0.0))) >= min_corr))
    return out.select("pos", "feature", _unsupported(F.col("kind"), odd, OTHER).alias("kind"), "missing_ratio",
                      _unsupported(F.col("measure"), odd).alias("measure"), "score",
                      dup.alias("duplicate_name"), F.coalesce(ok, F.lit(False)).alias("selected"))


def _unsupported(value, odd: list, name: str = "unsupported"):
    return F.when(F.col("feature").isin(odd), F.lit(name)).otherwise(value) if odd else value


def select_mutual_info(base: DataFrame, t: TableRef, target: str, task: str = "classification",
                       k: int | None = None, bins: int = 16, wide=None) -> DataFrame:
    """F5 + F6: MI of every feature after the row-preserving join, top ``k``
    (default ``n // 2``) by MI, ties by name. ``wide`` gives a checkpoint of the
    base with those features where there is one."""
    plan = plan_features(base.columns, t.df.columns, t.right_keys, None)
    feats, _ = _scorable(t, plan.kept)
    k = len(t.features()) // 2 if k is None else k
    ff = feature_frame(base.sparkSession, t.features())
    if not feats:
        return ff.select("pos", "feature", F.lit(None).cast("double").alias("mutual_info"),
                         F.lit(False).alias("selected"))
    joined = wide(feats) if wide else _joined(base, t, target, feats)
    mi = mutual_info(joined, feats, target, task, bins, stored=wide is not None)
    top = mi.orderBy(F.desc("mutual_info"), "feature").limit(k).select("feature", F.lit(True).alias("selected"))
    return (ff.join(mi, "feature", "left").join(top, "feature", "left")
            .select("pos", "feature", "mutual_info", F.coalesce("selected", F.lit(False)).alias("selected")))


def select_recommended(t: TableRef, recommendations: DataFrame) -> DataFrame:
    """recommended names that are real columns of the table (others fall out).

    ``recommendations``: ``(table, feature, ...)`` as produced by the reply
    ingestion; only rows of this table are used.
    """
    ff = feature_frame(t.df.sparkSession, t.features())
    rec = (recommendations.filter(F.col("table") == t.name).filter(F.col("recommended"))
           .select("feature").distinct().withColumn("selected", F.lit(True)))
    return ff.join(rec, "feature", "left").select("pos", "feature", F.coalesce("selected", F.lit(False)).alias("selected"))


def gate_tables(recommendations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """drop recommendations of tables whose relevance verdict is ``No``."""
    yes = verdicts.filter(F.col("conclusion") == "Yes").select("table").distinct()
    return recommendations.join(yes, "table", "left_semi")


def leak_scan(base: DataFrame, t: TableRef, target: str, threshold: float = 0.5, bins: int = 16) -> DataFrame:
    """Association of every augment column with the target after one
    row-preserving join; columns above ``threshold`` are flagged as leaks.

    Numeric columns against a class target are scored over bins, so no column
    escapes the scan; arrays, maps and structs are listed as ``unsupported``.
    """
    plan = plan_features(base.columns, t.df.columns, t.right_keys, None)
    feats, odd = _scorable(t, plan.kept)
    rest = base.sparkSession.createDataFrame([(f, "unsupported", None, False) for f in odd],
                                             "feature string, measure string, score double, flagged boolean")
    if not feats:
        return rest
    sc = scores(materialised(_joined(base, t, target, feats)), feats, target, numeric_vs_class="bin", bins=bins)
    out = sc.select("feature", "measure", "score", (F.abs(F.coalesce("score", F.lit(0.0))) >= threshold).alias("flagged"))
    return out.unionByName(rest) if odd else out
