"""Prediction metrics as aggregations (M5-M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widen.functions.columns import col


def confusion(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """M8: ``(y, yhat, n)`` counts."""
    return df.groupBy(col(y).alias("y"), col(yhat).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """``(label, tp, fp, fn, f1)`` for every label seen in truth or prediction."""
    cm = confusion(df, y, yhat)
    truth = cm.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("n_true"))
    pred = cm.groupBy(F.col("yhat").alias("label")).agg(F.sum("n").alias("n_pred"))
    tp = cm.filter(F.col("y") == F.col("yhat")).select(F.col("y").alias("label"), F.col("n").alias("tp"))
    labels = truth.join(pred, "label", "full")
    m = labels.join(tp, "label", "left").select(
        "label", F.coalesce("tp", F.lit(0)).alias("tp"),
        (F.coalesce("n_pred", F.lit(0)) - F.coalesce("tp", F.lit(0))).alias("fp"),
        (F.coalesce("n_true", F.lit(0)) - F.coalesce("tp", F.lit(0))).alias("fn"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return m.withColumn("f1", f1)


def macro_f1(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """M5: unweighted mean of per-class F1 (0 for a class never hit); one row."""
    return per_class(df, y, yhat).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
                                      F.count(F.lit(1)).alias("n_classes"))


def binary_f1(df: DataFrame, y: str, yhat: str, positive=1) -> DataFrame:
    """M6: F1 of the positive class from the confusion counts; null when undefined."""
    t, p = col(y) == F.lit(positive), col(yhat) == F.lit(positive)
    agg = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
                 F.count_if(~t & ~p).alias("tn"))
    prec = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return agg.withColumn("precision", prec).withColumn("recall", rec).withColumn(
        "f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def mae(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """M7: mean absolute error, one row."""
    return df.agg(F.avg(F.abs(col(y).cast("double") - col(yhat).cast("double"))).alias("mae"),
                  F.count(F.lit(1)).alias("n"))
