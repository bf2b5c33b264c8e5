"""Model-based scorers (M1-M4, M9) on Spark ML.

Every scorer follows one protocol: ``scorer(df, target, key) -> Score`` where
``key`` is a stable row key used for the md5 split (E10), so the same rows are
held out in every round of the loop. Models train on executors; only the
score returns to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widen.functions.columns import col
from widen.operators.boost import fit_boosted
from widen.operators.metrics import binary_f1, macro_f1, mae
from widen.operators.prep import FEW, assemble, balance, counted_frame, impute_constant, low_variance, split
from widen.operators.profile import task_of


@dataclass(frozen=True)
class Score:
    value: float
    higher_is_better: bool
    metric: str

    def better_than(self, other: "Score | None") -> bool:
        if other is None or other.value is None:
            return self.value is not None
        if self.value is None:
            return False
        return self.value > other.value if self.higher_is_better else self.value < other.value

    def improvement(self, other: "Score | None") -> float:
        if other is None or other.value is None or self.value is None:
            return 0.0
        d = self.value - other.value
        return d if self.higher_is_better else -d


#: Rows that are worth a partition of their own, and rows that a partition may hold beyond the number of cores.
WORTH, MOST = 10_000, 1_000_000


def _dealt(df: DataFrame, rows: int, few: int) -> DataFrame:
    """``df`` in about as many partitions as there are cores, if its ``rows`` are
    ``few`` or more. In each pass of a forest every partition hands on the sums of
    every node that it meets, so what a pass shuffles grows with the partitions
    and not with the rows; and each job of a small frame costs a task a partition."""
    if rows < few:
        return df  # bootstrap samples follow the partitions
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(-(-rows // WORTH), max(cores, -(-rows // MOST)))))


def _prepared(df: DataFrame, target: str, key: str, task: str, test: float, split_seed: int, few: int = FEW):
    """Model-ready frame, persisted: tree training and evaluation pass over it
    many times, and the preparation (codes, medians, joins) should run once.
    Persisted blocks are made from the checkpoint of the joined table if an
    executor is lost."""
    keyed = df.withColumn("__key", col(key).cast("string")).drop(key)  # the row key is not a feature
    prepared, feats, rows = counted_frame(keyed, target, task, passthrough=["__key"])
    prepared = split(prepared, "__key", test=test, seed=split_seed)
    return assemble(_dealt(prepared, rows, few), feats).persist(StorageLevel.MEMORY_AND_DISK), feats


def _mean(values) -> float | None:
    """Mean over seeds; None where nothing was held out."""
    return None if None in values or not values else sum(values) / len(values)


def score_rf(df: DataFrame, target: str, key: str, seeds=(42,), num_trees: int = 100, max_depth: int = 10,
             test: float = 0.2, split_seed: int = 1) -> Score:
    """M1 (+M9): random-forest classifier, macro-F1 on the held-out part, mean over seeds."""
    from pyspark.ml.classification import RandomForestClassifier

    data, _ = _prepared(df, target, key, "classification", test, split_seed)
    try:
        train, hold = data.filter(~F.col("is_test")), data.filter(F.col("is_test"))
        vals = []
        for s in seeds:
            m = RandomForestClassifier(labelCol=target, featuresCol="features", numTrees=num_trees, maxDepth=max_depth,
                                       featureSubsetStrategy="sqrt", seed=s, cacheNodeIds=True).fit(train)
            pred = m.transform(hold).select(col(target).cast("double").alias("y"), F.col("prediction").alias("yhat"))
            vals.append(macro_f1(pred, "y", "yhat").first()["macro_f1"])
        return Score(_mean(vals), True, "macro_f1")
    finally:
        data.unpersist()


def score_boosted(df: DataFrame, target: str, key: str, seeds=(42,), max_iter: int = 50, test: float = 0.33,
                  split_seed: int = 1) -> Score:
    """M2: boosted stumps (SAMME) on a training part balanced by E11, macro-F1 on
    the held-out part, mean over seeds of the balancing. Any number of classes."""
    data, feats = _prepared(df, target, key, "classification", test, split_seed)
    try:
        train, hold = data.filter(~F.col("is_test")), data.filter(F.col("is_test"))
        counts = {r[0]: r[1] for r in train.groupBy(target).count().collect()}  # class counts: tiny
        major = max(counts, key=lambda c: (counts[c], -c)) if counts else None
        vals = []
        for s in seeds:
            part = balance(train, target, "__key", major=major, seed=s) if len(counts) > 1 else train
            pred = fit_boosted(part, feats, target, max_iter).predict(hold)
            one = macro_f1(pred.select(col(target).cast("string").alias("y"), F.col("prediction").alias("yhat")), "y", "yhat")
            vals.append(one.first()["macro_f1"])
        return Score(_mean(vals), True, "macro_f1")
    finally:
        data.unpersist()


def score_rf_reg(df: DataFrame, target: str, key: str, seeds=(42,), num_trees: int = 100, max_depth: int = 10,
                 test: float = 0.2, split_seed: int = 42) -> Score:
    """M3 (+M9): random-forest regressor, mean absolute error (lower is better)."""
    from pyspark.ml.regression import RandomForestRegressor

    data, _ = _prepared(df, target, key, "regression", test, split_seed)
    try:
        train, hold = data.filter(~F.col("is_test")), data.filter(F.col("is_test"))
        vals = []
        for s in seeds:
            m = RandomForestRegressor(labelCol=target, featuresCol="features", numTrees=num_trees, maxDepth=max_depth,
                                      featureSubsetStrategy="all", seed=s, cacheNodeIds=True).fit(train)
            pred = m.transform(hold).select(col(target).alias("y"), F.col("prediction").alias("yhat"))
            vals.append(mae(pred, "y", "yhat").first()["mae"])
        return Score(_mean(vals), False, "mae")
    finally:
        data.unpersist()


def score_search(df: DataFrame, target: str, key: str, seed: int = 42, folds: int = 3, test: float = 0.33,
                 split_seed: int = 42, parallelism: int = 4) -> Score:
    """M4: model search with cross-validation over logistic regression, random
    forest and boosted trees; low-variance columns (E9) dropped first; the best
    model is scored by binary F1 on held-out rows only."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    base = impute_constant(df)
    # every fit runs hundreds of short jobs, so no partition is spent on few rows
    prepared, feats = _prepared(base, target, key, "classification", test, split_seed, few=0)
    data = None
    try:
        low = set(low_variance(prepared, feats))
        keep = [f for f in feats if f not in low] or feats
        data = assemble(prepared.drop("features"), keep).persist(StorageLevel.MEMORY_AND_DISK)
        train, hold = data.filter(~F.col("is_test")), data.filter(F.col("is_test"))
        ev = MulticlassClassificationEvaluator(labelCol=target, metricName="fMeasureByLabel", metricLabel=1.0)
        best, best_metric = None, None
        lr = LogisticRegression(labelCol=target, featuresCol="features")
        rf = RandomForestClassifier(labelCol=target, featuresCol="features", seed=seed)
        gbt = GBTClassifier(labelCol=target, featuresCol="features", seed=seed)
        grids = [
            (lr, ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1]).build()),
            (rf, ParamGridBuilder().addGrid(rf.numTrees, [20, 50]).addGrid(rf.maxDepth, [5, 10]).build()),
            (gbt, ParamGridBuilder().addGrid(gbt.maxDepth, [2, 4]).build()),
        ]
        for est, grid in grids:
            cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=ev, numFolds=folds, seed=seed,
                                parallelism=parallelism).fit(train)
            m = max(cv.avgMetrics)
            if best_metric is None or m > best_metric:
                best, best_metric = cv.bestModel, m
        pred = best.transform(hold).select(col(target).cast("double").alias("y"), F.col("prediction").alias("yhat"))
        f1 = binary_f1(pred, "y", "yhat", positive=1.0).first()["f1"]
        return Score(f1 if f1 is not None else 0.0, True, "binary_f1")
    finally:
        prepared.unpersist()
        if data is not None:
            data.unpersist()


def default_scorer(df: DataFrame, target: str):
    """Pick the scorer from the task (K6): classification -> M1, regression -> M3."""
    return score_rf if task_of(df, target) == "classification" else score_rf_reg


def select_importance(df: DataFrame, target: str, key: str, k: int | None = None, seed: int = 42,
                      num_trees: int = 100, max_depth: int = 10) -> DataFrame:
    """rank features by random-forest importance (classification by
    K6, else regression) and select the top ``k`` (default half):
    ``(feature, importance, rank, selected)``."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    task = task_of(df, target)
    data, feats = _prepared(df, target, key, task, 0.0, 1)
    est = (RandomForestClassifier if task == "classification" else RandomForestRegressor)(
        labelCol=target, featuresCol="features", numTrees=num_trees, maxDepth=max_depth, seed=seed,
        cacheNodeIds=True)
    try:
        imp = est.fit(data).featureImportances.toArray().tolist()  # one number per feature
    finally:
        data.unpersist()
    k = len(feats) // 2 if k is None else k
    spark = df.sparkSession
    rows = spark.createDataFrame([(f, float(v)) for f, v in zip(feats, imp)], "feature string, importance double")
    from pyspark.sql import Window

    w = Window.orderBy(F.desc("importance"), "feature")  # one row per feature
    ranked = rows.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return ranked.withColumn("selected", F.col("rank") <= k)
