"""Model fitting and selection with Spark ML (survey 2.12, M1-M11).

Splits and folds come from a seeded hash of the row key, so they do not
depend on partitioning or task retries (``randomSplit`` does). Training
data is persisted once per search and released afterwards.
"""

from __future__ import annotations

import random

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F


def hash_bucket(key: str, seed: int, buckets: int = 100):
    """A bucket from the first 32 bits of MD5 of ``key:seed``: the same in every engine that has MD5."""
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets


def hash_bucket_sql(key: str, seed: int, buckets: int = 100) -> str:
    """``hash_bucket`` in ANSI SQL with MD5 and hexadecimal literals."""
    return f"(CAST(concat('0x', substr(md5(concat(coalesce(CAST({key} AS VARCHAR), ''), ':{seed}')), 1, 8)) AS BIGINT) % {buckets})"


def split(df: DataFrame, key: str, train_pct: int = 80, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M1: seeded 80/20 split by a hash of the key."""
    b = hash_bucket(key, seed)
    return df.filter(b < train_pct), df.filter(b >= train_pct)


def with_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, col: str = "fold") -> DataFrame:
    """Fold id 0..k-1 from a seeded hash (for ``CrossValidator(foldCol=...)``)."""
    return df.withColumn(col, hash_bucket(key, seed + 1, k).cast("int"))


def regressor(name: str, features_col: str = "features", label_col: str = "label", **params):
    """M2/M5: linear / ridge / lasso / tree / forest / boosting.

    ridge and lasso take ``alpha`` of the objectives ``|y - Xw|^2 + alpha |w|_2^2``
    and ``|y - Xw|^2 / (2n) + alpha |w|_1``. MLlib minimises the mean loss, and
    scales the L2 penalty by the label's standard deviation: lasso's alpha is its
    ``regParam``; ridge's is ``alpha / n * label_std`` and needs both
    (``label_scale``).
    """
    common = {"featuresCol": features_col, "labelCol": label_col}
    if name in ("linear", "ridge", "lasso"):
        n, label_std = params.pop("n", 1), params.pop("label_std", 1.0)
        alpha = params.pop("alpha", 1.0)
        reg = {"linear": 0.0, "ridge": alpha / n * label_std, "lasso": alpha}[name]
        enet = 1.0 if name == "lasso" else 0.0
        return LinearRegression(regParam=reg, elasticNetParam=enet, standardization=params.pop("standardization", False),
                                solver=params.pop("solver", "auto"), **common, **params)
    if name == "tree":
        return DecisionTreeRegressor(seed=params.pop("seed", 42), **common, **params)
    if name == "forest":
        return RandomForestRegressor(seed=params.pop("seed", 42), **common, **params)
    if name == "boosting":
        return GBTRegressor(seed=params.pop("seed", 42), **common, **params)
    raise ValueError(f"unknown regressor {name!r}")


def label_scale(df: DataFrame, label_col: str = "label") -> dict:
    """Rows and sample standard deviation of the label, as ridge takes them."""
    r = df.agg(F.count(label_col).alias("n"), F.stddev_samp(label_col).alias("s")).first()
    return {"n": max(1, r.n), "label_std": float(r.s or 0.0)}


def ols_summary(df: DataFrame, names, features_col: str = "features", label_col: str = "label") -> DataFrame:
    """M3: coefficients with standard errors, t and p values, plus R² (normal
    equations, one distributed pass for the Gram matrix)."""
    model = LinearRegression(solver="normal", featuresCol=features_col, labelCol=label_col).fit(df)
    s = model.summary
    coefs = list(model.coefficients.toArray()) + [model.intercept]
    rows = [(n, float(c), float(se), float(t), float(p), float(s.r2))
            for n, c, se, t, p in zip(list(names) + ["intercept"], coefs, s.coefficientStandardErrors,
                                      s.tValues, s.pValues)]
    return df.sparkSession.createDataFrame(rows, "feature string, coef double, std_err double, t double, p double, r2 double")


def coefficient_table(model, names) -> list[tuple]:
    """M4: (feature, coefficient, expm1 effect on the original scale), sorted
    by absolute coefficient."""
    import math
    rows = [(n, float(c), math.expm1(float(c))) for n, c in zip(names, model.coefficients.toArray())]
    return sorted(rows, key=lambda r: -abs(r[1]))


def cv_scores(estimator, df: DataFrame, fold_col: str = "fold", label_col: str = "label", metric: str = "r2",
              grid=None, parallelism: int = 4, num_folds: int = 5):
    """M6/M8: k-fold CV over hash folds; returns (best model, [(params, mean, std)])."""
    grid = grid or ParamGridBuilder().build()
    ev = RegressionEvaluator(labelCol=label_col, metricName=metric)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=ev, foldCol=fold_col,
                        numFolds=num_folds, parallelism=parallelism, collectSubModels=False)
    # every fold and parameter map rescans the input: persist what the fit reads, once
    # (memory and disk; lost blocks are recomputed from lineage)
    features = estimator.getOrDefault("featuresCol") if estimator.hasParam("featuresCol") else None
    data = df.select(features, label_col, fold_col) if features in df.columns else df
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = cv.fit(data)
    finally:
        data.unpersist()
    std = list(model.stdMetrics) if model.stdMetrics else [0.0] * len(grid)
    return model, [({p.name: v for p, v in pm.items()}, float(m), float(s))
                   for pm, m, s in zip(grid, model.avgMetrics, std)]


def random_param_maps(estimator, space: dict, n_iter: int, seed: int = 42):
    """M9: ``n_iter`` parameter maps sampled (seeded) from lists of values."""
    rng = random.Random(seed)
    maps = []
    for _ in range(n_iter):
        maps.append({estimator.getParam(k): rng.choice(v) for k, v in space.items()})
    return maps


# FIXED VALUES: the two search spaces (what MLlib has no parameter for is left out), and their draws
FOREST_SPACE = {"numTrees": [100, 150, 200], "maxDepth": [10, 15, 20, 25], "minInstancesPerNode": [2, 4, 6],
                "featureSubsetStrategy": ["sqrt", "log2", "0.5"]}
BOOSTING_SPACE = {"maxIter": [100, 150, 200, 250], "stepSize": [0.03, 0.05, 0.1, 0.15], "maxDepth": [3, 4, 5, 6],
                  "subsamplingRate": [0.7, 0.8, 0.9, 1.0], "minInstancesPerNode": [1, 2, 4],
                  "featureSubsetStrategy": ["sqrt", "log2", "all"]}
FOREST_DRAWS, BOOSTING_DRAWS = 20, 25


def random_search(df: DataFrame, forest_space: dict = FOREST_SPACE, boosting_space: dict = BOOSTING_SPACE,
                  forest_draws: int = FOREST_DRAWS, boosting_draws: int = BOOSTING_DRAWS, fold_col: str = "fold",
                  num_folds: int = 5, seed: int = 42, parallelism: int = 4):
    """M9: seeded random searches over forests and boosted trees. Returns ({name: best model}, DataFrame of every draw:
    model, draw, params, cv_mean, cv_std). No draws of a kind: it is left out."""
    best, rows = {}, []
    for name, space, draws in (("forest", forest_space, forest_draws), ("boosting", boosting_space, boosting_draws)):
        if draws:
            est = regressor(name)
            maps = random_param_maps(est, space, draws, seed)
            model, found = cv_scores(est, df, fold_col, grid=maps, num_folds=num_folds, parallelism=parallelism)
            best[name] = model.bestModel
            rows += [(name, i, str(sorted(p.items())), m, s) for i, (p, m, s) in enumerate(found)]
    return best, df.sparkSession.createDataFrame(
        rows, "model string, draw int, params string, cv_mean double, cv_std double")


def compare_models(candidates: dict, train: DataFrame, test: DataFrame, label_col: str = "label",
                   log_target: bool = True) -> DataFrame:
    """M7: fit each candidate, score the test split; r2 on the model scale,
    MAE on the original scale (expm1 when the label is log1p); sorted by MAE."""
    from plotwise.operators.evaluate import regression_metrics
    rows = []
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    test = test.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for name, est in candidates.items():
            pred = est.fit(train).transform(test)
            m = regression_metrics(pred, label_col, "prediction", log_target=log_target).first()
            rows.append((name, float(m["r2"]), float(m["mae"]), float(m["rmse"])))
    finally:
        train.unpersist()
        test.unpersist()
    out = train.sparkSession.createDataFrame(rows, "model string, r2 double, mae double, rmse double")
    return out.orderBy("mae", "model")


def select_best(results: DataFrame, score: str = "cv_mean", size: str = "size_mb", max_size: float = 70.0,
                exclude=()) -> DataFrame:
    """Best CV score among models under a size limit, excluding some algorithms."""
    ok = results.filter((F.col(size) <= max_size) & ~F.col("model").isin(list(exclude)))
    return ok.orderBy(F.desc(score), "model").limit(1)


def model_size_mb(model, path: str) -> float:
    """Saved size of a model directory (MLlib persistence), in MB."""
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() / 1e6


def refit_and_save(estimator, df: DataFrame, path: str):
    """Refit on all rows (an estimator, or a pipeline of encoders and estimator) and persist with its own writer."""
    model = estimator.fit(df)
    model.write().overwrite().save(path)
    return model


def fit_pipeline(encoders, estimator, df: DataFrame, features_col: str = "features", label_col: str = "label"):
    """One ``PipelineModel`` of fitted encoders and estimator; the encoded rows (features and label alone) are kept while
    the estimator passes over them."""
    from pyspark.ml import PipelineModel
    encoded = encoders.fit(df)
    rows = encoded.transform(df).select(features_col, label_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return PipelineModel(stages=[*encoded.stages, estimator.fit(rows)])
    finally:
        rows.unpersist()
