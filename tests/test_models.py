"""Model operators on synthetic data with known answers."""

import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from plotwise.operators import encode as E
from plotwise.operators import evaluate as V
from plotwise.operators import models as M


@pytest.fixture(scope="module")
def linear(spark):
    df = spark.range(2000).select(
        F.col("id"), (F.col("id") % 17).cast("double").alias("x1"), (F.col("id") % 7).cast("double").alias("x2"))
    df = df.withColumn("label", 3.0 + 2.0 * F.col("x1") - 0.5 * F.col("x2"))
    return VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(df)


def test_linear_recovers_coefficients(linear):
    model = M.regressor("linear").fit(linear)
    assert list(model.coefficients) == pytest.approx([2.0, -0.5], abs=1e-6)
    assert model.intercept == pytest.approx(3.0, abs=1e-6)


def test_ols_summary_exact_fit(linear):
    s = M.ols_summary(linear, ["x1", "x2"]).collect()
    coefs = {r.feature: r.coef for r in s}
    assert coefs["x1"] == pytest.approx(2.0, abs=1e-6) and s[0].r2 == pytest.approx(1.0)


def test_split_is_deterministic_and_partition_independent(linear):
    a, _ = M.split(linear, "id", 80, 42)
    b, _ = M.split(linear.repartition(7), "id", 80, 42)
    ids_a = sorted(r[0] for r in a.select("id").collect())
    assert ids_a == sorted(r[0] for r in b.select("id").collect())
    assert 0.75 < len(ids_a) / 2000 < 0.85


def test_regression_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "label double, prediction double")
    m = V.regression_metrics(df, log_target=False, n_features=1).first()
    assert m.r2 == pytest.approx(1 - 1.25 / 2.0)
    assert m.mae == pytest.approx(0.5) and m.mse == pytest.approx(1.25 / 3)
    assert m.median_ae == pytest.approx(0.5)
    assert m.mape == pytest.approx((0.5 + 0 + 1 / 3) / 3 * 100)
    assert m.adj_r2 == pytest.approx(1 - (1 - m.r2) * 2 / 1)


def test_ordinal_unknown_is_minus_one(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    test = spark.createDataFrame([("a",), ("z",), ("c",)], "k string")
    assert [r.k_idx for r in E.ordinal_encode(test, ["k"], fit_df=train).collect()] == [0, -1, 2]


def test_one_hot_drop_first(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    out = E.one_hot_drop_first(df, ["k"])
    assert out.columns == ["k", "k_b", "k_c"]
    assert [(r.k_b, r.k_c) for r in out.collect()] == [(0, 0), (1, 0), (0, 1), (0, 0)]


def test_target_encoding_formula(spark):
    df = spark.createDataFrame([("a", 1.0)] * 30 + [("b", 5.0)] * 5, "k string, y double")
    out = {r.k: r.k_te for r in E.target_encode(df, "k", "y").select("k", "k_te").distinct().collect()}
    prior = (30 * 1.0 + 5 * 5.0) / 35
    s_a, s_b = 1 / (1 + math.exp(-(30 - 20) / 10)), 1 / (1 + math.exp(-(5 - 20) / 10))
    assert out["a"] == pytest.approx(s_a * 1.0 + (1 - s_a) * prior)
    assert out["b"] == pytest.approx(s_b * 5.0 + (1 - s_b) * prior)


def test_kmeans_labels_are_ordered(spark):
    data = [(float(v),) for v in [0, 0, 1, 1, 10, 10, 11, 20, 21, 22]]
    df = spark.createDataFrame(data, "x double")
    out = E.kmeans_labels(df, ["x"], k=3)
    means = {r.cluster: r.m for r in out.groupBy("cluster").agg(F.avg("x").alias("m")).collect()}
    assert means[0] < means[1] < means[2]


def test_cv_and_random_search(linear):
    df = M.with_folds(linear, "id", k=3)
    model, res = M.cv_scores(M.regressor("linear"), df, "fold", num_folds=3)
    assert res[0][1] == pytest.approx(1.0, abs=1e-6)
    est = M.regressor("tree")
    maps = M.random_param_maps(est, {"maxDepth": [2, 3, 4]}, n_iter=2, seed=1)
    assert len(maps) == 2

def test_ridge_and_lasso_match_the_closed_form(spark):
    """One centred unit-variance feature, slope 2: ridge gives 2 n / (n + alpha), lasso 2 - alpha."""
    n = 400
    xs = [1.0 if i % 2 else -1.0 for i in range(n)]
    df = spark.createDataFrame([(Vectors.dense([x]), 2.0 * x + 3.0) for x in xs], ["features", "label"])
    scale = M.label_scale(df)
    ridge = M.regressor("ridge", alpha=float(n), **scale).fit(df)
    lasso = M.regressor("lasso", alpha=0.5).fit(df)
    assert abs(ridge.coefficients[0] - 1.0) < 5e-3 and abs(ridge.intercept - 3.0) < 1e-6
    assert abs(lasso.coefficients[0] - 1.5) < 5e-3


def test_load_model_reads_any_saved_model(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from plotwise.sources import io
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(60)], ["x", "label"])
    vec = VectorAssembler(inputCols=["x"], outputCol="features")
    forest = M.regressor("forest", numTrees=3)
    for i, (est, data) in enumerate([(forest, vec.transform(df)), (Pipeline(stages=[vec, forest]), df)]):
        model = M.refit_and_save(est, data, str(tmp_path / str(i)))
        want = [r.prediction for r in model.transform(data).orderBy("x").collect()]
        back = io.load_model(str(tmp_path / str(i)))
        assert [r.prediction for r in back.transform(data).orderBy("x").collect()] == want


def test_rfe_ranks_and_permutation_importance(spark):
    from pyspark.ml.feature import VectorAssembler

    from plotwise.operators import evaluate as V
    weights = {"a": 5, "b": 4, "c": 3, "d": 2, "e": 1}
    kept, ranks = V.rfe(lambda df, fs: [weights[f] for f in fs], None, list(weights), n_keep=2)
    assert kept == ["a", "b"] and ranks == {"a": 1, "b": 1, "c": 2, "d": 3, "e": 4}
    df = spark.createDataFrame([(i, float(i % 11), float(i % 3), 4.0 * (i % 11)) for i in range(300)],
                               ["id", "x", "noise", "label"])
    vec = VectorAssembler(inputCols=["x", "noise"], outputCol="features")
    model = M.regressor("linear").fit(vec.transform(df))
    got = {r.feature: r.importance_mean for r in V.permutation_importance(
        model, df, ["x", "noise"], "id", n_repeats=3, assemble=lambda f: vec.transform(f.drop("features"))).collect()}
    assert got["x"] > 0.5 and abs(got["noise"]) < 1e-6


@pytest.mark.parametrize("kind", ["tree", "forest"])
def test_permutation_importance_of_encoded_trees_equals_the_scored_copies(spark, kind):
    """Rows are encoded once and scored in the tasks; the errors are those of a copy of each row for each column."""
    from plotwise.operators import stages as S
    rows = [(i, float(i % 11), None if i % 29 == 0 else float(i % 4), "abcde"[i % 5] if i % 13 else None, "xyz"[i % 7 % 3],
             None if i == 17 else 2.0 * (i % 11) + 7.0 * (i % 5 == 2) + (i % 7 % 3) + (i % 4) ** 2) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, a double, n double, c string, o string, label double")
    fit_on = df.filter("label is not null and n is not null")
    params = {"maxDepth": 5} | ({"numTrees": 4} if kind == "forest" else {})
    model = S.feature_pipeline(["a", "n"], ["o"], ["c"], scale=True, then=[M.regressor(kind, **params)]).fit(fit_on)
    cols = ["a", "n", "c", "o"]
    got = {r.feature: r for r in V.permutation_importance(model, df, cols, "id", n_repeats=3).collect()}
    want = {r.feature: r for r in V.permutation_importance(model, df, cols, "id", n_repeats=3, assemble=lambda f: f).collect()}
    assert V._coded_trees(model) and set(got) == set(want) == set(cols)
    for c in cols:
        assert got[c].importance_mean == pytest.approx(want[c].importance_mean, abs=1e-9)
        assert got[c].importance_std == pytest.approx(want[c].importance_std, abs=1e-9)
    assert got["c"].importance_mean > 0.1
