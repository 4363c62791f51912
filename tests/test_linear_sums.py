"""Linear models from Gram matrices, permutation importance and patches against plain versions."""
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from plotwise.operators import encode as E
from plotwise.operators import evaluate as V
from plotwise.operators import filters as Fl
from plotwise.operators import gram as G
from plotwise.operators import models as M


def data(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 5, 0.1, 2] + [1e6, 3, 0, -7]
    y = x @ [2.0, -0.3, 4.0, 0.0] + rng.normal(size=n) * 0.5
    return x, y, np.arange(n) % 10


@pytest.fixture(scope="module")
def frame(spark):
    x, y, f = data()
    return spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), int(f[i])) for i in range(len(y))],
                                 "id long, a double, b double, c double, d double, label double, fold int").repartition(5)


@pytest.mark.parametrize("alpha", [0.0, 3.0])
def test_folds_equal_separate_fits(frame, alpha):
    x, y, f = data()
    grams = G.fold_grams(frame, ["a", "b", "c", "d"], "label", "fold")
    for names in (["a", "b", "c", "d"], ["b", "d"]):
        keep = ["abcd".index(n) for n in names]
        scores = []
        for k in range(10):
            tx, ty = x[f != k][:, keep], y[f != k]
            m, my = tx.mean(axis=0), ty.mean()
            w = np.linalg.solve((tx - m).T @ (tx - m) + alpha * np.eye(len(keep)), (tx - m).T @ (ty - my))
            e = y[f == k] - my - (x[f == k][:, keep] - m) @ w
            scores.append(1 - e @ e / ((y[f == k] - y[f == k].mean()) ** 2).sum())
        assert G.cv_r2(grams, names, alpha) == pytest.approx((np.mean(scores), np.std(scores)), abs=1e-8)
    vectors = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(frame)
    same = G.fold_grams(vectors, "features", "label", "fold", names=list("abcd"))
    assert G.cv_r2(same, alpha=alpha) == pytest.approx(G.cv_r2(grams, alpha=alpha), abs=1e-9)
    w, b = G.coefficients(grams, alpha=alpha)
    m = x.mean(axis=0)
    plain = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(4), (x - m).T @ (y - y.mean()))
    assert w == pytest.approx(plain, abs=1e-8) and b == pytest.approx(y.mean() - m @ plain, rel=1e-9)


def test_rows_with_nulls_and_no_rows(spark, frame):
    holes = frame.withColumn("a", F.when(F.col("id") % 3 > 0, F.col("a"))).withColumn("fold", F.when(F.col("id") != 1, F.col("fold")))
    whole = holes.filter("a is not null and fold is not null")
    assert G.cv_r2(G.fold_grams(holes, ["a", "b"], "label", "fold")) == pytest.approx(
        G.cv_r2(G.fold_grams(whole, ["a", "b"], "label", "fold")), abs=1e-9)
    assert G.fold_grams(frame.limit(0), ["a"], "label", "fold").folds == {}


def test_permutation_importance_is_few_jobs(spark, frame):
    vec = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features")
    from pyspark.ml import PipelineModel
    model = PipelineModel(stages=[vec, M.regressor("linear").fit(vec.transform(frame))])
    jobs = {}
    for features, repeats in ((["a"], 1), (["a", "b", "c", "d"], 6)):
        group = f"permutation of {len(features)}"
        spark.sparkContext.setJobGroup(group, group)
        got = {r.feature: r for r in V.permutation_importance(model, frame.drop("fold"), features, "id", n_repeats=repeats).collect()}
        jobs[repeats] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # the drop of a permuted feature of a linear model is about 2 w² var(x) / var(y)
    x, y, _ = data()
    for k, (c, w) in enumerate(zip("abcd", (2.0, -0.3, 4.0, 0.0))):
        assert got[c].importance_mean == pytest.approx(2 * w * w * x[:, k].var() / y.var(), rel=0.25, abs=0.01)
    assert jobs[6] == jobs[1]  # as many jobs for 24 permutations as for one
    assert V.permutation_importance(model, frame.limit(0), ["a"], "id").collect() == []


def test_rfe_reports_the_final_fit(spark, frame):
    def fit(df, feats):
        return [{"a": 3, "b": 1, "c": 4, "d": 0}[f] + len(feats) / 10 for f in feats]
    assert V.rfe_report(fit, frame, list("abcd"), 2) == [("c", 1, 4.2), ("a", 1, 3.2), ("b", 2, None), ("d", 3, None)]


def test_patches_of_many_columns(spark):
    df = spark.createDataFrame([(1, "x", 1.0, 5), (2, "y", 2.0, 6), (3, None, None, 7), (4, "z", 4.0, 8)], "id long, a string, b double, c int")
    fixes = spark.createDataFrame([(1, "a", "new"), (1, "b", "9.5"), (2, None, None), (3, "c", "no number"), (3, "b", "1"), (3, "b", "2"),
                                   (4, "unknown", "1"), (None, "a", "q"), (77, "a", "q")], "id long, column string, value string")
    got = sorted(tuple(r) for r in Fl.apply_patches(df, fixes, "id").collect())
    assert got == [(1, "new", 9.5, 5), (3, None, 2.0, 7), (4, "z", 4.0, 8)]
    assert Fl.apply_patches(df, fixes.limit(0), "id").count() == 4


def test_label_matrix_and_its_elbow(spark):
    rows = spark.createDataFrame([(["a", "b", "a"],), (["b"],), ([],), (None,), (["c", "b"],)], "l array<string>")
    matrix, names = E.label_matrix(rows, "l")
    assert names[0] == "b" and sorted(names) == ["a", "b", "c"]
    assert sorted(sum(r.labels.toArray()) for r in matrix.collect()) == [0, 0, 1, 2, 2]
    curve = E.elbow_vectors(matrix, "labels", k_max=3).collect()
    assert [r.k for r in curve] == [1, 2, 3] and curve[0].inertia >= curve[1].inertia >= curve[2].inertia
