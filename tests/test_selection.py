"""Components, searches, selections and importances on data with known answers."""
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from plotwise.operators import encode as E
from plotwise.operators import evaluate as V
from plotwise.operators import models as M
from plotwise.operators import similarity as R


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(0)
    data = []
    for i in range(300):
        a, b = rng.random(), rng.random()
        data.append((i, a, b, rng.random(), 3.0 * (a > 0.5) + 2.0 * (b > 0.5)))
    df = M.with_folds(spark.createDataFrame(data, "id long, a double, b double, noise double, label double"), "id", k=3)
    return VectorAssembler(inputCols=["a", "b", "noise"], outputCol="features").transform(df)


def test_pca_takes_the_components_that_are_needed(spark):
    rng = random.Random(1)
    data = [(x, 2 * x + 0.001 * rng.random(), -x, 0.01 * rng.random()) for x in (rng.gauss(0, 1) for _ in range(200))]
    vec = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(
        spark.createDataFrame(data, "a double, b double, c double, d double"))
    model, k = E.pca_components(vec, "features", 0.95)
    assert k == 1 and len(model.transform(vec).first().pca) == 1
    assert E.pca_components(vec, "features", 1.0)[1] >= 2


def test_grid_and_importance(rows):
    est = M.regressor("tree")
    grid = ParamGridBuilder().addGrid(est.maxDepth, [1, 3]).build()
    best, found = M.cv_scores(est, rows, "fold", grid=grid, num_folds=3)
    assert [p["maxDepth"] for p, _, _ in found] == [1, 3] and found[1][1] > 0.9 > found[0][1]
    table = V.tree_importance(best.bestModel, ["a", "b", "noise"])
    assert [t[0] for t in table][0] == "a" and sum(t[2] for t in table) == pytest.approx(100)


def test_random_search_of_both_kinds(rows):
    best, found = M.random_search(rows, {"numTrees": [2, 3], "maxDepth": [2]}, {"maxIter": [2], "stepSize": [0.1, 0.2]},
                                  forest_draws=2, boosting_draws=1, num_folds=3)
    got = found.collect()
    assert sorted((r.model, r.draw) for r in got) == [("boosting", 0), ("forest", 0), ("forest", 1)]
    assert set(best) == {"forest", "boosting"} and all(0 < r.cv_mean <= 1 for r in got)
    assert set(M.random_search(rows, {"numTrees": [2]}, {}, 1, 0, num_folds=3)[0]) == {"forest"}


def test_selection_by_score_size_and_kind(spark):
    table = spark.createDataFrame([("boosting", 0.99, 1.0), ("large", 0.98, 71.0), ("b", 0.9, 70.0), ("a", 0.9, 2.0), ("c", 0.1, 1.0)],
                                  "model string, cv_mean double, size_mb double")
    assert M.select_best(table, exclude=["boosting"]).first().model == "a"
    assert M.select_best(table, max_size=0.5).count() == 0


def test_pairs_of_requested_rows(spark):
    long = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "x", 3.0), (3, "z", 1.0)], "id long, term string, weight double")
    got = {(r.query_id, r.id): r.score for r in R.sparse_pairs(long, "id", spark.createDataFrame([(1,), (9,)], "id long")).collect()}
    assert got == {(1, 1): 5.0, (1, 2): 3.0}


def test_the_model_table_is_joined_once(spark, sf_small):
    from plotwise.plans import q_models
    plan = q_models._prepared(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "price" in plan


def test_the_elbow_fits_read_stored_vectors(spark, monkeypatch):
    from plotwise.operators import encode as E
    seen = []

    class Spy(E.KMeans):
        def fit(self, df):
            seen.append((df.storageLevel.useMemory, df._jdf.queryExecution().optimizedPlan().toString()))
            return super().fit(df)

    monkeypatch.setattr(E, "KMeans", Spy)
    left = spark.createDataFrame([(i, float(i % 5)) for i in range(40)], "id long, x double")
    right = spark.createDataFrame([(i, float(i % 3)) for i in range(40)], "id long, y double")
    curve = E.elbow(left.join(right, "id"), ["x", "y"], k_max=3).collect()
    assert [r.k for r in curve] == [1, 2, 3] and curve[0].inertia > curve[1].inertia > curve[2].inertia
    # a persisted table is decoded again in each step of a fit
    assert len(seen) == 2 and all(not kept and "Join" not in plan and "parquet" in plan for kept, plan in seen)


def test_the_chain_scales_and_labels_stored_rows(spark, sf_small, monkeypatch):
    import pytest
    from plotwise.plans import prepare, q_chain

    class Reached(Exception):
        pass

    def fit(df, *args, **kwargs):
        raise Reached(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(prepare.E, "kmeans_labels", fit)
    with pytest.raises(Reached) as found:
        q_chain.x1(spark, sf_small)
    assert "Join" not in str(found.value) and "Union" not in str(found.value)


def test_names_to_fill_from_are_broadcast(spark):
    from plotwise.operators import joins as J
    rows = spark.createDataFrame([(1, "A", None), (2, "b", "own"), (3, None, None)], "id long, name string, v string")
    names = spark.createDataFrame([("a", "z"), ("A", "y"), ("c", "x"), (None, "w")], "name string, v string")
    out = J.fill_from(rows, names, "name", "name", "v", "v")
    assert "strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.v) for r in out.collect()) == [(1, "y"), (2, "own"), (3, None)]


def test_the_random_search_query_draws_the_whole_spaces(spark, monkeypatch):
    from plotwise.plans import q_models
    seen = {}

    def search(df, estimator, fold_col, grid, **kwargs):
        seen[type(estimator).__name__] = [{p.name: v for p, v in m.items()} for m in grid]
        if len(seen) == 2:
            raise StopIteration
        return type("Found", (), {"bestModel": None}), []

    monkeypatch.setattr(q_models, "_train_test", lambda spark, d: (None, None, None))
    monkeypatch.setattr(M, "cv_scores", lambda est, df, fold_col, **kwargs: search(df, est, fold_col, **kwargs))
    with pytest.raises(StopIteration):
        q_models.m9(None, None)
    forests, boosted = seen["RandomForestRegressor"], seen["GBTRegressor"]
    assert len(forests) == 20 and min(m["numTrees"] for m in forests) >= 100 and max(m["maxDepth"] for m in forests) == 25
    assert len(boosted) == 25 and min(m["maxIter"] for m in boosted) >= 100 and {m["featureSubsetStrategy"] for m in boosted} == {
        "sqrt", "log2", "all"}
