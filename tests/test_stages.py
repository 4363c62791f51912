"""Feature stages that are saved and loaded, against plain Python."""
import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plotwise.operators import models as M
from plotwise.operators import stages as S
from plotwise.sources import io

ROWS = "id long, kind string, size int, area double, `odd name` string, label double"


def rows(spark):
    data = [(i, "abcé"[i % 4] if i % 7 else None, i % 3 * 5, float(i), "x" if i % 2 else "y", float(i % 4) + (i % 3))
            for i in range(200)]
    return data, spark.createDataFrame(data, ROWS)


def arrays(df):
    return {r.id: r.v for r in df.select("id", vector_to_array("features").alias("v")).collect()}


def test_a_saved_pipeline_equals_the_fitted_one_and_plain_python(spark, tmp_path):
    data, df = rows(spark)
    pipe = S.feature_pipeline(["area"], ["kind", "size"], ["kind", "odd name"], ["kind"], ["id"], scale=True)
    fitted = pipe.fit(df)
    io.save_model(fitted, str(tmp_path / "m"))
    loaded = io.load_model(str(tmp_path / "m"))
    new = df.unionByName(spark.createDataFrame([(900, "zz", 7, None, None, None), (901, None, None, 3.0, "x", 1.0)], ROWS))
    got = arrays(loaded.transform(new))
    assert {k: list(map(str, v)) for k, v in got.items()} == {k: list(map(str, v)) for k, v in arrays(fitted.transform(new)).items()}
    kinds = sorted({r[1] for r in data if r[1] is not None})
    mean = sum(r[3] for r in data) / 200
    dev = math.sqrt(sum((r[3] - mean) ** 2 for r in data) / 200)
    prior = sum(r[5] for r in data) / 200
    encoded = {}
    for k in kinds:
        of = [r[5] for r in data if r[1] == k]
        s = 1 / (1 + math.exp(-(len(of) - 20) / 10))
        encoded[k] = s * sum(of) / len(of) + (1 - s) * prior
    for r in [*data, (901, None, None, 3.0, "x", 1.0)]:
        want = [(r[3] - mean) / dev, float(kinds.index(r[1])) if r[1] in kinds else -1.0,
                float([0, 5, 10].index(r[2])) if r[2] is not None else -1.0,
                *[float(r[1] == k) for k in kinds[1:]], float(r[4] == "y"), encoded.get(r[1], prior), float(r[0])]
        assert got[r[0]] == pytest.approx(want, abs=1e-9)
    assert math.isnan(got[900][0]) and got[900][1:6] == [-1.0, -1.0, 0.0, 0.0, 0.0]
    assert S.feature_names(loaded) == ["area_z", "kind", "size", "kind_b", "kind_c", "kind_é", "odd name_y", "kind", "id"]
    assert loaded.transform(new).columns == [*df.columns, "features"]


def test_encoder_and_forest_are_one_saved_model(spark, tmp_path):
    _, df = rows(spark)
    model = M.fit_pipeline(S.feature_pipeline(["area"], ["size"], ["kind"]), M.regressor("forest", numTrees=3, maxDepth=3), df)
    io.save_model(model, str(tmp_path / "m"))
    raw = df.drop("label").withColumn("kind", F.when(F.col("id") % 5 == 0, "never seen").otherwise(F.col("kind")))
    a = {r.id: r.prediction for r in model.transform(raw).collect()}
    b = {r.id: r.prediction for r in io.load_model(str(tmp_path / "m")).transform(raw).collect()}
    assert a == b and len(a) == 200


def test_no_limit_to_the_categories_and_a_hot_one(spark):
    n = 15_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), "id")).alias("c"),
                               (F.col("id") % 2).cast("double").alias("label"))
    model = S.feature_pipeline(onehot_cols=["c"]).fit(df)
    encoder = S.encoder_of(model)
    assert encoder.sizes["c"][0] == 10_001 and encoder.table.filter("value = 'hot'").first()["n"] == 5000
    assert [r.value for r in encoder.table.orderBy("index").limit(2).collect()] == ["c1", "c10"]
    features = model.transform(df).select("features").first().features
    assert features.size == 10_000 and type(features).__name__ == "SparseVector"


def test_empty_and_constant_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 2, 5.0, "x", 1.0), (2, None, 2, 5.0, "x", 2.0)], ROWS)
    model = S.feature_pipeline(["area"], ["kind"], ["kind", "odd name"], scale=True).fit(df)
    io.save_model(model, str(tmp_path / "m"))
    got = arrays(io.load_model(str(tmp_path / "m")).transform(df))
    assert got == {1: [0.0, -1.0, 0.0, 0.0], 2: [0.0, -1.0, 0.0, 0.0]}
    only_null = S.CategoryEncoder(ordinalCols=["kind"]).fit(df)
    only_null.write().overwrite().save(str(tmp_path / "n"))
    again = S.CategoryEncoderModel.load(str(tmp_path / "n"))
    assert [r["kind__ord"] for r in again.transform(df).collect()] == [-1.0, -1.0]
    assert S.CategoryEncoder(ordinalCols=["kind"]).fit(df.limit(0)).transform(df).count() == 2
