"""A key holding a third of all rows: results stay exact and whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwise.operators import aggregates as A
from plotwise.operators import filters as Fl
from plotwise.operators import outliers as Q
from plotwise.operators import ranking as W


@pytest.fixture(scope="module")
def skewed(spark):
    n = 30000
    df = spark.range(n).select(
        F.col("id").alias("listing_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string")))
        .alias("sector"),
        (F.sin(F.col("id")) * 100 + 200).alias("price"),
        F.when(F.col("id") % 5 == 0, F.lit("Undefined")).otherwise(
            F.element_at(F.array(F.lit("New"), F.lit("Old"), F.lit("Mid")), (F.col("id") % 3 + 1).cast("int")))
        .alias("age"),
        F.when(F.col("id") % 2 == 0, "flat").otherwise("house").alias("property_type"))
    return df.repartition(8)


def test_hot_group_median_exact(spark, skewed):
    got = {r.sector: r.median_price for r in A.group_median(skewed, ["sector"], ["price"]).collect()}
    pdf = skewed.toPandas()
    exp = pdf.groupby("sector")["price"].median()
    assert set(got) == set(exp.index)
    for k, v in exp.items():
        assert got[k] == pytest.approx(v, rel=1e-12)


def test_hot_group_mode_impute_matches_rowwise(spark, skewed):
    out = {r.listing_id: r.age for r in
           Q.mode_impute(skewed, "age", [("sector", "property_type"), ("sector",), ("property_type",)])
           .select("listing_id", "age").collect()}
    pdf = skewed.toPandas()
    cur = pdf["age"].copy()
    for keys in [["sector", "property_type"], ["sector"], ["property_type"]]:
        tmp = pdf[keys].copy()
        tmp["v"] = cur
        modes = tmp.dropna(subset=["v"]).groupby(keys)["v"].agg(lambda s: sorted(s.mode())[0])
        looked = tmp.join(modes.rename("m"), on=keys)["m"]
        cur = np.where(cur == "Undefined", looked, cur)
        cur = pdf["age"].__class__(cur, index=pdf.index)
    for lid, v in zip(pdf["listing_id"], cur):
        assert out[lid] == v


def test_hot_key_top_k_and_frequency(spark, skewed):
    req = skewed.groupBy("sector").agg(F.avg("price").alias("target")).select(
        F.col("sector").alias("request_id"), "sector", "target")
    out = W.nearest_k_batch(skewed, req, ["sector"], "price", "target", 3, tie="listing_id")
    per = {r.request_id: r["count"] for r in out.groupBy("request_id").count().collect()}
    assert per["hot"] == 3 and len(per) == 98
    kept = Fl.frequent_keys(skewed, "sector", 10000)
    assert kept.count() == 10000 and kept.select("sector").distinct().first()[0] == "hot"


def test_quantiles_collapse_ties(spark):
    """Constant and few-valued columns: exact, and no list of tied rows in the plan."""
    from pyspark.sql import functions as F

    from plotwise.operators.quantiles import grouped_quantiles
    df = spark.range(20_000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.lit(7.0).alias("c"),
                                    (F.col("id") % 50).cast("double").alias("f"))
    for col in ("c", "f"):
        got = {r.g: (r.q0, r.q1) for r in grouped_quantiles(df, ["g"], col, [0.25, 0.5]).collect()}
        want = {r.g: tuple(r.q) for r in df.groupBy("g").agg(F.percentile(col, [0.25, 0.5]).alias("q")).collect()}
        assert got == want
