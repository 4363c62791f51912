"""The end-to-end preparation chain on the raw listing fixture (rows-only:
it contains the furnishing k-means fit)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotwise.functions import text as X
from plotwise.operators.filters import apply_patches
from plotwise.plans import fixtures as fx
from plotwise.plans.prepare import prepare
from plotwise.plans.registry import query


def raw_sources(spark, d):
    """Flats (even keys) and houses (odd keys) in the raw export layout."""
    r = fx.raw(spark, d)
    common = [F.col("listing_id"), F.col("property_name"), F.col("society"), F.col("price_text").alias("price"),
              F.col("area_text").alias("areaWithType"), F.col("bedroom_text").alias("bedRoom"),
              F.col("bathroom_text").alias("bathroom"), F.col("balcony_text").alias("balcony"),
              F.col("additional_room").alias("additionalRoom"), F.lit(None).cast("string").alias("facing"),
              F.col("age_possession").alias("agePossession"), F.col("furnish_details").alias("furnishDetails"),
              F.col("features")]
    flats = r.filter(F.col("listing_id") % 2 == 0).select(*common, F.col("rate_text").alias("area"),
                                                          F.col("floor_text").alias("floorNum"))
    houses = r.filter(F.col("listing_id") % 2 == 1).select(
        *common, F.col("rate_text").alias("rate"),
        F.concat((F.col("listing_id") % 4 + 1).cast("string"), F.lit(" Floor")).alias("noOfFloor"))
    apartments = r.filter(F.col("features").isNotNull() & F.col("society").isNotNull()).select(
        F.upper(X.clean_society("society")).alias("PropertyName"), F.col("features").alias("TopFacilities"))
    return flats, houses, apartments


def corrections(spark, d):
    """A row for each corrected cell of the raw listings; no value: the listing is dropped."""
    r = fx.raw(spark, d).select("listing_id")
    drop = r.filter(F.col("listing_id") % 97 == 0).select("listing_id", F.lit(None).cast("string").alias("column"),
                                                          F.lit(None).cast("string").alias("value"))
    bed = r.filter(F.col("listing_id") % 31 == 0).select("listing_id", F.lit("bedRoom").alias("column"),
                                                         (F.col("listing_id") % 4 + 1).cast("string").alias("value"))
    area = r.filter(F.col("listing_id") % 62 == 0).select("listing_id", F.lit("area").alias("column"),
                                                          (F.col("listing_id") % 900 + 300).cast("string").alias("value"))
    return drop.unionByName(bed).unionByName(area)


@query("f9_patch_map", fx.with_views("""
SELECT listing_id, CASE WHEN listing_id % 31 = 0 THEN CAST(listing_id % 4 + 1 AS VARCHAR) ELSE bedroom_text END AS "bedRoom",
  CASE WHEN listing_id % 62 = 0 THEN CAST(listing_id % 900 + 300 AS DOUBLE) ELSE CAST(length(area_text) AS DOUBLE) END AS area,
  society FROM raw WHERE listing_id % 97 <> 0""", "raw"))
def f9_map(spark, d):
    """Drops and patches of two columns, a text and a number, in one join."""
    r = fx.raw(spark, d).select("listing_id", F.col("bedroom_text").alias("bedRoom"),
                                F.length("area_text").cast("double").alias("area"), "society")
    return apply_patches(r, corrections(spark, d), "listing_id")


@query("x1_prepare_model_table")
def x1(spark, d):
    """With corrections, and the furnishing items that the data hold."""
    flats, houses, apartments = raw_sources(spark, d)
    return prepare(flats, houses, apartments, corrections=corrections(spark, d))
