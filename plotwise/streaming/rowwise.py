"""Row-wise listing cleaning on a file stream (no state, no watermark)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plotwise.functions import text as X
from plotwise.session import checkpoint_dir


def clean_listing_columns(df: DataFrame, kind: str = "flat") -> DataFrame:
    """The stateless part of listing preparation (T1-T6, T13), usable on a
    batch or a streaming DataFrame of raw text columns."""
    rate = "area" if kind == "flat" else "rate"
    floor = "floorNum" if kind == "flat" else "noOfFloor"
    return df.select(
        "listing_id",
        F.lit(kind).alias("property_type"),
        X.clean_society("society", None if kind == "flat" else "independent").alias("society"),
        X.parse_price("price").alias("price"),
        X.parse_rate(rate).alias("price_per_sqft"),
        X.leading_int("bedRoom").alias("bedRoom"),
        X.leading_int("bathroom").alias("bathroom"),
        X.balcony("balcony").alias("balcony"),
        F.lower(F.coalesce(F.col("additionalRoom"), F.lit("not available"))).alias("additionalRoom"),
        X.floor_number(floor, kind=kind).alias("floorNum"),
        X.categorise_age("agePossession").alias("agePossession"),
        "areaWithType", "furnishDetails", "features", "property_name", "facing",
    )


def clean_listing_stream(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str,
                         kind: str = "flat", fmt: str = "csv", checkpoint: str | None = None, once: bool = True):
    """Read new raw files as they arrive, clean them row by row and append
    Parquet. Progress lives in the checkpoint location (shared storage) so a
    restarted query resumes exactly where it stopped."""
    reader = spark.readStream.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    stream = reader.format(fmt).load(source_dir)
    out = clean_listing_columns(stream, kind)
    ckpt = checkpoint or (checkpoint_dir(spark).rstrip("/") + "/listing-stream")
    writer = out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", ckpt) \
        .outputMode("append")
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start()
