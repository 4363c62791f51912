"""Sources and sinks (survey 2.1, S1-S4).

CSV is read with an explicit schema (inference is not reproducible and
costs a pass); stage outputs are Parquet; models use MLlib persistence;
metrics are one-row JSON. Paths are whatever the cluster's shared storage
uses; nothing here writes to a machine-local folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

_STR = T.StringType()

# Raw listing exports: every column is text at ingest, plus our row key.
RAW_FLAT_SCHEMA = T.StructType([T.StructField(c, _STR) for c in [
    "property_name", "link", "society", "price", "area", "areaWithType", "bedRoom", "bathroom", "balcony",
    "additionalRoom", "address", "floorNum", "facing", "agePossession", "nearbyLocations", "description",
    "furnishDetails", "features", "rating", "property_id"]] + [T.StructField("listing_id", T.LongType())])

RAW_HOUSE_SCHEMA = T.StructType([T.StructField("rate" if f.name == "area" else
                                               "noOfFloor" if f.name == "floorNum" else f.name, f.dataType)
                                 for f in RAW_FLAT_SCHEMA.fields])

APARTMENT_SCHEMA = T.StructType([T.StructField(c, _STR) for c in [
    "PropertyName", "PropertySubName", "NearbyLocations", "LocationAdvantages", "Link", "PriceDetails",
    "TopFacilities"]])

GEO_SCHEMA = T.StructType([T.StructField("sector", _STR), T.StructField("coordinates", _STR)])

MODEL_SCHEMA = T.StructType([
    T.StructField("property_type", _STR), T.StructField("sector", _STR),
    T.StructField("price", T.DoubleType()), T.StructField("bedRoom", T.DoubleType()),
    T.StructField("bathroom", T.DoubleType()), T.StructField("balcony", _STR),
    T.StructField("agePossession", _STR), T.StructField("built_up_area", T.DoubleType()),
    T.StructField("servant room", T.DoubleType()), T.StructField("store room", T.DoubleType()),
    T.StructField("furnishing_type", _STR), T.StructField("luxury_category", _STR),
    T.StructField("floor_category", _STR)])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
             null_values=("nan", "NA"), multi_line: bool = False) -> DataFrame:
    """Header row, quoted fields with embedded commas, explicit schema; the
    text markers for missing values become null. ``multi_line`` allows line
    breaks within quotes, at the price of one task per file."""
    df = (spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", '"')
          .option("multiLine", multi_line).option("mode", "PERMISSIVE").csv(path))
    if null_values:
        from pyspark.sql import functions as F
        df = df.select(*[F.when(F.col(f"`{f.name}`").isin(list(null_values)), None)
                         .otherwise(F.col(f"`{f.name}`")).alias(f.name)
                         if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])
    return df


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, null_values=("nan", "NA"),
                     multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected). A line that does not fit the schema (too few or too many fields, a field that its type can't
    read) is not a row with nulls but rejected: (line, file), for a quarantine. The parsed file is written once to the
    shared folder, as Spark does not read the rejected lines alone from a text file."""
    from pyspark.sql import functions as F

    from plotwise.session import cut_lineage
    marked = T.StructType([*schema.fields, T.StructField("__line", _STR)])
    # marked texts for missing values are read as text and so fit any field only where they are nulls of the reader too
    reader = (spark.read.schema(marked).option("header", header).option("quote", '"').option("escape", '"')
              .option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__line"))
    if null_values:
        reader = reader.option("nullValue", list(null_values)[0])
    df = cut_lineage(reader.csv(path).withColumn("__file", F.input_file_name()))
    rows = df.filter(F.col("__line").isNull()).select(*[
        (F.when(~F.col(f"`{f.name}`").isin(list(null_values)), F.col(f"`{f.name}`")) if null_values and isinstance(
            f.dataType, T.StringType) else F.col(f"`{f.name}`")).alias(f.name) for f in schema.fields])
    return rows, df.filter(F.col("__line").isNotNull()).select(F.col("__line").alias("line"), F.col("__file").alias("file"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by=None) -> None:
    """Stage output (no index column exists to drop)."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def save_model(model, path: str) -> None:
    """S3: MLlib persistence (replaces pickles)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """S3: load any saved MLlib model; its class is in its metadata."""
    import importlib

    from pyspark.ml.util import DefaultParamsReader
    saved = DefaultParamsReader.loadMetadata(path, SparkSession.getActiveSession())["class"]
    module, name = saved.replace("org.apache.spark", "pyspark").rsplit(".", 1)
    return getattr(importlib.import_module(module), name).load(path)


def write_metrics_json(spark: SparkSession, metrics: dict, path: str) -> DataFrame:
    """One record of scalars as a single-row JSON file."""
    row = spark.createDataFrame([tuple(metrics.values())], list(metrics.keys()))
    row.coalesce(1).write.mode("overwrite").json(path)
    return row
