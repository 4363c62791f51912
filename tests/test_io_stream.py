"""Sources/sinks, the streaming reuse of the row-wise cleaners, and the
end-to-end preparation chain."""

import os

from pyspark.sql import functions as F

from plotwise.session import checkpoint_dir
from plotwise.sources import io


def _scratch(spark, name):
    return checkpoint_dir(spark).rstrip("/") + f"/test-{name}-{os.getpid()}"


def test_csv_roundtrip_with_schema(spark):
    base = _scratch(spark, "csv")
    src = spark.createDataFrame([("Flat in Sector 1 Gurgaon", 'A "quoted", name', "85 Lac", "nan")],
                                "property_name string, society string, price string, facing string")
    src.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(base)
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(c, T.StringType()) for c in src.columns])
    back = io.read_csv(spark, base, schema).first()
    assert back.society == 'A "quoted", name' and back.facing is None


def test_metrics_json_and_table(spark):
    path = _scratch(spark, "metrics")
    io.write_metrics_json(spark, {"r2": 0.9, "mae": 0.5}, path)
    r = spark.read.json(path).first()
    assert r.r2 == 0.9 and r.mae == 0.5
    tpath = _scratch(spark, "table")
    io.write_table(spark.range(5), tpath, partition_by=None)
    assert spark.read.parquet(tpath).count() == 5


def test_stream_reuses_row_wise_cleaning(spark):
    from plotwise.streaming import clean_listing_stream
    src, sink = _scratch(spark, "stream-src"), _scratch(spark, "stream-sink")
    rec = {f.name: None for f in io.RAW_FLAT_SCHEMA.fields}
    rec.update(listing_id=1, property_name="Flat in Sector 36 Gurgaon", society="DLF 4.1 ★", price="85 Lac",
               area="₹ 8,500/sq.ft.", bedRoom="3 Bedrooms", bathroom="2 Bathrooms", balcony="No Balcony",
               floorNum="Ground of 4", agePossession="By 2025", furnishDetails="['1 Fan']", features="['Park']")
    raw = spark.createDataFrame([tuple(rec[f.name] for f in io.RAW_FLAT_SCHEMA.fields)], io.RAW_FLAT_SCHEMA)
    raw.write.mode("overwrite").parquet(src)
    q = clean_listing_stream(spark, src, io.RAW_FLAT_SCHEMA, sink, kind="flat", fmt="parquet",
                             checkpoint=_scratch(spark, "stream-ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(sink).first()
    assert (out.price, out.price_per_sqft, out.bedRoom, out.balcony, out.floorNum, out.agePossession) == (
        0.85, 8500.0, 3, "0", 0.0, "Under Construction")
    assert out.society == "dlf"


def test_prepare_chain_shape(spark, sf_small):
    from plotwise.plans.q_chain import x1
    out = x1(spark, sf_small)
    assert out.columns[1:] == ["property_type", "sector", "bedRoom", "bathroom", "balcony", "agePossession",
                               "built_up_area", "servant room", "store room", "furnishing_type", "luxury_category",
                               "floor_category", "price"]
    assert out.count() > 0
    assert out.filter(F.col("agePossession") == "Undefined").count() <= out.count()


def test_rejected_rows_are_kept_apart(spark):
    from pyspark.sql import types as T
    path = _scratch(spark, "rejected")
    lines = ["id,name,x", '1,"a, b",2.5', "2,nan,NA", "3,c", "4,d,1,2", "x,e,3", "5,f,", '6,"g ""q""",nan']
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType())])
    rows, rejected = io.read_csv_checked(spark, path, schema)
    got = {r.id: (r.name, r.x) for r in rows.collect()}
    assert got[1] == ("a, b", 2.5) and got[5] == ("f", None) and got[6][0] == 'g "q"'
    assert {r.line.split(",")[0] for r in rejected.select("line").collect()} >= {"3", "4", "x"}
    assert set(got) | {r.line[0] for r in rejected.collect()} == {1, 5, 6} | {2} & set(got) | {r.line[0] for r in rejected.collect()}
    assert rejected.filter("file is null").count() == 0


def test_a_scope_deletes_what_was_written_inside(spark):
    from plotwise.operators import aggregates as A
    from plotwise.session import cut_lineage, scope, shared_path

    def there(path):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    outside = cut_lineage(spark.range(3))
    with scope(spark):
        inside = cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
        path = inside.inputFiles()[0].rsplit("/", 1)[0]
        index = shared_path(spark, "something")
        inside.write.parquet(index)
        assert A.describe(inside, "x").first()["max"] == 8 and there(path) and there(index)
    assert not there(path) and not there(index) and outside.count() == 3
