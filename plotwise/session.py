"""Session construction and lineage cutting.

The cluster owns ``spark.checkpoint.dir``; we only read it. A fallback is
set only when a local master has none (tests, laptops).
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of garbage-collected DataFrames are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "plotwise", extra: dict | None = None) -> SparkSession:
    """Return (or build) a session with AQE on and the UI off."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # local mode runs everything in the driver JVM; size it like an executor
        conf.setdefault("spark.driver.memory", "12g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` from the session. Where it is unset, a
    ``local`` master (tests, laptops: one machine) gets a private folder; on
    a cluster that would be invisible to the executors, so it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="plotwise-ckpt-")
        atexit.register(shutil.rmtree, conf, ignore_errors=True)
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


_CUTS: list[str] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and continue from it.

    Writes a compressed columnar table under this application's checkpoint
    folder and reads it back: smaller than serialised rows, column-pruned on
    read, with real size statistics for AQE, and it survives the loss of any
    executor. ``drop_cuts`` deletes the tables of the session.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/plotwise-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUTS.append(path)
    # the schema is known: to read it from the files would be a job of its own
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, for models, indexes and files of one run."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/plotwise-{name}-{uuid.uuid4().hex}"
    _CUTS.append(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside the block, the shuffle files of a write or an action are deleted when it ends, and not when the driver
    collects its garbage: a job of many steps holds the files of one step at a time."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Deletes what is written to the shared folder inside the block (lineage cuts, ``shared_path``) when it ends: build
    a result and write it within one. What is kept beyond, as an index, is built outside."""
    before = len(_CUTS)
    try:
        yield
    finally:
        drop_cuts(spark, before)


def drop_cuts(spark: SparkSession, before: int = 0) -> None:
    """Delete what ``cut_lineage`` and ``shared_path`` made, all but the first ``before`` paths; call it once their
    readers are done."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while len(_CUTS) > before:
        path = jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        path.getFileSystem(conf).delete(path, True)
