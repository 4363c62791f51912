"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import sys
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plotwise.session import checkpoint_dir, cut_lineage  # noqa: F401  (re-exported)

#: Anything that is not a letter, mark or digit separates words.
WORD_GAP = r"[^\p{L}\p{M}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Lower-cased words of a text as an array; null, empty and wordless texts give an empty array."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP, " ")
    return F.array_remove(F.split(spaced, " "), "")


def word_hashes(text: Column) -> Column:
    """``words`` as 64-bit hashes."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """At most ``rows`` rows in a batch that goes to Python: documents are long, and the session's
    usual 10,000 of them would be held several times over (a smaller setting is left as it is)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int = 500):
    """``small_batches`` for the jobs that run inside the block; then the session's own setting again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship(module: str) -> None:
    """Send the functions of ``module`` to the executors by value, so that they need no installed copy."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for vocabularies and lookup tables."""
    return sys.modules.setdefault("plotwise_worker_cache", types.ModuleType("plotwise_worker_cache")).__dict__


ship(__name__)
