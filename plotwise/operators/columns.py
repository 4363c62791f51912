"""Projections and column management (survey 2.2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions import numeric


def drop_columns(df: DataFrame, cols) -> DataFrame:
    """P1."""
    return df.drop(*cols)


def rename_columns(df: DataFrame, mapping: dict) -> DataFrame:
    """P2."""
    return df.withColumnsRenamed(mapping)


def insert_column(df: DataFrame, loc: int, name: str, value) -> DataFrame:
    """Add a column at position ``loc`` (literal or Column)."""
    value = value if isinstance(value, Column) else F.lit(value)
    cols = [c for c in df.columns if c != name]
    cols.insert(loc, name)
    return df.withColumn(name, value).select(*cols)


def with_area(df: DataFrame, price: str = "price", rate: str = "price_per_sqft",
              out: str = "area", loc: int | None = None) -> DataFrame:
    """area = round_half_even(price * 1e7 / rate)."""
    expr = numeric.derive_area(price, rate)
    return insert_column(df, loc, out, expr) if loc is not None else df.withColumn(out, expr)


def with_rate(df: DataFrame, price: str = "price", area: str = "area",
              out: str = "price_per_sqft") -> DataFrame:
    """P4 inverse."""
    return df.withColumn(out, numeric.price_per_sqft(price, area))


def log_target(df: DataFrame, col: str = "price", out: str | None = None) -> DataFrame:
    """P5: log1p (and ``unlog_target`` for expm1)."""
    return df.withColumn(out or col, F.log1p(F.col(col)))


def unlog_target(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, F.expm1(F.col(col)))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, chosen by a seeded hash of the key.

    A hash order is independent of partitioning and task retries (unlike
    ``rand``); ``orderBy(..).limit`` runs as a per-partition top-k.
    """
    order = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))
    return df.orderBy(order, F.col(key)).limit(n)
