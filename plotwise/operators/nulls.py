"""Deduplication and null handling (survey 2.4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows (nulls equal), one row ``n_duplicates``.

    Two aggregates over the same scan: ``count(*)`` and a count of the
    distinct rows (hash aggregate with map-side combine).
    """
    total = F.lit(df.select(F.count(F.lit(1))).scalar())
    distinct = df.distinct().select(F.count(F.lit(1))).scalar()
    return df.sparkSession.range(1).select((total - distinct).cast("long").alias("n_duplicates"))


def drop_duplicates(df: DataFrame, subset=None) -> DataFrame:
    """Whole-row (or subset) de-duplication; nulls compare equal."""
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


def null_counts(df: DataFrame, cols=None, total_col: str | None = "total") -> DataFrame:
    """D3: per-column null count in one aggregate, plus the total."""
    cols = cols or df.columns
    exprs = [F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    out = df.agg(*exprs)
    if total_col:
        out = out.withColumn(total_col, sum(F.col(c) for c in cols))
    return out


def fill_constant(df: DataFrame, values: dict) -> DataFrame:
    """``fillna`` with a constant per column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
                           for c, v in values.items()})


def update_from(df: DataFrame, patch: DataFrame, key: str, cols) -> DataFrame:
    """Pandas ``update``: overwrite only where the patch has a non-null
    value, aligned on ``key``. One left join plus ``coalesce``.
    """
    p = patch.select(key, *[F.col(c).alias(f"__new_{c}") for c in cols])
    out = df.join(p, on=key, how="left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(f"__new_{c}").cast(df.schema[c].dataType), F.col(c)))
    return out.drop(*[f"__new_{c}" for c in cols])
