"""Joins and unions (survey 2.7).

Broadcasts are explicit only for tables whose size is fixed by
construction (rule lists, weight tables, lookups of a given length) or
checked here; everything else is left to AQE, which converts a join to a
broadcast at run time only when it has measured the side to be small, and
splits skewed partitions otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from plotwise.session import cut_lineage

# Rows we accept to broadcast after counting them (a lookup table, not data).
BROADCAST_ROW_LIMIT = 1_000_000


BROADCAST_BYTE_LIMIT = 64 << 20


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT, byte_limit: int = BROADCAST_BYTE_LIMIT) -> DataFrame:
    """Broadcast only when the table is proven small in rows and text bytes; else leave it to AQE."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() == "string"]
    size = F.sum(reduce(lambda a, b: a + b, texts, F.lit(8 * len(df.columns)).cast("bigint")))
    r = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), size.alias("b")).first()
    return F.broadcast(df) if r.n <= limit and (r.b or 0) <= byte_limit else df


def grouped_side(df: DataFrame) -> DataFrame:
    """A grouped table to be joined back: computed once, and broadcast if that is proven small, so that
    the rows it came from are not shuffled by their group's key."""
    if "LocalRelation" in df._jdf.queryExecution().optimizedPlan().getClass().getName():
        return F.broadcast(df)  # rows that the driver holds already
    return checked_broadcast(cut_lineage(df))


def lookup_join(df: DataFrame, lookup: DataFrame, on, how: str = "inner",
                check_size: bool = True) -> DataFrame:
    """Join a fact table to a lookup table (geo coordinates, names)."""
    right = checked_broadcast(lookup) if check_size else lookup
    return df.join(right, on=on, how=how)


def fill_from(df: DataFrame, other: DataFrame, left_key, right_key: str, col: str,
              other_col: str) -> DataFrame:
    """Fill missing ``col`` from ``other`` matched on a lower-cased name.

    The right side is de-duplicated on the key first, so a left join can
    never multiply rows (the reference assigns by position and silently
    assumes unique names).
    """
    right = (other.select(F.lower(F.col(right_key)).alias("__k"), F.col(other_col).alias("__fill"))
             .groupBy("__k").agg(F.min("__fill").alias("__fill")))
    # a row for each name: rows without a name, or of one name, would meet in one task
    right = grouped_side(right)
    lk = F.lower(F.col(left_key)) if isinstance(left_key, str) else left_key
    out = df.withColumn("__k", lk).join(right, on="__k", how="left")
    return out.withColumn(col, F.coalesce(F.col(col), F.col("__fill"))).drop("__k", "__fill")


def join_on_key(df: DataFrame, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Two stages of the same data aligned on the row key."""
    return df.join(other, on=key, how=how)


def join_all(tables, on: str) -> DataFrame:
    """Chain of inner joins on one key (small importance tables)."""
    return reduce(lambda a, b: a.join(b, on=on, how="inner"), tables)


def semi_join(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """``isin`` of a key set."""
    return df.join(keys, on=on, how="left_semi")


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """Union of the sources by column name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
