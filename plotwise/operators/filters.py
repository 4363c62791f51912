"""Filters and predicates (survey 2.3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from plotwise.operators.joins import grouped_side


def drop_sentinel(df: DataFrame, col: str, sentinel: str) -> DataFrame:
    """``col != sentinel`` keeping nulls (pandas semantics)."""
    return df.filter(~F.col(col).eqNullSafe(F.lit(sentinel)))


def not_null(df: DataFrame, col: str) -> DataFrame:
    """F2."""
    return df.filter(F.col(col).isNotNull())


def threshold(df: DataFrame, col: str, op: str, value) -> DataFrame:
    """comparison filter; nulls are dropped."""
    c = F.col(col)
    cond = {"<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value,
            "==": c == value, "!=": c != value}[op]
    return df.filter(cond)


def match_and_range(df: DataFrame, equals: dict, col: str, low, high) -> DataFrame:
    """conjunctive equality plus a closed range."""
    conds = [F.col(k) == v for k, v in equals.items()] + [F.col(col).between(low, high)]
    return df.filter(reduce(lambda a, b: a & b, conds))


def all_null(cols):
    """F5 mask: every column null."""
    return F.coalesce(*[F.col(c) for c in cols]).isNull()


def any_null(cols):
    """F5 mask: at least one column null."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def contains(df: DataFrame, col: str, needle: str) -> DataFrame:
    """F6."""
    return df.filter(F.col(col).contains(needle))


def frequent_keys(df: DataFrame, key: str, min_count: int = 3) -> DataFrame:
    """keep rows whose key occurs at least ``min_count`` times.

    Counted with a partial/final aggregate (map-side combine) and applied with
    a left-semi join with the list of keys (``joins.grouped_side``).
    """
    keep = df.groupBy(key).count().filter(F.col("count") >= min_count).select(key)
    return df.join(grouped_side(keep), on=key, how="left_semi")


def exclude_value(df: DataFrame, col: str, value) -> DataFrame:
    """F8: ``col != value`` (nulls dropped, pandas ``!=`` on a filter keeps NaN
    rows only for the inverse mask, which the reference does not use)."""
    return df.filter(F.col(col) != value)


def drop_keys(df: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """F9 drops: remove rows listed in a corrections table (left anti)."""
    return df.join(corrections.select(key).distinct(), on=key, how="left_anti")


def patch_values(df: DataFrame, patches: DataFrame, key: str, col: str,
                 value_col: str = "value") -> DataFrame:
    """F9 patches: overwrite ``col`` where the patch table has a value."""
    p = patches.select(F.col(key), F.col(value_col).alias("__patch"))
    out = df.join(p, on=key, how="left")
    return out.withColumn(col, F.coalesce(F.col("__patch").cast(df.schema[col].dataType), F.col(col))).drop("__patch")


def apply_patches(df: DataFrame, corrections: DataFrame, key: str, column: str = "column", value: str = "value") -> DataFrame:
    """All corrections of a row in one keyed join.

    ``corrections`` has a row for each cell: a row of null ``value`` drops the
    listing, any other overwrites the named column, cast to its type (a text
    that doesn't fit leaves the cell as it was). They are folded to one map for
    each key; of several for a cell the largest value counts. Columns that
    ``df`` lacks are ignored.
    """
    cells = corrections.filter(F.col(key).isNotNull()).groupBy(F.col(key), F.col(column).alias("__c")).agg(
        F.max(F.col(value).cast("string")).alias("__v"), F.count_if(F.col(value).isNull()).alias("__d"))
    maps = cells.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("__c").isNotNull() & F.col("__v").isNotNull(),
                                                 F.struct("__c", "__v")))).alias("__patch"),
        (F.sum("__d") > 0).alias("__drop"))
    joined = df.join(grouped_side(maps), key, "left").filter(~F.coalesce("__drop", F.lit(False)))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return joined.select(*[
        F.col(f"`{c}`") if c == key else
        F.coalesce(F.try_element_at("__patch", F.lit(c)).try_cast(kinds[c]), F.col(f"`{c}`")).alias(c) for c in df.columns])
