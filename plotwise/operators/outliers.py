"""Outliers and imputation (survey 2.10).

Global bounds are scalar subqueries (one aggregate, no join); per-group
statistics are grouped aggregates joined back on the key, which AQE runs
as a broadcast when it measures the statistics small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plotwise.functions import rules
from plotwise.functions.numeric import half_even, price_per_sqft, safe_div
from plotwise.operators.joins import grouped_side
from plotwise.operators.quantiles import exact_quantile, grouped_quantiles
from plotwise.session import cut_lineage


def iqr_bounds(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Q1: one row ``q1, q3, iqr, lower, upper`` (exact, bounded memory)."""
    q = grouped_quantiles(df, [], col, [0.25, 0.75])
    return q.select(F.col("q0").alias("q1"), F.col("q1").alias("q3")).withColumn(
        "iqr", F.col("q3") - F.col("q1")).withColumn(
        "lower", F.col("q1") - k * F.col("iqr")).withColumn("upper", F.col("q3") + k * F.col("iqr"))


def with_outlier_flag(df: DataFrame, col: str, k: float = 1.5, out: str = "is_outlier") -> DataFrame:
    """Q1: flag values strictly outside the fences (bounds as scalar subqueries)."""
    b = iqr_bounds(df, col, k)
    lower, upper = b.select("lower").scalar(), b.select("upper").scalar()
    x = F.col(col)
    return df.withColumn(out, F.coalesce((x < lower) | (x > upper), F.lit(False)))


def iqr_outliers(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Q1: the outlier rows."""
    return with_outlier_flag(df, col, k).filter("is_outlier").drop("is_outlier")


def rescale_outliers(df: DataFrame, rate: str = "price_per_sqft", area: str = "area",
                     price: str = "price", below: float = 1000, factor: float = 9, k: float = 1.5) -> DataFrame:
    """Q2: rows whose rate is an IQR outlier and area < ``below`` get area x9;
    every flagged row gets its rate recomputed (half-even) from the new area."""
    flagged = with_outlier_flag(df, rate, k, "__out")
    new_area = F.when(F.col("__out") & (F.col(area) < below), F.col(area) * factor).otherwise(F.col(area))
    flagged = flagged.withColumn(area, new_area)
    new_rate = F.when(F.col("__out"), F.coalesce(price_per_sqft(price, area), F.col(rate))).otherwise(F.col(rate))
    return flagged.withColumn(rate, new_rate).drop("__out")


def ratio_medians(df: DataFrame, sup: str = "super_built_up_area", built: str = "built_up_area",
                  carp: str = "carpet_area") -> DataFrame:
    """Q3: median super/built and carpet/built where all three are present."""
    present = df.filter(F.col(sup).isNotNull() & F.col(built).isNotNull() & F.col(carp).isNotNull())
    return df.sparkSession.range(1).select(exact_quantile(present, safe_div(sup, built)).alias("super_to_built"),
                                           exact_quantile(present, safe_div(carp, built)).alias("carpet_to_built"))


def impute_built_up(df: DataFrame, sup: str = "super_built_up_area", built: str = "built_up_area",
                    carp: str = "carpet_area", s_ratio: float = rules.SUPER_TO_BUILT,
                    c_ratio: float = rules.CARPET_TO_BUILT) -> DataFrame:
    """Q4: fill a missing built-up area from super and/or carpet area."""
    s, b, c = F.col(sup), F.col(built), F.col(carp)
    est = (F.when(s.isNotNull() & c.isNotNull(), half_even(((s / s_ratio) + (c / c_ratio)) / 2, 0))
           .when(s.isNotNull(), half_even(s / s_ratio, 0))
           .when(c.isNotNull(), half_even(c / c_ratio, 0)))
    return df.withColumn(built, F.when(b.isNull(), est).otherwise(b))


def repair_anomaly(df: DataFrame, built: str = "built_up_area", price: str = "price", area: str = "area",
                   below: float = rules.ANOMALY_AREA_BELOW, above: float = rules.ANOMALY_PRICE_ABOVE) -> DataFrame:
    """Q5: small built-up area with a high price takes the listed area
    (a null area leaves the old value, as ``update`` does)."""
    cond = (F.col(built) < below) & (F.col(price) > above)
    return df.withColumn(built, F.when(cond, F.coalesce(F.col(area), F.col(built))).otherwise(F.col(built)))


def impute_constant(df: DataFrame, col: str, value: float = rules.FLOOR_FILL) -> DataFrame:
    """Q6: constant fill (the house median of the floor number)."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))


def impute_group_median(df: DataFrame, col: str, by=None) -> DataFrame:
    """Q6 variant: fill with the (group) median, computed by one aggregate."""
    if not by:
        return df.withColumn(col, F.coalesce(F.col(col), exact_quantile(df, col)))
    med = grouped_quantiles(df, by, col, [0.5]).withColumnRenamed("q0", "__med")
    return df.join(med, on=by, how="left").withColumn(col, F.coalesce(F.col(col), F.col("__med"))).drop("__med")


def mode_impute(df: DataFrame, col: str, passes, placeholder: str = rules.AGE_UNDEFINED) -> DataFrame:
    """Q7: replace ``placeholder`` by the mode of its group, pass by pass.

    Each pass sees the previous result; the mode counts the placeholder too
    (so it may change nothing); ties go to the smallest value; a row with a
    null key, or a group without a non-null value, becomes null.

    A pass only moves the placeholder rows of a group to one value, so every
    pass can be replayed exactly on the value counts per (all pass keys,
    original value) -- a table bounded by the key and value domains, not by
    rows. The big table is read once to count and joined once (null-safe on
    the keys) to the resulting (keys -> final value) map: one aggregate and
    one join for any number of passes. On the small count table each pass is
    two window aggregates (count per group value, then the arg-max per
    group), so the plan grows linearly with the passes.
    """
    all_keys = list(dict.fromkeys(k for p in passes for k in p))
    counts = cut_lineage(df.groupBy(*all_keys, F.col(col).alias("__orig")).agg(F.count(F.lit(1)).alias("__n"))
                         .withColumn("__cur", F.col("__orig")))
    for keys in passes:
        keys = list(keys)
        cur = F.col("__cur")
        per_value = F.sum(F.when(cur.isNotNull(), F.col("__n"))).over(Window.partitionBy(*keys, "__cur"))
        counts = counts.withColumn("__gv", per_value)
        # mode = value with the highest group count, ties -> smallest value
        order = F.struct((-F.col("__gv")).alias("c"), cur.alias("v"))
        mode = F.min_by(F.when(cur.isNotNull(), cur), F.when(cur.isNotNull(), order)).over(Window.partitionBy(*keys))
        any_null_key = F.lit(False)
        for k in keys:
            any_null_key = any_null_key | F.col(k).isNull()
        # a null key never matches its group in the reference, so it gets null
        mode = F.when(any_null_key, None).otherwise(mode)
        counts = counts.withColumn("__cur", F.when(cur == placeholder, mode).otherwise(cur)).drop("__gv")
    final = counts.filter(F.col("__orig") == placeholder).select(*[F.col(k).alias(f"__k_{k}") for k in all_keys],
                                                                 F.col("__cur").alias("__final"))
    final = grouped_side(final)
    cond = [df[k].eqNullSafe(final[f"__k_{k}"]) for k in all_keys]
    out = df.join(final, on=cond, how="left")
    out = out.withColumn(col, F.when(F.col(col) == placeholder, F.col("__final")).otherwise(F.col(col)))
    return out.drop("__final", *[f"__k_{k}" for k in all_keys])


def low_quantile_rows(df: DataFrame, num: str = "area", den: str = "bedRoom", q: float = 0.02,
                      rate: str = "price_per_sqft", rate_max: float = 20000, cutoff: float | None = None) -> DataFrame:
    """Q8: the ``q`` quantile of num/den over rows with rate <= rate_max, and the
    rows whose ratio falls below ``cutoff`` (default: that quantile)."""
    ratio = safe_div(num, den)
    base = df.filter(F.col(rate) <= rate_max).select(ratio.alias("__r"))
    qv = exact_quantile(base, "__r", q)
    limit = F.lit(cutoff) if cutoff is not None else qv
    return df.withColumn("ratio", ratio).withColumn("ratio_q", qv).filter(F.col("ratio") < limit)
