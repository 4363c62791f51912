"""Aggregations (survey 2.8) and frequency binning.

All of these are hash aggregates with map-side partial aggregation, so a
hot key is pre-combined in every map task before the shuffle. Exact
``percentile``/``median``/``mode`` keep a value->count map per group: their
memory grows with the *distinct* values of the measure (prices in 2 dp,
integer areas, a handful of categories), not with rows. ``approx=True``
switches quantiles to ``percentile_approx`` (fixed-size sketches) for
measures with unbounded distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.functions import numeric
from plotwise.functions.recode import cut_left_closed
from plotwise.operators.joins import grouped_side
from plotwise.operators.quantiles import computed_once, grouped_quantiles, quantile_table
from plotwise.session import cut_lineage


def _q(col: str, q, approx: bool, accuracy: int = 10000) -> Column:
    if approx:
        return F.percentile_approx(F.col(col), q, accuracy)
    return F.percentile(F.col(col), q)


def value_counts(df: DataFrame, col: str, normalize: bool = False, out: str = "count") -> DataFrame:
    """A1/A2: counts by value, nulls excluded, descending (ties by value).

    With ``normalize`` the share of the non-null total is added; the total is a
    scalar subquery over the small grouped result, not a window.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))
    if normalize:
        total = counts.select(F.sum(out)).scalar()
        counts = counts.withColumn("share", F.col(out) / total)
    return counts.orderBy(F.desc(out), F.asc(col))


def kpis(df: DataFrame, price: str = "price", key: str = "sector", area: str = "built_up_area",
         approx: bool = False) -> DataFrame:
    """A3: rows, median price (2 dp), distinct keys, median area, in one pass."""
    if approx:
        return df.agg(
            F.count(F.lit(1)).alias("total_properties"),
            F.round(_q(price, 0.5, approx), 2).alias("median_price"),
            F.countDistinct(key).alias("n_sectors"),
            _q(area, 0.5, approx).alias("median_area"),
        )
    medians = quantile_table(df, [], [("p", price, 0.5), ("a", area, 0.5)])
    mp, ma = medians.select("p").scalar(), medians.select("a").scalar()
    n_keys = df.select(key).filter(F.col(key).isNotNull()).distinct().select(F.count(F.lit(1))).scalar()
    return df.agg(F.count(F.lit(1)).alias("total_properties")).select(
        "total_properties", F.round(mp, 2).alias("median_price"), n_keys.alias("n_sectors"), ma.alias("median_area"))


def group_mean(df: DataFrame, keys, measures) -> DataFrame:
    """A4."""
    return df.groupBy(*keys).agg(*[F.avg(m).alias(f"mean_{m}") for m in measures])


def group_median(df: DataFrame, keys, measures, approx: bool = False, method: str = "bounded") -> DataFrame:
    """A5: median per group.

    ``bounded`` (default): exact, O(accuracy) memory per group even for a
    hot group of continuous values (``quantiles.grouped_quantiles``);
    ``builtin``: Spark's exact ``percentile`` (memory = distinct values per
    group); ``approx=True``: ``percentile_approx``.
    """
    if approx or method == "builtin":
        return df.groupBy(*keys).agg(*[_q(m, 0.5, approx).alias(f"median_{m}") for m in measures])
    return quantile_table(df, keys, [(f"median_{m}", m, 0.5) for m in measures])


def crosstab(df: DataFrame, row: str, col: str, values) -> DataFrame:
    """Zero-filled counts, one column per given value of ``col``."""
    out = df.groupBy(row).pivot(col, values).count()
    return out.fillna(0, subset=[str(v) for v in values])


def pivot_mean(df: DataFrame, row: str, col: str, measure: str, values) -> DataFrame:
    """``pivot_table(index, columns, values, mean)``."""
    return df.groupBy(row).pivot(col, values).agg(F.avg(measure))


def describe(df: DataFrame, col: str, approx: bool = False, method: str = "bounded") -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear), max."""
    moments = df.agg(F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                     F.min(col).alias("min"), F.max(col).alias("max"))
    if approx or method == "builtin":
        qs = df.agg(_q(col, [0.25, 0.5, 0.75], approx).alias("__q")).select(
            F.col("__q")[0].alias("p25"), F.col("__q")[1].alias("p50"), F.col("__q")[2].alias("p75"))
    else:
        qs = grouped_quantiles(df, [], col, [0.25, 0.5, 0.75]).select(
            F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    return moments.select("count", "mean", "std", "min", qs.select("p25").scalar().alias("p25"),
                          qs.select("p50").scalar().alias("p50"), qs.select("p75").scalar().alias("p75"), "max")


def quantiles(df: DataFrame, col: str, qs, approx: bool = False, method: str = "bounded") -> DataFrame:
    """One row per requested quantile (linear interpolation)."""
    if approx or method == "builtin":
        arr = df.agg(_q(col, list(qs), approx).alias("v"))
    else:
        arr = grouped_quantiles(df, [], col, list(qs)).select(F.array(*[F.col(f"q{i}") for i in range(len(qs))])
                                                           .alias("v"))
    return arr.select(F.posexplode("v").alias("i", "value")).select(
        F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("i") + 1).alias("q"), "value")


def moments(df: DataFrame, col: str, log: bool = False) -> DataFrame:
    """A10: bias-corrected sample skewness and kurtosis (raw or on log1p)."""
    x = F.log1p(F.col(col)) if log else F.col(col)
    return df.select(x.alias("__x")).agg(numeric.sample_skew("__x").alias("skew"),
                                          numeric.sample_kurt("__x").alias("kurt"))


def corr_matrix(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation of every pair in one aggregate, then long."""
    pairs = [(a, b) for a in cols for b in cols]
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    stack = ", ".join(f"'{a}', '{b}', `{i}`" for i, (a, b) in enumerate(pairs))
    return row.selectExpr(f"stack({len(pairs)}, {stack}) as (col_a, col_b, corr)")


def corr_with(df: DataFrame, cols, target: str) -> DataFrame:
    """Each column against the target, sorted descending."""
    return corr_matrix(df, list(cols) + [target]).filter(
        (F.col("col_b") == target) & (F.col("col_a") != target)).select(
        F.col("col_a").alias("feature"), "corr").orderBy(F.desc("corr"), "feature")


def histogram(df: DataFrame, col: str, nbins: int) -> DataFrame:
    """Equal-width bins between min and max; the last edge is inclusive.

    min/max come from one scalar subquery; empty bins are kept by a left join
    from the (nbins-row) bin list.
    """
    stats = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    lo = stats.select("lo").scalar()
    hi = stats.select("hi").scalar()
    width = (hi - lo) / F.lit(float(nbins))
    b = F.least(F.floor(numeric.safe_div(F.col(col) - lo, width)), F.lit(nbins - 1))
    b = F.coalesce(b, F.when(F.col(col).isNotNull(), F.lit(0)))
    counts = df.filter(F.col(col).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    bins = df.sparkSession.range(nbins).select(F.col("id").cast("int").alias("bin"))
    return (bins.join(counts, on="bin", how="left")
            .select("bin", (lo + F.col("bin") * width).alias("left"), (lo + (F.col("bin") + 1) * width).alias("right"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def box_stats(df: DataFrame, col: str, by=None, k: float = 1.5) -> DataFrame:
    """Quartiles, Tukey whiskers clipped to the data, outlier count.

    Two aggregates: quartiles per group, then (after a join of the per-group
    fences back onto the rows) the whisker extremes and the outlier count.
    """
    by = list(by or [])
    x = F.col(col)
    df = computed_once(df.select(*by, col))
    if by:
        q = grouped_quantiles(df, by, col, [0.25, 0.5, 0.75]).select(
            *by, F.array("q0", "q1", "q2").alias("__q"))
        joined = df.join(grouped_side(q), on=by, how="inner")
    else:
        # one global set of quartiles: a scalar subquery, no join at all
        qv = grouped_quantiles(df, [], col, [0.25, 0.5, 0.75]).select(F.array("q0", "q1", "q2")).scalar()
        joined = df.withColumn("__q", qv)
    joined = joined.withColumns({"q1": F.col("__q")[0], "median": F.col("__q")[1], "q3": F.col("__q")[2]})
    joined = joined.withColumn("lo_fence", F.col("q1") - k * (F.col("q3") - F.col("q1"))).withColumn(
        "hi_fence", F.col("q3") + k * (F.col("q3") - F.col("q1")))
    inside = (x >= F.col("lo_fence")) & (x <= F.col("hi_fence"))
    return joined.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(x.isNotNull() & ~inside).alias("n_outliers"))


def rollup_sum(df: DataFrame, parent: str, child: str, measure: str) -> DataFrame:
    """Parent -> child totals (the data of a sunburst)."""
    return df.rollup(parent, child).agg(F.sum(measure).alias("total"), F.grouping_id().alias("level"))


def column_values(df: DataFrame, cols) -> DataFrame:
    """(i, text, number, whole, cnt): the count of each non-null value of each of ``cols`` (number i), all in one pass. A
    value is in the field of its kind: whole numbers, floating ones, and texts for anything else."""
    kinds = _numeric_columns(df)

    def cell(i, c):
        x, kind = F.col(f"`{c}`"), kinds.get(c)
        no = F.lit(None)
        return F.struct(F.lit(i).alias("i"), (no if kind in ("whole", "float") else x).cast("string").alias("text"),
                        (x if kind in ("float", "decimal") else no).cast("double").alias("number"),
                        (x if kind == "whole" else no).cast("bigint").alias("whole"))

    cells = F.array(*[cell(i, c) for i, c in enumerate(cols)])
    rows = df.select(F.explode(cells).alias("c")).filter("c.text is not null or c.number is not null or c.whole is not null")
    return rows.groupBy("c.i", "c.text", "c.number", "c.whole").agg(F.count(F.lit(1)).alias("cnt"))


def _shown(df: DataFrame, cols, value: str = "") -> Column:
    """The text of a cell of ``column_values``, as its column's own type writes it."""
    at = {f.name: f.dataType for f in df.schema.fields}
    out = F.coalesce(F.col(f"{value}text"), F.col(f"{value}whole").cast("string"), F.col(f"{value}number").cast("string"))
    for i, c in enumerate(cols):
        if at[c].typeName() == "float":
            out = F.when(F.col("i") == i, F.col(f"{value}number").cast("float").cast("string")).otherwise(out)
    return out


def _numeric_columns(df: DataFrame) -> dict[str, str]:
    kinds = {"byte": "whole", "short": "whole", "integer": "whole", "long": "whole", "float": "float", "double": "float",
             "decimal": "decimal"}
    return {f.name: kinds[f.dataType.typeName()] for f in df.schema.fields if f.dataType.typeName() in kinds}


def top_values(df: DataFrame, cols, k: int) -> DataFrame:
    """(column_name, rank, value, count, share of the non-null values) of the ``k`` most frequent values of each
    column, ties to the smallest (numbers by size)."""
    cols = list(cols)
    counts = cut_lineage(column_values(df, cols))
    order = Window.partitionBy("i").orderBy(F.desc("cnt"), "number", "whole", "text")
    best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    totals = counts.groupBy("i").agg(F.sum("cnt").alias("total"))
    return best.join(F.broadcast(totals), "i").select(
        F.get(F.array(*map(F.lit, cols)), F.col("i")).alias("column_name"), "rank", _shown(df, cols).alias("value"),
        F.col("cnt").alias("count"),
        (F.col("cnt") / F.col("total")).alias("share"))


def profile_overview(df: DataFrame, cols=None) -> DataFrame:
    """One row for the table: rows, columns, missing cells and their share, duplicate rows and their share."""
    cols = list(cols or df.columns)
    rows = df.select(*[F.col(f"`{c}`") for c in cols])
    # copies of a row combine before the shuffle; the distinct rows then count once each
    distinct = rows.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("__n"))
    missing = sum((F.when(F.col(f"`{c}`").isNull(), F.col("__n")).otherwise(0) for c in cols), F.lit(0))
    out = distinct.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
                       F.coalesce(F.sum(missing), F.lit(0)).alias("n_missing"))
    n = F.col("n_rows")
    return out.select("n_rows", F.lit(len(cols)).alias("n_columns"), "n_missing",
                      F.try_divide("n_missing", n * len(cols)).alias("missing_share"),
                      (n - F.col("n_distinct")).alias("n_duplicates"),
                      F.try_divide(n - F.col("n_distinct"), n).alias("duplicate_share"))


def distributions(df: DataFrame, cols) -> DataFrame:
    """(column_name, value, count) of every value of the named columns (few values each), in one pass."""
    cols = list(cols)
    return column_values(df, cols).select(F.get(F.array(*map(F.lit, cols)), F.col("i")).alias("column_name"),
                                          _shown(df, cols).alias("value"), F.col("cnt").alias("count")).orderBy("column_name", F.desc("count"), "value")


def profile(df: DataFrame, cols=None, approx: bool = False) -> DataFrame:
    """Per column: count, nulls, distinct values, most frequent value
    (ties -> smallest) and, for numeric columns, mean/std/min/max/quartiles.

    Rows that come out of a join are written once, narrowed to the columns. One
    plain aggregate carries the moments, one pass over (column, value) cells the
    distinct counts and top values of all columns, and one ``quantile_table``
    all quartiles.
    """
    cols = list(cols or df.columns)
    num = [c for c in cols if c in _numeric_columns(df)]
    df = computed_once(df.select(*[F.col(f"`{c}`") for c in cols]))
    exprs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        exprs += [F.count(x).alias(f"n{i}"), F.count_if(x.isNull()).alias(f"z{i}")]
        if c in num:
            exprs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                      F.min(x).cast("double").alias(f"lo{i}"), F.max(x).cast("double").alias(f"hi{i}")]
            if approx:
                exprs.append(_q(c, [0.25, 0.5, 0.75], approx).alias(f"q{i}"))
        if approx:
            exprs.append(F.approx_count_distinct(x).alias(f"d{i}"))
    row = df.agg(*exprs)
    if num and not approx:
        at = {c: i for i, c in enumerate(cols)}
        quartiles = quantile_table(df, [], [(f"{c}:{q}", F.col(f"`{c}`"), q) for c in num for q in (0.25, 0.5, 0.75)]).first()
        row = row.withColumns({f"q{at[c]}": F.array(*[F.lit(quartiles[f"{c}:{q}"]).cast("double") for q in (0.25, 0.5, 0.75)])
                               for c in num})
    parts = []
    for i, c in enumerate(cols):
        vals = ([F.col(f"m{i}"), F.col(f"s{i}"), F.col(f"lo{i}"), F.col(f"hi{i}"), F.col(f"q{i}")[0], F.col(f"q{i}")[1],
                 F.col(f"q{i}")[2]] if c in num else [F.lit(None)] * 7)
        parts.append(F.struct(F.lit(i).alias("i"), F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"),
                              F.col(f"z{i}").alias("nulls"), (F.col(f"d{i}") if approx else F.lit(0)).cast("bigint").alias("d"),
                              *[v.cast("double").alias(n) for v, n in
                                zip(vals, ["mean", "std", "min", "max", "p25", "p50", "p75"])]))
    long = row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    # the most frequent value, ties to the smallest: a number as a number, a text by code point
    best = F.min(F.struct((-F.col("cnt")).alias("c"), "number", "whole", "text"))
    values = column_values(df, cols).groupBy("i").agg(F.count(F.lit(1)).alias("exact"), best.alias("b")).select(
        "i", "exact", _shown(df, cols, "b.").alias("top"))
    return long.join(F.broadcast(values), "i", "left").select(
        "column_name", "n", "nulls", (F.col("d") if approx else F.coalesce("exact", F.lit(0))).cast("bigint").alias("n_distinct"),
        "top", "mean", "std", "min", "max", "p25", "p50", "p75")


def nunique(df: DataFrame, col: str) -> DataFrame:
    """Number of distinct non-null values."""
    return df.agg(F.countDistinct(col).alias("n_unique"))


def unique_sorted(df: DataFrame, col: str) -> DataFrame:
    """The sorted distinct values."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def ols_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares trend line y ~ x in one aggregate."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def group_mode(df: DataFrame, keys, col: str, out: str = "mode") -> DataFrame:
    """Most frequent non-null value per group, ties -> smallest; a group without values is null.

    Counts per (group, value) first, so that no task holds a group's values."""
    x = F.col(col)
    counts = df.groupBy(*keys, x.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    order = F.when(F.col("__v").isNotNull(), F.struct((-F.col("__c")).alias("c"), F.col("__v").alias("v")))
    return counts.groupBy(*keys).agg(F.min_by("__v", order).alias(out))


def binned_counts(df: DataFrame, col: str, edges, labels=None) -> DataFrame:
    """``pd.cut(right=False)`` then counts in bin order, empty bins kept."""
    labels = labels or [f"[{edges[i]}, {edges[i + 1]})" for i in range(len(edges) - 1)]
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, lab) for i, lab in enumerate(labels)], "bin_order int, bin string")
    counts = df.select(cut_left_closed(col, edges, labels).alias("bin")).filter(F.col("bin").isNotNull()) \
        .groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return (F.broadcast(bins).join(counts, on="bin", how="left")
            .select("bin_order", "bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
            .orderBy("bin_order"))


FREQUENCY_BANDS = [(">100", 101, None), ("50-100", 50, 100), ("10-49", 10, 49), ("2-9", 2, 9), ("1", 1, 1)]


def frequency_bins(df: DataFrame, key: str, bands=FREQUENCY_BANDS) -> DataFrame:
    """Number of keys whose count falls in each band (two-level groupBy)."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    exprs = []
    for label, lo, hi in bands:
        cond = n >= lo if hi is None else n.between(lo, hi)
        exprs.append(F.count_if(cond).alias(label))
    return counts.agg(*exprs)
