"""Ordering, top-k and window-like operators (survey 2.9).

Top-k is ``orderBy(...).limit(k)`` (a per-partition TakeOrdered, no full
sort). Per-group top-k is ``row_number() <= k``, for which Spark inserts a
map-side group limit before the shuffle, so even a hot group sends at most
k rows per map task. Running totals (W5, W6) only run over an already
aggregated table (one row per distinct value), never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plotwise.operators.joins import checked_broadcast
from plotwise.operators.prefix import global_rank, running_totals
from plotwise.session import cut_lineage


def top_k(df: DataFrame, order, k: int) -> DataFrame:
    """``sort_values(...).head(k)``; ``order`` must end with a unique tie key."""
    return df.orderBy(*order).limit(k)


def nearest_k(df: DataFrame, target: float, col: str, k: int = 5, equals: dict | None = None,
              range_col: str | None = None, low=None, high=None, tie: str = "listing_id") -> DataFrame:
    """Filter (F4) then the ``k`` rows closest to ``target``."""
    out = df
    for c, v in (equals or {}).items():
        out = out.filter(F.col(c) == v)
    if range_col is not None:
        out = out.filter(F.col(range_col).between(low, high))
    return out.withColumn("distance", F.abs(F.col(col) - F.lit(target))).orderBy("distance", tie).limit(k)


def nearest_k_batch(candidates: DataFrame, requests: DataFrame, on, value: str, target: str,
                    k: int = 5, request_id: str = "request_id", tie: str = "listing_id",
                    range_col: str | None = None, range_target: str | None = None, spread=1) -> DataFrame:
    """W2/W3 for a table of requests: equi-join on ``on`` (+ closed range),
    then the ``k`` nearest per request. AQE splits a skewed join key."""
    cond = [candidates[c] == requests[c] for c in on]
    if range_col is not None:
        cond.append(candidates[range_col].between(requests[range_target] - spread, requests[range_target] + spread))
    # requests are many or few: counted first, and broadcast if few
    requests = checked_broadcast(requests)
    joined = candidates.join(requests, on=cond, how="inner").select(
        requests[request_id], candidates[tie], candidates[value],
        F.abs(candidates[value] - requests[target]).alias("distance"))
    w = Window.partitionBy(request_id).orderBy("distance", tie)
    return joined.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rank_of_key(df: DataFrame, key: str, measure: str) -> DataFrame:
    """Position of every key by mean measure (desc, ties by key) and the
    number of keys. However many keys there are, no task ranks all of them."""
    means = cut_lineage(df.groupBy(key).agg(F.avg(measure).alias("mean_value")))
    ranked = global_rank(means, [F.desc("mean_value"), F.asc(key)], "rank")
    return ranked.withColumn("rank", F.col("rank").cast("int")).withColumn(
        "n_keys", means.select(F.count(F.lit(1))).scalar())


def rank_lookup(ranks: DataFrame, key: str, value) -> DataFrame:
    """The rank of one key; an unknown key yields a null rank ("N/A")."""
    probe = ranks.sparkSession.createDataFrame([(value,)], f"{key} string")
    return probe.join(ranks, on=key, how="left")


def cumulative_share(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Value counts in descending order with their running share.

    With ``n`` (the head the reference shows) the top n are taken first by a
    distributed top-k, so the running window sees n rows only; without it the
    running total goes over range partitions.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    order = [F.desc("count"), F.asc(col)]
    if n:
        total = counts.select(F.sum("count")).scalar()
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return counts.orderBy(*order).limit(n).withColumn("cum_share", F.sum("count").over(w) / total).orderBy(*order)
    counts = cut_lineage(counts)
    shares = running_totals(counts, order, {"cum_share": "count"})
    total = counts.select(F.sum("count")).scalar()
    return shares.withColumn("cum_share", F.col("cum_share") / total).orderBy(*order)


def running_total(df: DataFrame, order_col: str, value_col: str, out: str, buckets: int = 256) -> DataFrame:
    """Running sum of ``value_col`` in ascending ``order_col`` (distinct, numeric
    order keys), without a single-partition window.

    Equi-depth bucket bounds come from one sketch (a scalar subquery); each
    row's bucket is the number of bounds below it; the running sum is a window
    per bucket (about 1/buckets of the rows each) plus the total of all
    earlier buckets (a window over at most ``buckets`` rows). The bounds only
    decide where work is split, never the result.
    """
    probes = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.array_distinct(F.percentile_approx(F.col(order_col).cast("double"), probes, 10 * buckets))
                    ).scalar()
    x = F.col(order_col).cast("double")
    with_b = df.withColumn("__bounds", bounds).withColumn(
        "__b", F.size(F.filter(F.col("__bounds"), lambda b: b < x))).drop("__bounds")
    totals = with_b.groupBy("__b").agg(F.sum(value_col).alias("__t"))
    offsets = totals.select("__b", (F.sum("__t").over(Window.orderBy("__b").rowsBetween(
        Window.unboundedPreceding, -1))).alias("__off"))
    inner = F.sum(value_col).over(Window.partitionBy("__b").orderBy(order_col).rowsBetween(
        Window.unboundedPreceding, 0))
    return (with_b.withColumn("__run", inner).join(F.broadcast(offsets), on="__b")
            .withColumn(out, F.coalesce(F.col("__off"), F.lit(0)) + F.col("__run"))
            .drop("__b", "__run", "__off"))


def ecdf(df: DataFrame, col: str) -> DataFrame:
    """Cumulative count by value divided by *all* rows (nulls included).

    Runs over one row per distinct value; ``running_total`` splits even a
    continuous column's distinct values across tasks."""
    total = df.select(F.count(F.lit(1))).scalar()
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return running_total(counts, col, "count", "__cum").withColumn("ecdf", F.col("__cum") / total).drop("__cum")


def sort_index(df: DataFrame, key: str) -> DataFrame:
    """W7."""
    return df.orderBy(key)
