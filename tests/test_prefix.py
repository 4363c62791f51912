"""Ranks and running totals over range partitions."""
import random

import pytest
from pyspark.sql import functions as F

from plotwise.operators import prefix as P
from plotwise.operators import ranking as W


def table(spark, n=3000, seed=0):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["é", "a", "b", "", None]), rng.choice([1.5, -2.0, None, float("inf")]), rng.randrange(50)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, name string, x double, v long").repartition(7)


@pytest.mark.parametrize("parts", [None, 1, 13])
def test_composite_tied_orders_of_texts(spark, parts):
    rows, df = table(spark)
    order = [F.desc_nulls_last("name"), F.asc_nulls_first("x"), "id"]
    got = P.running_totals(df, order, {"total": "v", "n": F.lit(1)}, parts=parts).collect()
    low = lambda v, none: (v is not None, v) if none else (v is None, v)
    want = sorted(rows, key=lambda r: (low(r[2], True), r[0]))
    want = sorted(want, key=lambda r: (r[1] or "").encode(), reverse=True)
    want = [r for r in want if r[1] is not None] + [r for r in want if r[1] is None]
    total = 0
    at = {r.id: r for r in got}
    for i, r in enumerate(want):
        total += r[3]
        assert (at[r[0]].total, at[r[0]].n) == (total, i + 1)
    assert len(got) == len(rows)


def test_peers_share_their_total(spark):
    df = spark.createDataFrame([(i % 4, 1) for i in range(4000)], "k int, v int").repartition(5)
    got = {(r.k, r.t) for r in P.running_totals(df, ["k"], {"t": "v"}, ties="peers", parts=3).collect()}
    assert got == {(k, 1000 * (k + 1)) for k in range(4)}
    with pytest.raises(ValueError):
        P.running_totals(df, ["k"], {"t": "v"}, ties="none")


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 5), (4, None)], "k int, v int")
    assert [r.t for r in P.running_totals(df, ["k"], {"t": "v"}, parts=4).orderBy("k").collect()] == [None, None, 5, 5]
    assert P.global_rank(df.limit(0), ["k"]).collect() == []


def test_no_unpartitioned_window_over_data(spark):
    _, df = table(spark)
    for out in (P.global_rank(df, ["name", "id"]), W.rank_of_key(df, "name", "v"), W.cumulative_share(df, "id")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan.replace("Exchange SinglePartition, ENSURE_REQUIREMENTS, [plan_id", "") or "Window" not in [
            line for line in plan.split("\n") if "SinglePartition" in line]
        optimized = out._jdf.queryExecution().optimizedPlan().toString()
        for line in optimized.split("\n"):
            if "Window [" in line:
                assert "__part" in line.split("windowspecdefinition(")[1].split(",")[0]
