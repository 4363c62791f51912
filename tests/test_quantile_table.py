"""Exact quantiles of many columns and groups at once, against numpy."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwise.operators import aggregates as A
from plotwise.operators import quantiles as Q

T = "g string, h int, x double, y double, z long"


def rows(seed=0, n=4000):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else f"g{rng.randrange(12)}"
        x = rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) * 1e12, 7.0, -0.0])
        out.append((g, rng.randrange(2), x, rng.random() if rng.random() < 0.9 else None, rng.randrange(4)))
    return out + [("only null", 0, None, None, None), (None, 0, 1.0, 1.0, 1)]


TARGETS = [("x25", "x", 0.25), ("x50", "x", 0.5), ("y0", "y", 0.0), ("y99", "y", 0.99), ("y1", "y", 1.0), ("z50", "z", 0.5)]


def want(data, col, q):
    at = {"x": 2, "y": 3, "z": 4}[col]
    v = [r[at] for r in data if r[at] is not None]
    return None if not v else float(np.quantile(np.array(v, float), q))


@pytest.mark.parametrize("accuracy,groups", [(10_000, 20_000), (50, 20_000), (50, 2)])
def test_groups_and_columns(spark, monkeypatch, accuracy, groups):
    monkeypatch.setattr(Q, "DRIVER_GROUPS", groups)  # 2: statistics stay a table
    data = rows()
    df = spark.createDataFrame(data, T).repartition(6)
    for keys in ([], ["g"], ["g", "h"]):
        got = Q.quantile_table(df, keys, TARGETS, accuracy=accuracy).collect()
        at = {"g": 0, "h": 1}
        seen = {tuple(r[at[k]] for k in keys) for r in data if all(r[at[k]] is not None for k in keys)}
        assert {tuple(r[k] for k in keys) for r in got} == seen and len(got) == len(seen)
        for r in got:
            own = [d for d in data if all(d[at[k]] == r[k] for k in keys)]
            for name, c, q in TARGETS:
                expected = want(own, c, q)
                assert r[name] is None if expected is None else r[name] == pytest.approx(expected, rel=1e-12, abs=1e-12)


def test_empty_tables_and_single_values(spark):
    df = spark.createDataFrame([], T)
    assert Q.quantile_table(df, [], TARGETS).first().asDict() == {n: None for n, _, _ in TARGETS}
    assert Q.quantile_table(df, ["g"], TARGETS).collect() == []
    one = spark.createDataFrame([("a", 1, 5.0, None, 3)], T)
    r = Q.quantile_table(one, ["g"], TARGETS).first()
    assert (r.x25, r.x50, r.y0, r.z50) == (5.0, 5.0, None, 3.0)


def test_a_missed_bracket_is_opened(spark):
    data = rows(3)
    df = spark.createDataFrame(data, T).repartition(4)
    # a margin of nothing and a coarse sketch: brackets are single values, mostly the wrong ones
    got = Q.quantile_table(df, ["g"], TARGETS, accuracy=3, margin=0.0).collect()
    for r in got:
        own = [d for d in data if d[0] == r.g]
        for name, c, q in TARGETS:
            expected = want(own, c, q)
            assert r[name] is None if expected is None else r[name] == pytest.approx(expected, rel=1e-12, abs=1e-12)


def test_rows_are_not_shuffled_by_their_group(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/lineitem.parquet")
    out = Q.quantile_table(df, ["l_returnflag"], [("q", "l_extendedprice", 0.5), ("r", "l_quantity", 0.5)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("FileScan") <= 1
    for line in plan.split("\n"):
        if "Exchange hashpartitioning" in line:
            assert "l_returnflag" in line


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([("b", 2.0, None, "x"), ("a", 10.0, None, "x"), (None, 10.0, None, "x"), ("a", None, None, "y")],
                               "`t x` string, d double, e int, top string")
    got = {r.column_name: r for r in A.profile(df).collect()}
    assert (got["t x"].n, got["t x"].nulls, got["t x"].n_distinct, got["t x"].top) == (3, 1, 2, "a")
    assert (got["d"].top, got["d"].p50, got["e"].n_distinct, got["e"].top, got["e"].mean) == ("10.0", 10.0, 0, None, None)
    tops = [(r.column_name, r["rank"], r.value, r["count"]) for r in A.top_values(df, ["d", "top"], 1).collect()]
    assert sorted(tops) == [("d", 1, "10.0", 2), ("top", 1, "x", 3)]
    over = A.profile_overview(spark.createDataFrame([(1, None), (1, None), (2, 3)], "a int, b int")).first()
    assert (over.n_rows, over.n_columns, over.n_missing, over.n_duplicates) == (3, 2, 2, 1)
    assert A.profile_overview(df.limit(0)).first().n_rows == 0
    modes = {r.k: r.mode for r in A.group_mode(spark.createDataFrame(
        [(1, "b"), (1, "a"), (1, None), (1, None), (2, None)], "k int, v string"), ["k"], "v").collect()}
    assert modes == {1: "a", 2: None}
