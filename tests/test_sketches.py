"""Stored, merged sketches against exact profiles."""
import random
from collections import Counter

import numpy as np

from plotwise.operators import sketches as S
from plotwise.session import shared_path

COLS = "day int, name string, x double, k long"


def table(spark, n=6000):
    rng = random.Random(1)
    rows = [(i % 3 if i % 5 else 0, rng.choice(["a"] * 30 + ["b"] * 9 + [f"n{i}", None]), rng.choice([rng.gauss(0, 5), None]), i % 700)
            for i in range(n)]
    return rows, spark.createDataFrame(rows, COLS).repartition(6)


def test_merged_days_equal_one_pass_over_all(spark):
    rows, df = table(spark)
    path = shared_path(spark, "sketches")
    S.sketch_profile(df, by=["day"]).write.parquet(path)
    kept = spark.read.parquet(path)
    whole = {r.column_name: r for r in S.estimates(S.merge_profiles(kept), qs=(0.1, 0.5, 0.99), k=2).collect()}
    assert set(whole) == {"name", "x", "k"}
    for i, c in enumerate(("name", "x", "k"), start=1):
        v = [r[i] for r in rows if r[i] is not None]
        r = whole[c]
        assert (r.n, r.nulls) == (len(v), len(rows) - len(v))
        assert abs(r.n_distinct - len(set(v))) <= 0.03 * len(set(v)) + 1
        if c == "name":
            assert r.quantiles is None and r.mean is None
            assert [(t["item"], t["count"]) for t in r.top] == Counter(v).most_common(2)
            continue
        assert (r.min, r.max) == (min(v), max(v)) and abs(r.mean - np.mean(v)) < 1e-9
        for q, found in zip((0.1, 0.5, 0.99), r.quantiles):
            rank = sum(x <= found for x in v) / len(v)
            assert abs(rank - q) < 0.02
    days = {(r.day, r.column_name): r.n for r in S.estimates(kept).collect()}
    assert days[1, "x"] == sum(r[0] == 1 and r[2] is not None for r in rows) and len(days) == 9


def test_nothing_and_nulls(spark):
    _, df = table(spark, 10)
    none = {r.column_name: r for r in S.estimates(S.sketch_profile(df.limit(0), ["x", "name"])).collect()}
    assert (none["x"].n, none["x"].n_distinct, none["x"].quantiles, none["name"].top) == (0, 0, None, [])
    assert S.sketch_profile(df.limit(0), by=["day"]).count() == 0
