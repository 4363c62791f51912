"""Bit-sliced scatter and whitening against plain integer and double arithmetic."""
import math
import random

import numpy as np
from pyspark.sql import functions as F

from plotwise.llm import whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_x(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def test_cross_products_are_exact_for_small_and_wide_integers():
    rng = np.random.default_rng(1)
    for low, high, rows in ((0, 1, 3), (-50, 60, 200), (-(1 << 40), 1 << 40, 130), (5, 6, 64)):
        x = rng.integers(low, high, (rows, 5))
        s, c = whitening.cross_products(x)
        wide = x.astype(object)
        assert s == wide.sum(axis=0).tolist()
        assert c == (wide.T @ wide).tolist()


def rows_of(seed=0, n=500, d=20):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.1 * (k + 1)) for k in range(d)], 0) for i in range(n)]
    rows += [(n + i, rows[7][1], 0) for i in range(n // 2)]  # one vector on a third of the rows
    bad = [(9000, None, 0), (9001, [None] + [0.0] * (d - 1), 0), (9002, [float("nan")] * d, 0),
           (9003, [float("inf")] + [0.0] * (d - 1), 0), (9004, [0.1] * 3, 0), (9005, [], 0)]
    return rows, bad, [(None, rows[3][1], None), (3, rows[4][1], 0)]


def test_whitening_equals_numpy(spark):
    good, bad, odd = rows_of()
    df = spark.createDataFrame(good + bad + odd, VECTORS).withColumn("x", F.lit("clash")).withColumn("n", F.lit("clash")).repartition(7)
    got = whitening.whiten(df).collect()
    keep = good + odd
    assert len(got) == 16 * len(keep)
    xs = np.array(sorted({tuple(plain_x(v)) for _, v, _ in keep}))
    n, s = len(xs), xs.sum(axis=0)
    cov = np.cov((xs - 1_000_000).T, bias=True)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    deviation = {}
    for i, v, _ in keep:
        deviation.setdefault(i, set()).add(sum((n * a - int(b)) ** 2 for a, b in zip(plain_x(v), s)))
    white = {}
    for r in got:
        assert r.n == n and r.deviation in deviation[r.vec_id] and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-9 * r.explained + 1e-15
        white.setdefault((r.vec_id, r.deviation), {})[r.component] = r.whitened
    at = {(i, sum((n * a - int(b)) ** 2 for a, b in zip(plain_x(v), s))): v for i, v, _ in keep}
    w = np.array([[white[k][c] for c in range(1, 17)] for k in at])
    z = np.array([[a - b / n for a, b in zip(plain_x(at[k]), s.tolist())] for k in at])
    # each component is an eigenvector: whitened * sqrt(e) is linear in z with a unit eigenvector as its weights
    e, *_ = np.linalg.lstsq(z, w * np.sqrt(values[:16]), rcond=None)
    assert np.abs(cov @ e - e * values[:16]).max() < 1e-6 * values[0]
    assert np.abs(np.linalg.norm(e, axis=0) - 1).max() < 1e-9


def test_nothing_to_whiten(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(empty).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], VECTORS)).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in sorted(same)] == [
        (i, c, 1, 0, None, None) for i in (1, 2) for c in (1, 2)]
    # a second direction that never varies
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0], 0) for i in range(5)], VECTORS)).collect()
    assert all((r.whitened is None) == (r.component == 2) and abs(r.explained - (r.component == 1)) < 1e-12 for r in flat)
    assert max(r.identity_error for r in flat) < 1e-9
    # sums of squares beyond a long
    far = whitening.whiten(spark.createDataFrame([(i, [1e9 * i, 3e38], 0) for i in range(3)], VECTORS)).collect()
    assert all(r.deviation is None for r in far if r.vec_id != 1)


def test_a_result_of_whole_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = whitening.whiten(df).collect()
    assert len(rows) == 16 * df.count() and rows[0].identity_error < 1e-6
