"""Operator 13: whitening of embeddings from an exact, bit-sliced scatter.

Entries become integers, so that sums and cross-products are exact whatever
the order in which Spark adds them. A block of rows is cut into bit planes:
plane k of dimension j holds bit k of the entry less the block's least one,
for 64 rows in a word. The cross-product of two dimensions is then the sum,
over their pairs of planes, of 2^(k+k') times the ones in the AND of the two.
Blocks, tasks and the cluster add integers only; the sums are centred as
integers (n*XX - S*S) and become doubles just before the eigenvectors.

What the driver gets is d*(d+1)/2 integers for d dimensions, whatever the
number of rows; what is broadcast is d numbers for each component.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plotwise.llm.common import cut_lineage, ship

SCALE, OFFSET = 64, 1_000_000
#: Entries beyond these are held at them, so that no sum leaves a decimal of 38 digits.
LARGEST = 1 << 40
#: Rows whose planes are compared at once, and planes compared with all others at once.
BLOCK_ROWS, BLOCK_PLANES = 4096, 16
#: An eigenvalue below this part of the largest is no direction in which the rows vary.
LEAST_RATIO = 1e-12


class Whitening(NamedTuple):
    """What ``fit`` learns: row count, integer sums, the leading eigenvalues and their unit vectors (d x k)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integer_vector(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of every entry, from doubles; null for a vector that is null or holds a null or
    non-finite entry."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = F.transform(wide, lambda c: F.greatest(F.lit(-LARGEST - offset), F.least(
        F.lit(LARGEST - offset), F.floor(c * scale))) + offset)
    return F.when(~bad, held)


def integer_rows(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
                 offset: int = OFFSET) -> DataFrame:
    """(id, x) of the rows with a whole vector, kept as a table.

    Rows that repeat an id stay, as do null ids. The dimension is that of the
    most rows (the larger one of a tie): vectors of another length are left
    out, as no covariance takes them, and empty ones have no component.
    """
    found = cut_lineage(rows.select(F.col(id_col).alias("id"), integer_vector(F.col(vector_col), scale, offset).alias("x"))
                        .filter("size(x) > 0"))
    most = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.filter(F.size("x") == (most.d if most else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def bit_planes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The planes of the unsigned columns of ``u`` that hold a one: (planes x words, dimension of each, bit of each)."""
    n, d = u.shape
    padded = np.zeros((-(-n // 64) * 64, d), np.uint64)
    padded[:n] = u
    dims, bits, planes = [], [], []
    for j, top in enumerate(u.max(axis=0).tolist()):
        for k in range(int(top).bit_length()):
            plane = ((padded[:, j] >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)
            planes.append(np.packbits(plane).view(np.uint64))
            dims.append(j)
            bits.append(k)
    shape = (len(planes), len(padded) // 64)
    return np.array(planes, np.uint64).reshape(shape), np.array(dims, np.int64), np.array(bits, np.int64)


def cross_products(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact column sums and cross-products of the integer rows ``x``, by AND and popcount of bit planes."""
    n, d = x.shape
    low = x.min(axis=0)
    planes, dims, bits = bit_planes((x - low).astype(np.uint64))
    ones = np.bitwise_count(planes).sum(axis=1, dtype=np.int64)
    both = np.zeros((len(planes), len(planes)), np.int64)
    for at in range(0, len(planes), BLOCK_PLANES):
        part = planes[at:at + BLOCK_PLANES, None, :] & planes[None, at:, :]
        both[at:at + BLOCK_PLANES, at:] = np.bitwise_count(part).sum(axis=2, dtype=np.int64)
    upper = np.triu_indices(len(planes), 1)
    both[upper[1], upper[0]] = both[upper]
    # powers of two as Python integers where a product could leave 64 bits
    kind = object if len(bits) and 2 * int(bits.max()) + 3 + n.bit_length() > 62 else np.int64
    weight = np.zeros((len(planes), d), kind)
    weight[np.arange(len(planes)), dims] = [1 << int(k) for k in bits]
    own = (ones.astype(kind) @ weight).tolist() if len(planes) else [0] * d
    cross = (weight.T @ both.astype(kind) @ weight) if len(planes) else np.zeros((d, d), kind)
    # back from the shifted entries: x = u + low
    low = np.array(low.tolist(), object)
    own, cross = np.array(own, object), cross.astype(object)
    whole = cross + np.outer(low, own) + np.outer(own, low) + n * np.outer(low, low)
    return (own + n * low).tolist(), whole.tolist()


def _scatter(d: int, offset: int):
    """Batches of x to the task's sums: rows (i, j, total) for i <= j, of x less the offset; i = -1: sums, -2: the count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = _matrix(batch.column(0), d) - offset
            for at in range(0, len(x), BLOCK_ROWS):
                s, c = cross_products(x[at:at + BLOCK_ROWS])
                n, sums, cross = n + len(x[at:at + BLOCK_ROWS]), sums + np.array(s, object), cross + np.array(c, object)
        if n:
            i, j = np.triu_indices(d)
            rows = [(-2, 0, n), *((-1, k, v) for k, v in enumerate(sums.tolist())),
                    *zip(i.tolist(), j.tolist(), cross[i, j].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([str(r[2]) for r in rows], pa.string())], names=["i", "j", "total"])

    return run


def fit(rows: DataFrame, components: int = 16, offset: int = OFFSET) -> tuple[Whitening | None, DataFrame]:
    """(model, fit list) of ``integer_rows``: every distinct vector counts once. No rows: no model.

    Equal vectors combine before the shuffle, so one that fills a third of the rows is a row per task. The sign of a
    component is that of its largest entry, made positive.
    """
    distinct = cut_lineage(rows.select("x").distinct())
    first = distinct.first()
    if first is None:
        return None, distinct
    d = len(first.x)
    parts = distinct.mapInArrow(_scatter(d, offset), "i int, j int, total string")
    totals = {(r.i, r.j): int(r.total) for r in parts.groupBy("i", "j").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    n = totals[-2, 0]
    low = [totals[-1, j] for j in range(d)]
    cov = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = (n * totals[i, j] - low[i] * low[j]) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:min(components, d)]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return Whitening(n, [s + n * offset for s in low], np.maximum(values[order], 0.0), vectors,
                     float(np.trace(cov))), distinct


def _project(model: Whitening):
    """A function from integer rows to (exact n*x - S, whitened rows; nan along directions without variance)."""
    n, sums = model.n, np.array(model.sums, object)
    live = model.values > LEAST_RATIO * max(float(model.values.max(initial=0.0)), 1e-300)
    scale = np.where(live, 1.0 / np.sqrt(np.where(live, model.values, 1.0)), np.nan)

    def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        large = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, model.sums))
        if large < 1 << 62:
            off = n * x - sums.astype(np.int64)
        else:
            off = n * x.astype(object) - sums
        return off, (off.astype(np.float64) / n) @ model.vectors * scale

    return run


def _deviation(off: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; null where it does not fit a long."""
    most = int(max(abs(off.max(initial=0)), abs(off.min(initial=0))))
    if off.dtype != object and most * most * off.shape[1] < 1 << 63:
        return (off * off).sum(axis=1).tolist()
    wide = off.astype(object)
    return [v if v < 1 << 63 else None for v in (wide * wide).sum(axis=1).tolist()]


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest entry of the covariance of the whitened fit list less the identity, measured on its rows."""
    k, d = len(model.values), len(model.sums)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, total, sums, n = _project(model), np.zeros((k, k)), np.zeros(k), 0
        for batch in batches:
            w = project(_matrix(batch.column(0), d))[1]
            total, sums, n = total + w.T @ w, sums + w.sum(axis=0), n + len(w)
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(k * k + k), pa.int32()),
                                              "v": pa.array(np.concatenate([total.ravel(), sums]), pa.float64())})

    rows = distinct.mapInArrow(gram, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(k * k + k)
    for r in rows:
        v[r.at] = r.v
    mean = v[k * k:] / model.n
    off = v[:k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)
    return float(np.nanmax(np.abs(off))) if np.isfinite(off).any() else 0.0


def transform(rows: DataFrame, model: Whitening, error: float = 0.0) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row of ``integer_rows`` and component.

    Along a direction without variance ``whitened`` is null; where nothing varies at all ``explained`` is null too.
    ``deviation`` is null where the exact sum does not fit a long.
    """
    d, k = len(model.sums), len(model.values)
    share = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = _project(model)
        for batch in batches:
            off, white = project(_matrix(batch.column(1), d))
            r = len(off)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(r), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)),
                pa.array(np.full(r * k, model.n, np.int64)),
                pa.array(_deviation(off), pa.int64()).take(pa.array(np.repeat(np.arange(r), k))),
                pa.array(white.ravel(), from_pandas=True),
                pa.array(np.tile(share, r), from_pandas=True),
                pa.array(np.full(r * k, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "x").mapInArrow(
        run, f"id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, "
             "identity_error double")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16,
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``fit`` on all rows, then ``transform`` of all rows; columns of the input besides the two are not read.

    Null vectors and those with a null or non-finite entry give no rows; an empty table gives none.
    """
    x = integer_rows(rows, id_col, vector_col, scale, offset)
    model, distinct = fit(x, components, offset)
    if model is None:
        nothing = Whitening(1, [0], np.zeros(0), np.zeros((1, 0)), 0.0)
        return transform(x.limit(0), nothing).withColumnRenamed("id", id_col)
    return transform(x, model, identity_error(distinct, model)).withColumnRenamed("id", id_col)


ship(__name__)
