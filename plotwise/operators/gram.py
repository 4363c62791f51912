"""Linear models of many folds, penalties and feature sets from one pass over the rows (survey M2, M3, M6, V7).

Per fold, the sums of products of (1, features, label) are all that least
squares needs: the matrix of the training rows is the total less the fold's
own, for every fold, and leaving out features or adding a penalty changes the
matrix, not the rows. Each task multiplies its batches; what is shuffled is one
matrix per task and fold, and what reaches the driver one per fold (of the
number of features squared).

Sums are of values less a common shift (the first row's), so that columns far
from zero lose no digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F


class FoldGrams(NamedTuple):
    """For each fold the sums of products of (1, features..., label), all but the 1 less ``shift``."""

    names: list[str]
    folds: dict[int, np.ndarray]
    shift: np.ndarray


def fold_grams(df: DataFrame, features, label: str, fold: str, names=None) -> FoldGrams:
    """The Gram matrices of a vector column (or of a list of numeric columns) and the label, per fold. Rows with a null
    or NaN among them, or without a fold, are left out."""
    if isinstance(features, str):
        values = vector_to_array(features)
    else:
        names = list(features)
        values = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    rows = df.select(F.col(fold).cast("int").alias("fold"), F.concat(values, F.array(F.col(label).cast("double"))).alias("v"))
    rows = rows.filter(F.col("fold").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    first = rows.first()
    if first is None:
        return FoldGrams(list(names or []), {}, np.zeros(len(names or []) + 1))
    shift = np.array(first.v)
    d = len(shift) + 1
    names = list(names) if names is not None else [f"f{i}" for i in range(d - 2)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, d - 1) - shift
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            for f in np.unique(folds).tolist():
                part = x[folds == f]
                total[f] = total.get(f, 0) + part.T @ part
        upper = np.triu_indices(d)
        for f, m in total.items():
            yield pa.RecordBatch.from_pydict({"fold": pa.array(np.full(len(upper[0]), f, np.int32)),
                                              "at": pa.array(np.arange(len(upper[0]), dtype=np.int32)), "v": pa.array(m[upper])})

    sums = rows.mapInArrow(products, "fold int, at int, v double").groupBy("fold", "at").agg(F.sum("v").alias("v")).collect()
    upper, folds = np.triu_indices(d), {}
    for r in sums:
        m = folds.setdefault(r.fold, np.zeros((d, d)))
        m[upper[0][r.at], upper[1][r.at]] = m[upper[1][r.at], upper[0][r.at]] = r.v
    return FoldGrams(names, dict(sorted(folds.items())), shift)


def solve(m: np.ndarray, keep: list[int], alpha: float = 0.0) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of ``|y - Xw - b|^2 + alpha |w|^2`` from a matrix of sums; the intercept is free."""
    n = m[0, 0]
    centred = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / n
    xx, xy = centred[np.ix_(keep, keep)], centred[keep, -1]
    w = np.linalg.lstsq(xx + alpha * np.eye(len(keep)), xy, rcond=None)[0] if keep else np.zeros(0)
    return w, float((m[0, -1] - m[0, 1:][keep] @ w) / n)


def _held_out_r2(m: np.ndarray, keep: list[int], w: np.ndarray, b: float) -> float:
    """R² of the predictions on the rows that ``m`` sums."""
    weights = np.zeros(len(m))
    weights[0], weights[-1] = -b, 1.0
    weights[[k + 1 for k in keep]] = -w
    error = weights @ m @ weights
    return 1.0 - error / (m[-1, -1] - m[0, -1] ** 2 / m[0, 0])


def cv_r2(grams: FoldGrams, features=None, alpha: float = 0.0) -> tuple[float, float]:
    """M6: (mean, standard deviation) of R² over the folds, each predicted from the rows of all others."""
    keep = [grams.names.index(f) for f in (features if features is not None else grams.names)]
    whole = sum(grams.folds.values())
    scores = [_held_out_r2(m, keep, *solve(whole - m, keep, alpha)) for m in grams.folds.values()]
    return float(np.mean(scores)), float(np.std(scores))


def coefficients(grams: FoldGrams, features=None, alpha: float = 0.0) -> tuple[np.ndarray, float]:
    """M2: (coefficients, intercept) of the fit on all rows, on the original scale."""
    keep = [grams.names.index(f) for f in (features if features is not None else grams.names)]
    w, b = solve(sum(grams.folds.values()), keep, alpha)
    return w, float(b + grams.shift[-1] - grams.shift[:-1][keep] @ w)
