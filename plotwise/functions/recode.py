"""Recoding and binning as Column expressions (survey 2.6)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from plotwise.functions import rules
from plotwise.functions.numeric import col_


def map_literal(mapping: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def recode(c, mapping: dict) -> Column:
    """B1: replace mapped values, keep unmapped ones (pandas ``replace``).

    The map is a literal inside the expression: no join, no shuffle.
    """
    x = col_(c)
    out = F.when(F.lit(False), None)
    for k, v in mapping.items():
        out = out.when(x == F.lit(k), F.lit(v))
    return out.otherwise(x)


def map_values(c, mapping: dict) -> Column:
    """B2: mapped value or null (pandas ``map``)."""
    return F.try_element_at(map_literal(mapping), col_(c))


def categorise_luxury(c, bins=rules.LUXURY_BINS) -> Column:
    """[0,50) Low, [50,150) Medium, [150,175] High, else null."""
    x = col_(c)
    out = F.when(F.lit(False), None)
    for i, (lo, hi, label) in enumerate(bins):
        last = i == len(bins) - 1
        cond = (x >= lo) & ((x <= hi) if last else (x < hi))
        out = out.when(cond, F.lit(label))
    return out


def categorise_floor(c, bins=rules.FLOOR_BINS) -> Column:
    """Closed bins [0,2], [3,10], [11,51]; gaps (2.5) and outside -> null."""
    x = col_(c)
    out = F.when(F.lit(False), None)
    for lo, hi, label in bins:
        out = out.when((x >= lo) & (x <= hi), F.lit(label))
    return out


def cut_left_closed(c, edges, labels=None) -> Column:
    """``pd.cut(right=False)``: bin i is [edges[i], edges[i+1]); outside -> null."""
    x = col_(c)
    labels = labels or [f"[{edges[i]}, {edges[i + 1]})" for i in range(len(edges) - 1)]
    out = F.when(F.lit(False), None)
    for i in range(len(edges) - 1):
        out = out.when((x >= edges[i]) & (x < edges[i + 1]), F.lit(labels[i]))
    return out
