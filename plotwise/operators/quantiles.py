"""Exact quantiles with bounded memory, of many columns and groups together (linear interpolation, the definition of
``percentile``/``median``/``quantile_cont``).

Spark's exact ``percentile`` merges a value -> count map per group in one
task: fine for bounded domains (2-dp prices, integer areas), but a hot group
of continuous values would put billions of distinct values in one task.
``quantile_table`` takes any number of (column, quantile) targets and reads
the rows three times in all, whatever the number of columns and groups:

1. A sketch per group and column (``percentile_approx`` at ``q -+
   margin/accuracy``) brackets the rows of each target's exact ranks.
2. One aggregate counts, per target, the rows below and inside its bracket.
   Where every bracket is a single value the answer is known.
3. The values inside the brackets are counted, ties first: the ranks are read
   from their running counts.

Rows are not shuffled by their group: sketches and counts combine in the task
that reads them, and the brackets (one row for each group) are broadcast,
behind a check of their size. Rows that come out of joins or aggregates are
written once, narrowed to the keys and columns in question, and read from there.

The sketch's rank error is at most n/accuracy, so that brackets hold the
ranks; if one should not, it is opened to all values.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plotwise.operators.joins import checked_broadcast
from plotwise.session import cut_lineage

DEFAULT_ACCURACY = 10_000
MARGIN = 2.0
#: Grouped statistics of so many rows pass through the driver; larger ones are kept as a table. So do the counted
#: values inside the brackets.
DRIVER_GROUPS = 20_000


def computed_once(df: DataFrame) -> DataFrame:
    """``df`` itself where it is a projection of stored files; written once where joins or aggregates stand before it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return cut_lineage(df) if re.search(r"Join|Aggregate|Generate|Window|Distinct|Sort|Union|Repartition", plan) else df


def _kept(df: DataFrame) -> tuple[DataFrame, list | None]:
    """A grouped table to be joined back to rows, computed once, and its rows if they are few."""
    rows = df.limit(DRIVER_GROUPS + 1).collect()
    if len(rows) <= DRIVER_GROUPS:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows
    return checked_broadcast(cut_lineage(df)), None


def quantile_table(df: DataFrame, keys, targets, accuracy: int = DEFAULT_ACCURACY, margin: float = MARGIN) -> DataFrame:
    """One row for each group of ``keys`` (without keys: one row) with an exact quantile for each of ``targets``:
    (out name, column, q). A group's null values don't count; a target without values is null. Rows with a null key
    are no group."""
    keys, targets = list(keys), list(targets)
    spark, eps = df.sparkSession, margin / accuracy
    columns: list = []
    at = []  # the column of each target
    for _, c, _ in targets:
        same = [i for i, o in enumerate(columns) if (isinstance(c, str) and isinstance(o, str) and c == o) or o is c]
        at.append(same[0] if same else len(columns))
        if not same:
            columns.append(c)
    base = df.select(*keys, *[(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"__x{i}")
                              for i, c in enumerate(columns)])
    for k in keys:
        base = base.filter(F.col(k).isNotNull())
    base = computed_once(base)
    x = [F.col(f"__x{i}") for i in at]
    # 1. a bracket for each target
    probes: dict[int, list[float]] = {}
    for i, (_, _, q) in zip(at, targets):
        probes.setdefault(i, []).extend([max(0.0, q - eps), min(1.0, q + eps)])
    place, seen = [], dict.fromkeys(probes, 0)
    for i in at:
        place.append(seen[i])
        seen[i] += 2
    sketches = base.groupBy(*keys).agg(
        *[F.count(f"__x{i}").alias(f"__n{i}") for i in probes],
        *[F.percentile_approx(f"__x{i}", p, accuracy).alias(f"__p{i}") for i, p in probes.items()])
    lows = F.array(*[F.get(f"__p{i}", F.lit(p)) for i, p in zip(at, place)])
    highs = F.array(*[F.get(f"__p{i}", F.lit(p + 1)) for i, p in zip(at, place)])
    brackets, known = _kept(sketches.select(*keys, F.array(*[F.col(f"__n{i}") for i in at]).alias("__n"),
                                            lows.alias("__lo"), highs.alias("__hi")))

    def held(name: str, i: int, rows) -> Column:
        """An entry of the group's statistics; without keys there is one group, and it is a literal."""
        return F.col(name)[i] if keys else F.lit(rows[0][name][i])

    # 2. the rows below and inside each
    joined = base.join(brackets, keys) if keys else base
    low, high = ([held(n, i, known) for i in range(len(x))] for n in ("__lo", "__hi"))
    inside = [(v >= a) & (v <= b) for v, a, b in zip(x, low, high)]
    counts = joined.groupBy(*keys).agg(F.array(*[F.count_if(v < a) for v, a in zip(x, low)]).alias("__below"),
                                       F.array(*[F.count_if(i) for i in inside]).alias("__inside"))
    stats = brackets.join(counts, keys) if keys else counts.withColumns(
        {n: F.array(*[held(n, i, known).cast(t) for i in range(len(x))])
         for n, t in (("__n", "bigint"), ("__lo", "double"), ("__hi", "double"))})
    qs = [float(q) for _, _, q in targets]

    def ranks(n: Column, q) -> tuple[Column, Column, Column]:
        pos = (n - 1) * q
        first = F.floor(pos).cast("long")
        # the next rank is only needed when the position falls between two ranks
        return pos, first, F.when(pos > first, F.least(first + 1, n - 1)).otherwise(first)

    missed = []
    for i, q in enumerate(qs):
        _, first, last = ranks(F.col("__n")[i], q)
        missed.append((F.col("__n")[i] > 0) & ((first < F.col("__below")[i]) | (last >= F.col("__below")[i] + F.col("__inside")[i])))
    open_lo = F.array(*[F.when(m, F.lit(float("-inf"))).otherwise(F.col("__lo")[i]) for i, m in enumerate(missed)])
    open_hi = F.array(*[F.when(m, F.lit(float("nan"))).otherwise(F.col("__hi")[i]) for i, m in enumerate(missed)])
    below = F.array(*[F.when(m, F.lit(0)).otherwise(F.col("__below")[i]) for i, m in enumerate(missed)])
    stats, known = _kept(stats.select(*keys, "__n", open_lo.alias("__lo"), open_hi.alias("__hi"), below.alias("__below")))
    out_schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(o, T.DoubleType()) for o, _, _ in targets])
    if known is not None and all(a == b for r in known for a, b in zip(r["__lo"], r["__hi"])):
        return spark.createDataFrame([(*[r[k] for k in keys], *r["__lo"]) for r in known], out_schema)
    # 3. the values inside, counted
    joined = base.join(stats, keys) if keys else base
    low, high = ([held(n, i, known) for i in range(len(x))] for n in ("__lo", "__hi"))
    values = F.filter(F.array(*[F.when((v >= a) & (v <= b), F.struct(F.lit(i).alias("i"), v.alias("x")))
                                for i, (v, a, b) in enumerate(zip(x, low, high))]), lambda s: s.isNotNull())
    found = joined.select(*keys, F.explode(values).alias("v")).groupBy(*keys, F.col("v.i").alias("__i"), F.col("v.x").alias("__x")).agg(
        F.count(F.lit(1)).alias("__c"))
    if known is not None:
        few = found.limit(DRIVER_GROUPS + 1).collect()
        if len(few) <= DRIVER_GROUPS:
            return spark.createDataFrame(_ranked(known, few, keys, qs), out_schema)
    found = found.join(stats, keys) if keys else found.withColumns(
        {n: F.array(*[held(n, i, known) for i in range(len(x))]) for n in ("__n", "__below")})
    pos, first, last = ranks(F.get("__n", F.col("__i")), F.get(F.array(*map(F.lit, qs)), F.col("__i")))
    running = Window.partitionBy(*keys, "__i").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    up_to = F.get("__below", F.col("__i")) + F.sum("__c").over(running)
    ranked = found.withColumns({"__cum": up_to, "__pos": pos, "__r0": first, "__r1": last})
    picked = ranked.groupBy(*keys, "__i", "__pos", "__r0").agg(
        F.min(F.when(F.col("__cum") > F.col("__r0"), F.col("__x"))).alias("__v0"),
        F.min(F.when(F.col("__cum") > F.col("__r1"), F.col("__x"))).alias("__v1"))
    value = F.col("__v0") + F.when(F.col("__pos") > F.col("__r0"), (F.col("__pos") - F.col("__r0")) * (
        F.col("__v1") - F.col("__v0"))).otherwise(0.0)
    answers = [F.max(F.when(F.col("__i") == i, F.col("__v"))).alias(o) for i, (o, _, _) in enumerate(targets)]
    result = picked.withColumn("__v", value).groupBy(*keys).agg(*answers)
    # groups without any value have no row yet
    return stats.select(*keys).join(result if known is None else F.broadcast(result), keys, "left") if keys else result


def _ranked(groups: list, values: list, keys: list, qs: list[float]) -> list[tuple]:
    """A row for each group, its quantiles read from its few counted values."""
    held: dict[tuple, list] = {}
    for r in values:
        held.setdefault((*(r[k] for k in keys), r["__i"]), []).append((r["__x"], r["__c"]))
    out = []
    for g in groups:
        key, row = tuple(g[k] for k in keys), []
        for i, q in enumerate(qs):
            n, run, answer = g["__n"][i], g["__below"][i], None
            if n:
                pos = (n - 1) * q
                first = math.floor(pos)
                ends = [first, min(first + 1, n - 1) if pos > first else first]
                at = []
                for x, c in sorted(held[(*key, i)], key=lambda v: (v[0] != v[0], v[0])):  # NaN last, as Spark sorts
                    run += c
                    at += [x] * sum(r < run for r in ends[len(at):])
                    if len(at) == 2:
                        break
                answer = at[0] + ((pos - first) * (at[1] - at[0]) if pos > first else 0.0)
            row.append(answer)
        out.append((*key, *row))
    return out


def grouped_quantiles(df: DataFrame, keys, col: str, qs, accuracy: int = DEFAULT_ACCURACY, margin: float = MARGIN,
                      out_prefix: str = "q") -> DataFrame:
    """Exact quantiles of one column per group: ``keys..., {out_prefix}0, {out_prefix}1, ...``; groups whose values are
    all null have no row. Without keys the whole table is one group, with a row of nulls if it has no values."""
    keys = list(keys)
    rows = df.filter(F.col(col).isNotNull()) if keys else df
    return quantile_table(rows, keys, [(f"{out_prefix}{i}", col, float(q)) for i, q in enumerate(qs)], accuracy, margin)


def exact_quantile(df: DataFrame, col, q: float = 0.5) -> Column:
    """One exact quantile of a column (or expression) as a scalar subquery."""
    return quantile_table(df, [], [("q0", col, float(q))]).select("q0").scalar()
