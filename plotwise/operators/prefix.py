"""Running totals and ranks over a whole table without a single-task window.

The rows are range-partitioned by the order (any number of columns, texts,
either direction), so that part 0 holds the first rows, part 1 the next, and
so on. A window within each part gives the running totals from its first row;
the parts' own totals (one row for each part, whatever the rows) give what is
to be added. Equal order keys always fall into one part: group tied rows
before if one key may hold much of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.session import cut_lineage

_PART = "__part"


def _order(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def running_totals(df: DataFrame, order, sums: dict, ties: str = "rows", parts: int | None = None) -> DataFrame:
    """``df`` with a running sum for each ``out name -> column``, up to and including each row.

    ``ties="rows"`` adds row after row, for which the order should end in a
    unique column; with ``ties="peers"`` rows that tie share the total of all of
    them (as in a RANGE window). Nulls add nothing. A total of no numbers is null.
    """
    if ties not in ("rows", "peers"):
        raise ValueError(f"unknown ties {ties!r}")
    order = _order(order)
    base = df.withColumns({f"__v{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(sums.values())})
    ranged = base.repartitionByRange(parts, *order) if parts else base.repartitionByRange(*order)
    ranged = cut_lineage(ranged.withColumn(_PART, F.spark_partition_id()))
    names = [f"__v{i}" for i in range(len(sums))]
    totals = ranged.groupBy(_PART).agg(*[F.sum(n).alias(n) for n in names]).collect()  # a row for each part
    before, rows = [None] * len(names), []
    for r in sorted(totals, key=lambda r: r[_PART]):
        rows.append((r[_PART], *before))
        before = [b if v is None else v if b is None else b + v for b, v in zip(before, (r[n] for n in names))]
    w = Window.partitionBy(_PART).orderBy(*order)
    w = w.rowsBetween(Window.unboundedPreceding, 0) if ties == "rows" else w.rangeBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumns({f"__r{i}": F.sum(n).over(w) for i, n in enumerate(names)})
    types = {f.name: f.dataType for f in inside.schema.fields}
    schema = f"{_PART} int, " + ", ".join(f"__b{i} {types[f'__r{i}'].simpleString()}" for i in range(len(names)))
    offsets = df.sparkSession.createDataFrame(rows, schema)
    out = inside.join(F.broadcast(offsets), _PART, "left")
    added = {o: F.when(F.col(f"__b{i}").isNull(), F.col(f"__r{i}")).otherwise(
        F.col(f"__b{i}") + F.coalesce(F.col(f"__r{i}"), F.lit(0))) for i, o in enumerate(sums)}
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[v.alias(o) for o, v in added.items()])


def global_rank(df: DataFrame, order, out: str = "rank", parts: int | None = None) -> DataFrame:
    """The position of each row, from 1, in an order that ends in a unique column."""
    return running_totals(df, order, {out: F.lit(1).cast("bigint")}, parts=parts)
