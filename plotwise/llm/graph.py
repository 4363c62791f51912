"""Connected components of a table of links."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotwise.llm.common import cut_lineage, ship

#: Rows of 16 bytes that may be broadcast; beyond, a shuffle join.
BROADCAST_ROWS = 500_000
#: Links whose cycles a task drops together.
BATCH_LINKS = 200_000


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to one node of its component, for the components of the links (a, b) alone."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, x, y = np.arange(len(names)), at[:len(a)], at[len(a):]
    while True:
        # the least label of both ends, for both ends' representatives; then every label points to its end
        least = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, before[x], least)
        np.minimum.at(label, before[y], least)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    own = np.flatnonzero(label != np.arange(len(names)))
    return names[own], names[label[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task without its cycles, as stars, some ``BATCH_LINKS`` at a time."""
    a, b, held = [], [], 0

    def out():
        x, y = _spanning(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_pydict({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held >= BATCH_LINKS:
            yield out()
            a, b, held = [], [], 0
    if held:
        yield out()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: bigint); the component is one of its nodes.

    Each task first turns its links into stars, a link for a node. Then, each
    round, every node joins the least of itself and its neighbours, in an order
    that a new salt draws, and the links are contracted. The nodes shrink by a
    constant factor a round in expectation, whatever the shape. A hub costs no
    more than its links: minima combine before the shuffle, the one shuffle of a
    round while the nodes that moved are few enough to be broadcast. A round
    writes its moves and the links that are left; the moves are put together
    once, at the end.
    """
    salts = random.Random(0)
    start = cut_lineage(links.select("a", "b").filter("a != b").mapInArrow(_contract, "a bigint, b bigint"))
    edges, steps, left = start, [], start.count()
    few = 2 * left <= BROADCAST_ROWS  # nodes, of which no round moves more

    def moved(df, col, step):
        return df.join(step, F.col(col) == F.col("from"), "left").withColumn(col, F.coalesce("to", col)).drop("from", "to")

    while left:
        salt = F.lit(salts.getrandbits(63) - (1 << 62))
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(salt)).alias("m")).select(
            F.col("a").alias("from"), F.least(F.col("a").bitwiseXOR(salt), "m").bitwiseXOR(salt).alias("to"))
        step = cut_lineage(least.filter(F.col("from") != F.col("to")))
        if few or step.count() <= BROADCAST_ROWS:
            step = F.broadcast(step)
        steps.append(step)
        edges = cut_lineage(moved(moved(edges, "a", step), "b", step).filter("a != b"))
        left = edges.count()
    labels = start.select(F.col("a").alias("node")).union(start.select("b")).distinct().withColumn("component", F.col("node"))
    for step in steps:
        labels = moved(labels, "component", step)
    return cut_lineage(labels)


ship(__name__)
