"""Operator 11: best-fit-decreasing packing of documents into sequences.

Documents are encoded where they are read, and cut into pieces of at most one
sequence. Best-fit decreasing takes the pieces by falling length and puts each
into the fullest open sequence that still has room. Pieces of one length are
alike, and so are sequences with the same room left, so the plan needs only
how many pieces there are of each length: a segment tree over the remaining
capacities finds the tightest one that is open, and all the sequences of a run
(consecutive numbers, the same room left) are filled in one step. The result
is that of placing piece after piece.

The plan has a size that depends on the capacity alone: each length leaves at
most two new runs, and a run is used at most once for each different length
that fits into a sequence together. It is made from one count per length and
broadcast; the pieces find their place by their rank among those of their
length, which is a number given where they are cut plus a running total over
the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from plotwise.llm.common import batch_rows, cut_lineage, ship
from plotwise.llm.token_output import encode_all, tokenizer_text

CAPACITY, END_ID = 1024, 2


class OpenBins:
    """A segment tree over the remaining capacities 0..capacity: which of them open sequences have."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _set(self, at: int, value: bool) -> None:
        at += self.size
        while at and self.tree[at] != value:
            self.tree[at] = value
            at //= 2
            if at:
                value = self.tree[2 * at] or self.tree[2 * at + 1]

    def add(self, room: int, first: int, count: int) -> None:
        """``count`` sequences from number ``first`` on have ``room`` left."""
        if room and count:
            self.runs[room].append((first, count))
            self._set(room, True)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._set(room, False)
        return run

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of ``length`` or more, found in logarithmic time."""
        at = length + self.size
        if self.tree[at]:
            return length
        while at > 1 and (at & 1 or not self.tree[at + 1]):  # up, until a right-hand neighbour has an open one
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self.size:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.size


class Fill(NamedTuple):
    """Pieces of ``length`` with ranks from ``rank``: ``each`` of them go to sequence ``first`` and those after it,
    from place ``offset`` on."""

    length: int
    rank: int
    each: int
    first: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Fill], int]:
    """Best-fit decreasing for ``counts`` pieces of each length; the steps and the number of sequences."""
    bins, fills, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                room = capacity
                first, count = opened, -(-left // (capacity // length))
                opened += count
            else:
                first, count = bins.take(room)
            # having taken one piece, a sequence is the tightest as long as another fits
            each = room // length
            full = min(count, left // each)
            if full:
                fills.append(Fill(length, rank, each, first, capacity - room))
                bins.add(room - each * length, first, full)
                rank, left, first, count = rank + full * each, left - full * each, first + full, count - full
            if count and left:  # the last pieces fill one sequence in part
                fills.append(Fill(length, rank, left, first, capacity - room))
                bins.add(room - left * length, first, 1)
                left, first, count = 0, first + 1, count - 1
            bins.add(room, first, count)
    return fills, opened


def _pieces(tokenizer, capacity: int, end_id: int):
    """(id, text) to the pieces of the document and their ranks of their length within the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        source = tokenizer.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                who, piece, start, ids = [], [], [], []
                for k, x in enumerate(encode_all(part.column(1).to_pylist(), source, end_id)):
                    n = -(-len(x) // capacity)
                    cuts = [max(0, len(x) - capacity * (n - i)) for i in range(n)] + [len(x)]
                    who += [k] * n
                    piece += range(n)
                    start += cuts[:-1]
                    ids += [x[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])]
                length = np.array([len(b) // 4 for b in ids], np.int64)
                # the rank within the batch of each among those of its length, after those seen before
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else ordered
                sizes = np.diff(np.append(begins, len(ordered)))
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.repeat(begins, sizes)
                rank += seen[length]
                np.add.at(seen, length, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(np.full(len(length), task, np.int32)), pa.array(rank), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "task", "rank", "ids"])

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, task, rank, ids) of every piece, kept as a table.

    A document is its ids (as little-endian unsigned 32-bit integers) and the end id; null and empty texts are the end
    id alone. One longer than a sequence is cut into whole sequences from its end, so that only its first piece may be
    shorter. Rows that repeat an id, or have none, are documents of their own.
    """
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(tokenizer_text(tokenizer))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    with batch_rows(spark):
        return cut_lineage(rows.mapInArrow(
            _pieces(source, capacity, end_id),
            f"doc_id {id_type}, piece int, start bigint, length bigint, task int, rank bigint, ids binary"))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """``pieces`` with sequence_id and offset, and the number of sequences."""
    by_task = cut_lineage(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    fills, sequences = plan(counts, capacity)
    before = by_task.select("task", "length", (F.sum("n").over(
        Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    steps = pieces.sparkSession.sparkContext.broadcast(np.array(fills, np.int64).reshape(-1, 5))

    @F.pandas_udf("struct<sequence_id bigint, offset bigint>")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        step = steps.value
        # steps are by falling length and rising rank, of which there are fewer than 2^44
        key = ((capacity - step[:, 0]) << 44) + step[:, 1]
        at = np.searchsorted(key, ((capacity - length.to_numpy()) << 44) + rank.to_numpy(), side="right") - 1
        _, begin, each, first, offset = step[at].T
        k = rank.to_numpy() - begin
        return pd.DataFrame({"sequence_id": first + k // each, "offset": offset + k % each * length.to_numpy()})

    found = pieces.join(before, ["task", "length"]).withColumn("at", find("length", F.col("rank") + F.col("before")))
    return found.select(*[c for c in pieces.columns if c not in ("task", "rank")], "at.sequence_id", "at.offset"), sequences


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Every piece of ``docs`` with its ids and its place: doc_id, piece, start, length, ids, sequence_id, offset."""
    return place(cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)[0]


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence: sequence_id, n_tokens, n_pieces, ids (binary), doc_ids and lengths in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids", "doc_id")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    empty = F.lit(b"").cast("binary")
    return rows.select(
        "sequence_id", F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["length"]).alias("n_tokens"),
        F.size("parts").alias("n_pieces"), F.aggregate("parts", empty, lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"))


ship(__name__)
