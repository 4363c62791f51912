"""Operator 10: repeated passages by a sparse suffix array.

A passage is a run of ``LENGTH`` words or more that occurs at two places or
more of the corpus (of one document or several). Suffixes are retained only
where content selects them: at minimisers, the position of the least hash of
``GRAM`` words among ``WINDOW`` successive ones. Whatever window of ``LENGTH``
words is repeated, its first minimiser is less than ``WINDOW`` words from its
start in every copy, and at least ``LENGTH - WINDOW + 1`` words of right
context are within the copy.

1. Group the retained suffixes by a hash of that right context: those alone
   in their group can't be in a repeated passage and go. Grouping by equality
   stands in for sorting and comparing neighbours, as only equal contexts
   matter; suffixes are nowhere ordered. Within a task, equal suffixes first
   combine, so a passage of a third of all documents is a row a task.
2. Extend the remaining matches left and right in their documents: every
   window of ``LENGTH`` words around a retained suffix gets its exact hash;
   grouped again, windows that occur twice are repeated.
3. Overlapping repeated windows join to maximal spans.

The result equals that of comparing all windows of ``LENGTH`` words with one
another, up to the collisions of a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plotwise.llm.common import cut_lineage, ship, small_batches, word_hashes
from plotwise.llm.minhash import C1, C3, _sizes, mix, pieces

#: A passage has this many words at least.
LENGTH = 50
#: A minimiser is the least of this many successive hashes of this many words.
WINDOW, GRAM = 24, 8

POWER = C3 | np.uint64(1)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words; the runs start at 0 .. len - length."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # doubling: the hash of 2k words from those of k words; the bits of length choose the blocks
    block, size, at, out = mix(words ^ C1), 1, 0, np.zeros(n, np.uint64)
    while True:
        if length & size:
            out = mix(out * POWER + block[at:at + n])
            at += size
        size *= 2
        if size > length:
            return out
        block = mix(block[:len(block) - size // 2] * POWER + block[size // 2:] * C1)


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least (leftmost) of each ``window`` successive values; of all values if there are fewer."""
    if len(grams) <= window:
        return np.array([grams.argmin()]) if len(grams) else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(views)) + views.argmin(axis=1))


def _suffixes(length: int, window: int, gram: int):
    """(row id, words) to (key, row, position, here): suffixes at minimisers. Suffixes that are equal
    within the task keep their rows (here: true) and add one row without a document for the comparison."""
    context = length - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, places = [], [], []
            for at, to in pieces(batch, 1):
                part = batch.slice(at, to - at)
                words, sizes = _sizes(part.column(1))
                ids = part.column(0).to_pylist()
                ends = np.cumsum(sizes)
                for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
                    if size < length:
                        continue
                    w = words[end - size:end]
                    p = minimisers(run_hashes(w, gram), window)
                    p = p[p <= size - context]
                    keys.append(run_hashes(w, context)[p])
                    rows.append(np.full(len(p), ids[i]))
                    places.append(p)
            if not keys:
                continue
            k, r, p = np.concatenate(keys), np.concatenate(rows), np.concatenate(places)
            _, first, back, count = np.unique(k, return_index=True, return_inverse=True, return_counts=True)
            here = count[back] > 1
            twice = first[count > 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([k, k[twice]]).view(np.int64)),
                 pa.array(np.concatenate([r, r[twice]]).astype(np.int64),
                          mask=np.concatenate([np.zeros(len(r), bool), np.ones(len(twice), bool)])),
                 pa.array(np.concatenate([p, p[twice]]).astype(np.int32)),
                 pa.array(np.concatenate([here, np.zeros(len(twice), bool)]))],
                names=["key", "row", "position", "here"])

    return run


def _windows(length: int, window: int):
    """(row, words, positions) to (key, row, position): every window whose first minimiser may be a given suffix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words, places in zip(*(batch.column(i) for i in range(3))):
                w = np.asarray(words.values).view(np.uint64)
                p = np.asarray(places.values).astype(np.int64)
                last = len(w) - length
                near = np.zeros(len(w) + 1, np.int64)
                np.add.at(near, np.maximum(p - window + 1, 0), 1)
                np.add.at(near, p + 1, -1)
                start = np.flatnonzero(np.cumsum(near)[:last + 1] > 0)
                yield pa.RecordBatch.from_pydict({"key": pa.array(run_hashes(w, length)[start].view(np.int64)),
                                                  "row": pa.array(np.full(len(start), row.as_py()), pa.int64()),
                                                  "position": pa.array(start.astype(np.int32))})

    return run


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows whose key occurs again. Counts combine before the shuffle; the join back is one whose
    skewed partitions Spark splits."""
    again = rows.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("key")
    return rows.join(again, "key")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Maximal repeated spans: doc_id, first_word, last_word (inclusive, from 0).

    Words are those of ``common.words``: lower-cased runs of letters, marks
    and digits. Null and empty texts and texts of fewer than ``length`` words
    have no span. Rows are told apart by their content and id: rows that repeat
    an id with different texts each report their spans; equal rows repeat each
    other, and so are spans from end to end, reported for each row. An empty
    table gives an empty result. Columns besides the two named are not read.
    """
    if not 1 <= gram <= length - window + 1:
        raise ValueError("a minimiser's words must lie within its right context")
    small_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn(
        "row", F.xxhash64("doc_id", "text"))
    suffixes = cut_lineage(found.select("row", word_hashes(F.col("text")).alias("words")).mapInArrow(
        _suffixes(length, window, gram), "key bigint, row bigint, position int, here boolean"))
    apart = _repeated(suffixes.filter(~F.col("here"))).filter("row IS NOT NULL")
    matches = suffixes.filter("here").select("row", "position").union(apart.select("row", "position"))
    by_row = matches.distinct().groupBy("row").agg(F.collect_list("position").alias("positions"))
    texts = found.join(by_row, "row")
    windows = cut_lineage(texts.select("row", word_hashes(F.col("text")).alias("words"), "positions").mapInArrow(
        _windows(length, window), "key bigint, row bigint, position int"))
    hits = _repeated(windows).select("row", "position").distinct()
    # spans: windows that overlap or touch; a partition is the windows of one document
    order = Window.partitionBy("row").orderBy("position")
    opens = (F.col("position") > F.lag("position").over(order) + length) | F.lag("position").over(order).isNull()
    spans = hits.withColumn("__open", opens.cast("int")).withColumn("__span", F.sum("__open").over(order)).groupBy(
        "row", "__span").agg(F.min("position").alias("first_word"), (F.max("position") + length - 1).alias("last_word"))
    return found.select("row", "doc_id").join(spans, "row").select(
        "doc_id", F.col("first_word").cast("int"), F.col("last_word").cast("int"))


ship(__name__)
