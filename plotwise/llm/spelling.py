"""Operator 12: grouping of spelling variants by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point makes them
equal. With the longer one of m code points that is so exactly if their common
prefix and common suffix together reach m - 1. Words become rows of two padded
matrices of code points, one aligned to the left and one to the right, and a
block of rows is compared with another block in a few array steps.

Which blocks meet: the edit stands at one of the m places of the longer word.
The places are cut into regions; words that differ by an edit in a region
agree in all code points before and after it. So each word is sent to one tile
for each region (of its own length and of one more), keyed by those code
points, and only words of one tile are compared. Regions hold two places in
words of up to 16 code points, which bounds a tile by what two free code
points can spell. In longer words, a tile of many words is dealt again by
halves of its region until it is small or the region is one place.

The counts of words combine within the task that reads the texts, so that a
word on a third of all rows is one row a task. Forms lead to words of at least
ten times the count, so chains are short (as many steps as the largest count
has digits) and are followed by doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plotwise.llm.common import batch_rows, cut_lineage, ship

MIN_LENGTH, MIN_COUNT, RATIO, NOISE = 7, 2, 10, 31
#: A region has two places, but a word no more than this many regions.
REGIONS = 8
#: Longer words are dealt again while more than this many share a tile.
TILE_WORDS = 4096
#: Words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Bytes of matrices that are compared at once.
BLOCK_BYTES = 32 << 20


def words_of(text: str, doc_id: str, noise: int = NOISE, min_length: int = MIN_LENGTH) -> Counter:
    """The words of one text with their counts: runs of Latin letters in lower case, of which those whose hash with
    the id is a multiple of ``noise`` lose one code point (0: none does)."""
    # all characters in question are one byte in Latin-1, and bytes.lower changes A-Z alone
    raw = text.encode("latin-1", "replace").lower()
    found = Counter(re.findall(rb"[A-Za-z\xc0-\xff]{%d,}" % min_length, raw))
    if noise:
        seed = zlib.crc32(f"{doc_id}:".encode())
        for run in list(found):
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
            if h % noise == 0:
                n, at = found.pop(run), h % len(run)
                if len(run) > min_length:
                    # what a run becomes may itself be a run of the text
                    found[b"\0" + run[:at] + run[at + 1:]] += n
    out: Counter = Counter()
    for run, n in found.items():
        out[run.lstrip(b"\0")] += n
    return out


def _count(noise: int, min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows():
            made = pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in held], pa.string()),
                                               "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.update(words_of(text.as_py(), doc, noise, min_length))
                if len(held) > HELD_WORDS:
                    yield rows()
        yield rows()

    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE,
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of all texts, kept as a table. A null text has no words; a null id counts as an empty one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    with batch_rows(docs.sparkSession):
        return cut_lineage(docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)
                           .mapInArrow(_count(noise, min_length), "word string, n bigint")
                           .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


def _key(m: Column, begin: Column, end: Column) -> Column:
    """What words of a tile share: the length of the longer, the region, and all code points outside it."""
    return F.xxhash64(m, begin, end, F.expr("left(word, begin)"), F.expr("right(word, m - end)"))


def tiles(words: DataFrame, regions: int = REGIONS, tile_words: int = TILE_WORDS) -> DataFrame:
    """(key, m, begin, end, word, n): each word in the tile of each region it may be edited in."""
    size = F.length("word")
    spread = words.withColumn("m", F.explode(F.array(size, size + 1))).withColumn(
        "parts", F.least(F.lit(regions), F.ceil(F.col("m") / 2).cast("int"))).withColumn(
        "part", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn(
        "begin", F.expr("int(m * part div parts)")).withColumn("end", F.expr("int(m * (part + 1) div parts)"))
    dealt = spread.withColumn("key", _key(F.col("m"), F.col("begin"), F.col("end"))).select(
        "key", "m", "begin", "end", "word", "n")
    long = F.col("end") - F.col("begin") > 2
    done, rest = dealt.filter(~long), cut_lineage(dealt.filter(long))
    while not rest.isEmpty():
        # at most as many rounds as halvings of a region
        large = rest.filter("end - begin > 1").groupBy("key").count().filter(F.col("count") > tile_words).select("key")
        large = cut_lineage(large)
        done = done.unionByName(rest.join(large, "key", "left_anti"))
        middle = F.expr("int((begin + end) div 2)")
        halves = rest.join(large, "key", "left_semi").withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
        halves = halves.select("m", F.when(F.col("half") == 0, F.col("begin")).otherwise(middle).alias("begin"),
                               F.when(F.col("half") == 0, middle).otherwise(F.col("end")).alias("end"), "word", "n")
        rest = cut_lineage(halves.withColumn("key", _key(F.col("m"), F.col("begin"), F.col("end"))).select(
            "key", "m", "begin", "end", "word", "n"))
    return done


def _matrices(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded rows of code points from the left, the same from the right, and the lengths."""
    length = np.array([len(w) for w in words], np.int64)
    width = int(length.max(initial=1))
    flat = np.frombuffer(b"".join(words), np.uint8)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    row = np.repeat(np.arange(len(words)), length)
    left, right = np.zeros((len(words), width), np.uint8), np.zeros((len(words), width), np.uint8)
    left[row, place] = flat
    right[row, np.repeat(length, length) - 1 - place] = flat
    return left, right, length


def near_pairs(words: list[bytes], group: np.ndarray, m: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Pairs (i, j) of rows of one group (equal numbers, side by side) that are one edit apart, the edit in the region
    of row i; the place of an edit is the length of the common prefix, so that one region reports it.

    The block of all rows is compared with itself moved by 1, 2, ... rows, as far as groups reach.
    """
    left, right, length = _matrices(words)
    found_i, found_j = [], []
    size = np.bincount(group, minlength=1)
    last = (np.cumsum(size) - 1)[group]
    rows = max(1, BLOCK_BYTES // left.shape[1])
    at = np.arange(len(words))
    shift = 1
    i = at[at + shift <= last]
    while len(i):
        for k in range(0, len(i), rows):
            a = i[k:k + rows]
            b = a + shift
            prefix = (left[a] != left[b]).argmax(axis=1)
            suffix = (right[a] != right[b]).argmax(axis=1)
            longer = np.maximum(length[a], length[b])
            near = (prefix + suffix >= longer - 1) & (np.abs(length[a] - length[b]) <= 1) & (longer == m[a]) \
                & (m[a] == m[b]) & (prefix >= begin[a]) & (prefix < end[a])
            found_i.append(a[near])
            found_j.append(b[near])
        shift += 1
        i = i[i + shift <= last[i]]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles in the order of their keys to links (word, near, n of near), both ways. The last tile of a batch waits
    for the next batch, which may go on with it."""
    def links(table: pa.RecordBatch):
        key = table.column("key").to_numpy()
        change = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(change) - 1
        alone = np.bincount(group)[group] == 1
        keep = np.flatnonzero(~alone)
        if not len(keep):
            return
        part = table.take(pa.array(keep))
        m = part.column("m").to_numpy()
        # rows of like width together, in slices of bounded size
        order = np.lexsort((key[keep], m))
        part, m, key2 = part.take(pa.array(order)), m[order], key[keep][order]
        change = np.append(True, (key2[1:] != key2[:-1]) | (m[1:] != m[:-1]))
        starts = np.append(np.flatnonzero(change), len(m))
        weight = np.cumsum(m.astype(np.int64))
        a = 0
        while a < len(starts) - 1:
            base = weight[starts[a] - 1] if starts[a] else 0
            b = max(a + 1, int(np.searchsorted(weight[starts[1:] - 1], base + BLOCK_BYTES, side="right")))
            rows = part.slice(starts[a], starts[b] - starts[a])
            words = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
            group = np.cumsum(change[starts[a]:starts[b]]) - 1
            i, j = near_pairs(words, group, m[starts[a]:starts[b]], rows.column("begin").to_numpy(),
                              rows.column("end").to_numpy())
            if len(i):
                one, two = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
                yield pa.RecordBatch.from_arrays([rows.column("word").take(one), rows.column("word").take(two),
                                                  rows.column("n").take(two)], names=["word", "near", "near_n"])
            a = b

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        if held and key[0] == key[-1] == held[-1].column("key")[-1].as_py():
            held.append(batch)
            continue
        cut = int(np.searchsorted(key, key[-1], side="left"))
        yield from links(_joined([*held, batch.slice(0, cut)]))
        held = [batch.slice(cut)]
    if held:
        yield from links(_joined(held))


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).combine_chunks()
    found = table.to_batches()
    return found[0] if found else parts[0].slice(0, 0)


def links(words: DataFrame, regions: int = REGIONS, tile_words: int = TILE_WORDS) -> DataFrame:
    """(word, near, near_n) for every two near words of ``words`` (word, n; words distinct), both ways, once each."""
    return tiles(words, regions, tile_words).repartition("key").sortWithinPartitions("key").mapInArrow(
        _compare, "word string, near string, near_n bigint")


def group_variants(words: DataFrame, ratio: int = RATIO, regions: int = REGIONS, tile_words: int = TILE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n; words distinct).

    The form is the near word of largest n (of equal ones the first in code-point order), if that is ``ratio`` times
    the word's n or more (at least 2).
    """
    near = links(words, regions, tile_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best"))
    close = (-F.col("best.n")) >= ratio * F.col("n")
    found = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(close, F.col("best.w")).alias("form"), F.when(close, -F.col("best.n")).alias("form_n")))
    roots = found.filter("form is not null").select("word", F.col("form").alias("root"))
    steps = len(str(words.agg(F.max("n")).first()[0] or 0))
    for _ in range((steps - 1).bit_length()):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = cut_lineage(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``group_variants`` of the words of all texts. Null and empty texts and empty tables give no words; rows that
    repeat an id count each; columns besides the two are not read."""
    return group_variants(count_words(docs, id_col, text_col))


ship(__name__)
