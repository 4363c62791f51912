"""Operator 3: near-duplicates by DartMinHash.

A document is the multiset of its five-word shingles; similarity is weighted
Jaccard (counts as weights). Each unit of weight of a shingle is a region of
width one, on which hashed darts fall as a Poisson process in rank: their
ranks, and the coordinate each hits, follow from the hash of the region alone.
A document throws the darts of its regions up to a rank at which some
``K (ln K + 4)`` fall in all, whatever its length, and keeps the earliest per
coordinate (on a rare miss it throws up to twice the rank). Two documents
agree in a coordinate with probability equal to their similarity.

Joining, with no group expanded into its pairs:

1. Documents of equal shingle multisets are one node.
2. ``BANDS`` bands of ``ROWS`` coordinates bring nodes into buckets. A bucket
   of more than ``BUCKET`` nodes is split by as many bands of other
   coordinates; what is still larger is cut into blocks that share a node for
   step 3, and compared block by block in step 5.
3. In a bucket, the signatures (a byte per coordinate) estimate similarities,
   and a maximum spanning forest over them gives fewer links than nodes.
4. Links are verified on the exact multisets, and components formed.
5. An estimate's error must cost no link: where a bucket holds different
   components, their nodes' texts are sent to it, and all pairs across whose
   estimate is within error of the threshold are verified there, until the
   components are joined or the pairs are done. Of a bucket in blocks, each
   block meets each block of the nodes outside the largest component, so all
   pairs across meet. Only links that join components leave the bucket.
   Components are formed again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotwise.llm.common import cut_lineage, ship, small_batches, word_hashes
from plotwise.llm.graph import BROADCAST_ROWS, components

SHINGLE = 5
THRESHOLD = 0.8
#: Coordinates (a power of two); the darts thrown in expectation.
K = 256
DARTS = K * (math.log(K) + 4)
#: 1 - (1 - 0.8**4)**20 = 0.99997 of the pairs at the threshold share a bucket.
BANDS, ROWS = 20, 4
#: A bucket of more nodes is split.
BUCKET = 2048
#: An estimate is within 3.2 standard errors of the threshold.
MARGIN = 3.2 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / K)
#: Links that a verification block holds, about.
BLOCK_LINKS = 1000

C1, C2, C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, applied element by element."""
    x = (x ^ (x >> np.uint64(30))) * C1
    x = (x ^ (x >> np.uint64(27))) * C2
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, sizes: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of documents whose word hashes lie joined, and each one's document.

    A document of fewer than ``width`` words has one shingle of all its words; one without words has none.
    """
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = len(words)
    h = np.zeros(n, np.uint64)
    size = np.minimum(sizes, width)
    reach = np.repeat(size, sizes)
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(n)
    for i in range(width):
        inside = (reach > i) & (left >= reach)
        at = np.flatnonzero(inside)
        h[at] = mix(h[at] * C3 + words[at + i])
    keep = left >= reach
    return h[keep], doc[keep]


def units(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One hash per unit of weight: the j-th occurrence of a shingle in its document differs from the others."""
    key = h ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return mix(h + nth * C3)


def dart_signatures(u: np.ndarray, doc: np.ndarray, n_docs: int, k: int = K, darts: float = DARTS) -> np.ndarray:
    """The earliest rank per document and coordinate (infinite where a document has no unit)."""
    out = np.full((n_docs, k), np.inf)
    weight = np.bincount(doc, minlength=n_docs)
    todo = weight > 0
    scale = 1.0
    while todo.any():
        limit = np.where(todo, scale * darts / np.maximum(weight, 1), 0.0)
        mine = todo[doc]
        x, d = u[mine], doc[mine]
        rank, most = np.zeros(len(x)), limit[d]
        flat = out.reshape(-1)
        while len(x):
            # the next dart of each region: an exponential step in rank
            x = mix(x + C3)
            rank = rank - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53)
            on = rank <= most
            x, d, rank, most = x[on], d[on], rank[on], most[on]
            coordinate = (mix(x ^ C1) & np.uint64(k - 1)).astype(np.int64)
            np.minimum.at(flat, d * k + coordinate, rank)
        todo &= np.isinf(out).any(axis=1)
        scale *= 2
    return out


def _sizes(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(joined values, length per row) of an array column."""
    offsets = np.asarray(col.offsets).astype(np.int64)
    values = np.asarray(col.values)[offsets[0]:offsets[-1]]
    return values.view(np.uint64) if values.dtype == np.int64 else values, np.diff(offsets)


def pieces(batch: pa.RecordBatch, column: int, words: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with some ``words`` elements of an array column each."""
    ends = np.asarray(batch.column(column).offsets).astype(np.int64)[1:]
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else np.asarray(batch.column(column).offsets)[0]
        to = max(at + 1, int(np.searchsorted(ends, base + words, side="right")))
        yield at, to
        at = to


def node_keys(u: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """A hash of each document's multiset of shingles."""
    total = np.zeros(n_docs, np.uint64)
    np.add.at(total, doc, mix(u ^ C2))
    return mix(total + np.bincount(doc, minlength=n_docs).astype(np.uint64) * C3)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in pieces(batch, 1):
                part = batch.slice(at, to - at)
                words, sizes = _sizes(part.column(1))
                h, doc = shingles(words, sizes, width)
                u = units(h, doc)
                n = part.num_rows
                ranks = dart_signatures(u, doc, n)
                bits = mix(ranks.view(np.uint64))
                sketch = (bits & np.uint64(255)).astype(np.uint8)
                # a band's key: its number and its coordinates' darts
                keys = np.zeros((n, 2 * BANDS), np.uint64) + np.arange(2 * BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    keys = mix(keys * C3 + bits[:, r:2 * BANDS * ROWS:ROWS])
                has = sizes > 0
                flat = pa.array(keys.view(np.int64).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * 2 * BANDS, 2 * BANDS), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(node_keys(u, doc, n).view(np.int64), mask=~has), lists,
                     pa.array([s.tobytes() for s in sketch], pa.binary())],
                    names=["doc_id", "node", "bands", "sketch"])

    return run


def forest(sketch: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links of a maximum spanning forest over the estimated similarities of at least ``least``."""
    m, k = sketch.shape
    need = least * k
    if m == 2:
        return [(0, 1)] if (sketch[0] == sketch[1]).sum() >= need else []
    out = []
    best = np.full(m, -1, np.int32)
    parent = np.zeros(m, np.int64)
    now = 0
    for _ in range(m - 1):
        best[now] = np.iinfo(np.int32).min  # in the forest
        same = np.count_nonzero(sketch == sketch[now], axis=1).astype(np.int32)
        closer = (same > best) & (best > np.iinfo(np.int32).min)
        best[closer] = same[closer]
        parent[closer] = now
        now = int(best.argmax())
        if best[now] >= need:
            out.append((int(parent[now]), now))
    return out


def across(sketch: np.ndarray, keys: list[np.ndarray], key: int, label: np.ndarray, least: float,
           verify) -> Iterator[tuple[int, int]]:
    """Verified links that join the components of a bucket, one for each join.

    Of the pairs with an estimate of at least ``least``, each is tried in the
    first bucket (by key) in which both nodes are, the likeliest first.
    ``keys`` are the buckets of each node, ascending.
    """
    names, where, count = np.unique(label, return_inverse=True, return_counts=True)
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    need = least * sketch.shape[1]
    largest = int(count.argmax())
    for i in np.flatnonzero(where != largest).tolist():
        # a pair of two smaller components is met twice: take it once
        at = np.flatnonzero((where != where[i]) & ((where == largest) | (np.arange(len(where)) < i)))
        same = np.count_nonzero(sketch[at] == sketch[i], axis=1)
        for n in np.argsort(-same, kind="stable").tolist():
            if same[n] < need:
                break
            j = int(at[n])
            x, y = find(int(where[i])), find(int(where[j]))
            if x == y:
                continue
            if np.intersect1d(keys[i], keys[j], assume_unique=True)[0] == key and verify(i, j):
                root[x] = y
                yield i, j


def _column(c: pa.Array) -> list:
    """The rows of a column; an array's as a numpy view."""
    if not isinstance(c, pa.ListArray):
        return c.to_pylist()
    ends = np.asarray(c.offsets).astype(np.int64)
    values = np.asarray(c.values)
    return [values[x:y] for x, y in zip(ends[:-1], ends[1:])]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of two or more equal keys in a stream of batches that is sorted by its first column."""
    key, rows = None, []
    for batch in batches:
        for r in zip(*map(_column, batch.columns)):
            if r[0] != key:
                if len(rows) > 1:
                    yield rows
                key, rows = r[0], []
            rows.append(r)
    if len(rows) > 1:
        yield rows


def _links(batches: Iterator[pa.RecordBatch], find) -> Iterator[pa.RecordBatch]:
    """The links (a, b) of nodes that ``find`` names by their places in each group."""
    out = []
    for rows in _groups(batches):
        out += [sorted((rows[i][1], rows[j][1])) for i, j in find(rows)]
        if len(out) >= 50_000:
            yield pa.RecordBatch.from_pydict({k: pa.array([x[n] for x in out], pa.int64()) for n, k in enumerate("ab")})
            out = []
    yield pa.RecordBatch.from_pydict({k: pa.array([x[n] for x in out], pa.int64()) for n, k in enumerate("ab")})


def _sketches(rows: list[tuple]) -> np.ndarray:
    return np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)


def _candidates(least: float):
    """(key, node, sketch) to the links of each bucket's forest."""
    return lambda batches: _links(batches, lambda rows: forest(_sketches(rows), least))


def _joins(least: float, threshold: float, width: int):
    """(key, node, sketch, keys, component, words) to the verified links between components."""
    def find(rows):
        have: dict[int, np.ndarray] = {}

        def units_of(i):
            if i not in have:
                have[i] = sorted_units(rows[i][5], width)
            return have[i]

        return across(_sketches(rows), [r[3] for r in rows], rows[0][0], np.array([r[4] for r in rows]), least,
                      lambda i, j: similarity(units_of(i), units_of(j)) >= threshold)

    return lambda batches: _links(batches, find)


def meetings(nodes: DataFrame, size: int) -> DataFrame:
    """(key, node, members): all buckets of two or more nodes; those of more than ``size`` split by further bands once."""
    def by(df, key):
        n = df.groupBy(key).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        return df.join(n, key)

    first = by(nodes.select("node", F.explode(F.slice("bands", 1, BANDS)).alias("key")), "key")
    subs = nodes.select("node", F.explode(F.slice("bands", BANDS + 1, BANDS)).alias("sub"))
    split = by(first.filter(F.col("members") > size).select("key", "node").join(subs, "node").select(
        F.xxhash64("key", "sub").alias("key"), "node"), "key")
    return first.filter(F.col("members") <= size).select("key", "node", "members").union(
        split.select("key", "node", "members"))


def cut(met: DataFrame, size: int) -> DataFrame:
    """(key, node): the buckets, larger ones in blocks of about ``size`` nodes that share the least node."""
    n = F.ceil(F.col("members") / size).cast("bigint")
    large = met.filter(F.col("members") > size)
    shared = large.groupBy("key").agg(F.min("node").alias("node"), F.max("members").alias("members"))
    blocks = large.select("key", "node", F.pmod(F.xxhash64("node"), n).alias("block")).union(
        shared.select("key", "node", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("block"))).distinct()
    return met.filter(F.col("members") <= size).select("key", "node").union(
        blocks.select(F.xxhash64("key", "block").alias("key"), "node"))


def buckets(nodes: DataFrame, size: int | None = None) -> DataFrame:
    """(key, node): the members of all buckets of two or more nodes, at most about ``size`` each."""
    size = size or BUCKET
    return cut(cut_lineage(meetings(nodes, size)), size)


def paired(met: DataFrame, size: int) -> DataFrame:
    """(key, node, component): buckets of several components, larger ones as pairs of blocks.

    A block of all nodes meets a block of those outside the bucket's largest
    component, so each pair across components meets, and no task has more than
    about two blocks.
    """
    large = met.filter(F.col("members") > size)
    parts = large.groupBy("key", "component").agg(F.count(F.lit(1)).alias("__n")).groupBy("key").agg(
        F.max(F.struct("__n", "component")).alias("__l"))
    large = large.join(parts, "key")

    def blocks(n):
        return F.greatest(F.lit(1), F.ceil(n / size)).cast("bigint")

    alls, others = blocks(F.col("members")), blocks(F.col("members") - F.col("__l.__n"))
    zero = F.lit(0).cast("bigint")
    one = large.select("key", "node", "component", F.pmod(F.xxhash64("node"), alls).alias("x"),
                       F.explode(F.sequence(zero, others - 1)).alias("y"))
    two = large.filter(F.col("component") != F.col("__l.component")).select(
        "key", "node", "component", F.explode(F.sequence(zero, alls - 1)).alias("x"),
        F.pmod(F.xxhash64("node", F.lit(1)), others).alias("y"))
    tasks = one.union(two).select(F.xxhash64("key", "x", "y").alias("key"), "node", "component").distinct()
    return met.filter(F.col("members") <= size).select("key", "node", "component").union(tasks)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct units (weighted Jaccard of the shingles)."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def sorted_units(words: np.ndarray, width: int) -> np.ndarray:
    w = np.asarray(words, np.int64).view(np.uint64)
    return np.sort(units(*shingles(w, np.array([len(w)]), width)))


def _verify(threshold: float, width: int):
    def run(links: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        have = {}
        for node, words in zip(texts["node"], texts["words"]):
            if node not in have:
                have[node] = sorted_units(words, width)
        keep = [similarity(have[a], have[b]) >= threshold for a, b in zip(links["a"], links["b"])]
        return links.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _node_texts(width: int):
    """(text, words) to (node, text), each node once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at, to in pieces(batch, 1):
                part = batch.slice(at, to - at)
                words, sizes = _sizes(part.column(1))
                h, doc = shingles(words, sizes, width)
                keys = node_keys(units(h, doc), doc, part.num_rows).view(np.int64)
                rows = []
                for i in np.flatnonzero(sizes > 0).tolist():
                    if (k := int(keys[i])) not in seen:
                        seen.add(k)
                        rows.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), part.column(0).take(pa.array(rows, pa.int64()))],
                                                 names=["node", "text"])

    return run


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint for a table of nodes whose counted rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def node_words(docs: DataFrame, text_col: str, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (with a column node) with the words of each node's text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"), word_hashes(text).alias("words")).mapInArrow(
        _node_texts(width), "node bigint, text string")
    # texts go no further than they must: first a filter by the nodes, then one text of each
    one = texts.join(_small(cut_lineage(wanted.select("node").distinct())), "node").groupBy("node").agg(
        F.first("text").alias("text"))
    return wanted.join(one, "node").withColumn("words", word_hashes(F.col("text"))).drop("text")


def verified(docs: DataFrame, text_col: str, pairs: DataFrame, threshold: float, width: int) -> DataFrame:
    """The pairs of nodes (a, b) whose exact similarity is at least ``threshold``, as a table.

    The pairs of one node ``a`` go to one block, or to several where there are
    many, and each node's text is sent to its blocks once.
    """
    pairs = cut_lineage(pairs.select("a", "b").distinct())
    n_blocks = max(1, pairs.count() // BLOCK_LINKS)
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK_LINKS).alias("__parts")).filter("__parts > 1")
    part = F.pmod(F.xxhash64("b"), F.coalesce("__parts", F.lit(1)))
    placed = cut_lineage(pairs.join(parts, "a", "left").select(
        "a", "b", F.pmod(F.xxhash64("a", part), F.lit(n_blocks)).alias("block")))
    wanted = placed.select("block", F.col("a").alias("node")).union(placed.select("block", "b")).distinct()
    sent = node_words(docs, text_col, wanted, width)
    # a renamed column keeps the two sides of one table apart
    sent = sent.withColumnRenamed("block", "__block")
    return cut_lineage(placed.groupBy("block").cogroup(sent.groupBy("__block")).applyInPandas(
        _verify(threshold, width), "a bigint, b bigint"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                 width: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept.

    A class is a connected component of the links of similarity ``threshold``
    or more; ``class_id`` is its least id, and that row is ``kept``. Texts
    below ``width`` words are one shingle of all words; null, empty and
    wordless texts have none and are classes of their own (``class_id`` is the
    row's id, ``kept`` is true). Rows that repeat id and text share a class
    and their values. A null id sorts last: its row is kept only where its
    class has no id. An empty table gives an empty result. Columns besides
    the two named are not read.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    signed = cut_lineage(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), word_hashes(text).alias("words"))
                         .mapInArrow(_sign(width), "doc_id bigint, node bigint, bands array<bigint>, sketch binary"))
    nodes = cut_lineage(signed.filter("node IS NOT NULL").groupBy("node").agg(
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    whole = cut_lineage(meetings(nodes, BUCKET))
    members = cut_lineage(cut(whole, BUCKET))
    least = threshold - MARGIN
    tasks = max(8, members.count() // 50_000)

    def met(rows, function):
        return rows.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(function, "a bigint, b bigint")

    plain = members.join(nodes, "node").select("key", "node", "sketch")
    links = verified(docs, text_col, met(plain, _candidates(least)), threshold, width)
    label = components(links)
    known = whole.join(_small(label), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = known.groupBy("key").agg(F.min("component").alias("__x"), F.max("component").alias("__y")).filter(
        "__x != __y").select("key")
    rest = cut_lineage(paired(cut_lineage(known.join(mixed, "key").select("key", "node", "component", "members")), BUCKET))
    keys = cut_lineage(rest.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys")))
    rest = node_words(docs, text_col, rest, width).join(nodes, "node").join(keys, "node").select(
        "key", "node", "sketch", "keys", "component", "words")
    more = cut_lineage(met(rest, _joins(least, threshold, width)))
    # the components of the first links are the nodes of the second
    first = _small(label)

    def contracted(df, col):
        return df.join(first, F.col(col) == F.col("node"), "left").withColumn(
            col, F.coalesce("component", col)).drop("node", "component")

    again = components(contracted(contracted(more, "a"), "b")).select(
        F.col("node").alias("component"), F.col("component").alias("joined"))
    of_doc = signed.select("doc_id", "node").join(first, "node", "left").withColumn(
        "component", F.coalesce("component", "node")).join(_small(again), "component", "left").withColumn(
        "component", F.coalesce("joined", "component")).drop("joined")
    classes = of_doc.filter("node IS NOT NULL").groupBy("component").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    alone = F.col("node").isNull()
    return of_doc.join(classes, "component", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("bigint").alias("class_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that ``near_classes`` does not keep, all columns kept.

    Rows are matched by id; rows that repeat an id stay if any of them is kept.
    """
    kept = near_classes(docs, id_col, text_col, **options).groupBy("doc_id").agg(F.max("kept").alias("__kept"))
    gone = kept.filter(~F.col("__kept")).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__gone")), "left_anti")


ship(__name__)
