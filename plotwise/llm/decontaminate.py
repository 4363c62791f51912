"""Operator 1: benchmark decontamination by SimHash of item-sized windows.

A benchmark item of m shingles (five words each) is compared with windows of
m shingles of every document. A window's fingerprint is its 63-bit SimHash.
Fingerprints are indexed in ``BLOCKS`` blocks of three bits: two that differ
in at most ``RADIUS`` = BLOCKS - 1 bits agree in some block, so joining on
(item, block, value) finds every fingerprint within the radius. What it finds
is verified by the exact weighted Jaccard similarity of the shingles.

Fingerprinting all windows of a corpus for every item size is not feasible
with built-in expressions (63 counters per word and size), nor needed: a
window that is similar enough shares at least ``o = ceil(m t)`` shingles with
the item (a window of m shingles shares ``ceil(2 m t / (1 + t))``, but that of a
document of n < m shingles only ``ceil(t (m + n) / (1 + t))``, where n >= m t),
so it holds at least one of any ``m - o + 1`` of the item's shingles. These few
(the item's anchors) are looked up in all documents, and only windows around
them are fingerprinted. This loses no window.

The radius of 20 bits keeps a pair at the similarity of 0.8 (cosine 0.889,
15 % of bits expected to differ) with a probability of 0.9998, and more above.
Few shingles give coarser bits (four of five: 19 % differ), so the one window
of a document that is shorter than the item is verified whatever its bits.

Everything is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.llm.common import cut_lineage, words

SHINGLE = 5
THRESHOLD = 0.8
BLOCKS, BLOCK_BITS = 21, 3
RADIUS = BLOCKS - 1
#: Rows of at most 32 bytes that may be broadcast; beyond, a shuffle join.
BROADCAST_ROWS = 500_000
#: Three counters of 21 bits in each of 21 sums.
LANES, COUNTER_BITS = 21, 21


def shingle_hashes(w: Column, width: Column | int) -> Column:
    """Hashes of the runs of ``width`` words of an array; empty if there are fewer words."""
    last = F.size(w) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                                         lambda i: F.xxhash64(F.slice(w, i + 1, width)))) \
        .otherwise(F.array().cast("array<bigint>"))


def _bit(h: Column, i: int) -> Column:
    return F.shiftrightunsigned(h, i).bitwiseAND(F.lit(1).cast("bigint"))


def lane_sums(h: Column) -> list[Column]:
    """Aggregates that count, for each of 63 bits, the hashes that have it set."""
    return [F.sum(_bit(h, k) + F.shiftleft(_bit(h, k + LANES), COUNTER_BITS)
                  + F.shiftleft(_bit(h, k + 2 * LANES), 2 * COUNTER_BITS)).alias(f"lane{k}") for k in range(LANES)]


def fingerprint(size: Column) -> Column:
    """The SimHash: a bit for each position that more than half of ``size`` hashes have set."""
    out = F.lit(0).cast("bigint")
    for k in range(LANES):
        for part in range(3):
            count = F.shiftrightunsigned(F.col(f"lane{k}"), part * COUNTER_BITS).bitwiseAND(
                F.lit((1 << COUNTER_BITS) - 1))
            out = out + F.when(count * 2 > size, F.lit(1 << (k + part * LANES))).otherwise(F.lit(0)).cast("bigint")
    return out


def blocks(f: Column) -> Column:
    """(block number, value) of a fingerprint, as one number each."""
    return F.array(*(F.shiftrightunsigned(f, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
                     + F.lit(b << BLOCK_BITS) for b in range(BLOCKS)))


def units(df: DataFrame, col: str) -> DataFrame:
    """Replace an array of hashes by one hash per unit of weight (a hash and its how-manieth occurrence)."""
    df = df.withColumn(col, F.sort_array(col))
    return df.withColumn(col, F.transform(F.col(col), lambda x, i: F.xxhash64(x, i - F.array_position(F.col(col), x))))


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_table(benchmark: DataFrame, item_col: str, text_col: str, threshold: float, width: int) -> DataFrame:
    """(item_id, item, m, width, hs, anchors): the items that have words, texts that repeat under one id once.

    ``item`` is a key of its own, as an id may be null or repeated.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col).cast("string")).alias("w")) \
        .filter(F.size("w") > 0).distinct()
    items = items.withColumn("width", F.least(F.lit(width), F.size("w"))).withColumn(
        "hs", shingle_hashes(F.col("w"), F.col("width"))).withColumn("m", F.size("hs"))
    need = F.ceil(F.col("m") * threshold - 1e-9)
    return cut_lineage(items.select(
        "item_id", F.xxhash64("item_id", "w").alias("item"), "m", "width", "hs",
        F.array_distinct(F.slice(F.sort_array("hs"), F.lit(1), (F.col("m") - need + 1).cast("int"))).alias("anchors")))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD,
            width: int = SHINGLE) -> DataFrame:
    """The benchmark items that documents hold: doc_id, item_id, first_word, similarity.

    One row per document and item, for the window of greatest similarity (the
    first of them); ``first_word`` counts the words of ``common.words`` from 0.
    A window has as many shingles as the item, or as the document if that has
    fewer. Items of fewer than ``width`` words are one shingle of all words;
    null, empty and wordless items and documents match nothing. Rows that
    repeat id and text give one row per item; a repeated id with another text
    counts by itself. Empty tables give an empty result. Columns besides those
    named are not read.
    """
    items = item_table(benchmark, item_col, item_text_col, threshold, width)
    n_items = items.count()
    anchors = items.select("item", "m", "width", F.explode("anchors").alias("h"))
    n_anchors = anchors.count()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .filter("text IS NOT NULL").withColumn("row", F.xxhash64("doc_id", "text"))
    widths = [r.width for r in items.select("width").distinct().collect()]  # at most ``width`` values
    hits = None
    for k in widths or [width]:
        # the words as a column of their own: inside the lambda they would be cut anew for each shingle
        hs = rows.select("row", words(F.col("text")).alias("w")).select("row", shingle_hashes(F.col("w"), k).alias("hs"))
        # the outer form: for the plain one the optimizer adds a filter that repeats all of the above
        found = hs.select("row", F.size("hs").alias("n"), F.posexplode_outer("hs").alias("pos", "h")).join(
            small(anchors.filter(F.col("width") == k), n_anchors), "h").select("row", "n", "pos", "item", "m", "width")
        hits = found if hits is None else hits.union(found)
    hits = cut_lineage(hits)
    # fewer shingles than that can't reach the threshold
    hits = hits.filter(F.col("n") >= F.col("m") * threshold - 1e-9)
    size = F.least("m", "n")
    starts = F.sequence(F.greatest(F.lit(0), F.col("pos") - size + 1), F.least(F.col("pos"), F.col("n") - size))
    windows = hits.select("row", "item", "width", size.alias("size"), F.explode(starts).alias("start")).distinct()
    # the texts of documents with hits, by a filter before the shuffle where their ids are few
    hit_rows = cut_lineage(hits.select("row").distinct())
    texts = rows.join(small(hit_rows, hit_rows.count()), "row", "left_semi")
    texts = texts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    held = None
    for k in widths or [width]:
        x = texts.select("row", "doc_id", words(F.col("text")).alias("w")).select(
            "row", "doc_id", F.lit(k).alias("width"), shingle_hashes(F.col("w"), k).alias("hs"))
        held = x if held is None else held.union(x)
    cuts = cut_lineage(windows.join(held, ["row", "width"]).select(
        "row", "doc_id", "item", "start", F.slice("hs", F.col("start") + 1, F.col("size")).alias("ws")))
    prints = cuts.select("row", "item", "start", F.size("ws").alias("size"), F.explode("ws").alias("h")).groupBy(
        "row", "item", "start", "size").agg(*lane_sums(F.col("h"))).select(
        "row", "item", "start", fingerprint(F.col("size")).alias("f"))
    item_prints = items.select("item", "m", F.explode("hs").alias("h")).groupBy("item", "m").agg(
        *lane_sums(F.col("h"))).select("item", fingerprint(F.col("m")).alias("g"))
    index = item_prints.select(F.col("item"), "g", F.explode(blocks(F.col("g"))).alias("block"))
    near = prints.select("row", "item", "start", "f", F.explode(blocks(F.col("f"))).alias("block")).join(
        small(index, n_items * BLOCKS), ["item", "block"]).filter(
        F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= RADIUS).select("row", "item", "start")
    near = near.union(hits.filter("n < m").select("row", "item", F.lit(0).alias("start"))).distinct()
    pairs = units(near.join(cuts, ["row", "item", "start"]), "ws").join(
        small(units(items.select("item", "item_id", "hs"), "hs"), n_items if n_items < 50_000 else BROADCAST_ROWS + 1), "item")
    both = F.size(F.array_intersect("ws", "hs"))
    scored = pairs.select("row", "doc_id", "item", "item_id", "start",
                          (both / (F.size("ws") + F.size("hs") - both)).alias("similarity"))
    best = scored.filter(F.col("similarity") >= threshold).groupBy("row", "item").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"), "doc_id", "item_id")).alias("b"))
    return best.select("b.doc_id", "b.item_id", (-F.col("b.back")).cast("int").alias("first_word"), "b.similarity")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, all columns kept.

    Rows are matched by id and text, so a repeated id loses only the text that holds an item.
    """
    found = matches(docs.select(F.xxhash64(id_col, F.col(text_col).cast("string")).alias("__row"), F.col(text_col)),
                    benchmark, "__row", text_col, **options)
    gone = found.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.xxhash64(id_col, F.col(text_col).cast("string")) == F.col("__gone"), "left_anti")
