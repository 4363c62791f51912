"""Operator 4: exact deduplication by content-defined chunk recipes.

A text is cut where its content says so, and its recipe is the ordered list
of its chunks' identifiers. Two texts are equal when their recipes are equal.
Documents are read once and never move: only chunk digests and recipes (some
eight bytes per half kilobyte of text) are shuffled.

An identifier is the 64-bit hash of a chunk. It is verified against the
SHA-256 of the chunk: where one hash stands for several digests, the digests
are numbered, and recipes that hold such a hash carry these numbers too. So
equal recipes mean equal chunk digests, in order.

Everything is a built-in expression. Hot groups: counts and maxima combine
before the shuffle, and the join back is an equi-join whose skewed
partitions Spark splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.llm.common import cut_lineage

#: A chunk ends at the first sentence or line end after 512 characters, after 4096 at the latest.
CHUNK = r"(?s).{512,4096}?[.!?\n]|.{1,4096}"


def chunks(text: Column, pattern: str = CHUNK) -> Column:
    """The content-defined chunks of a text; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _digest_bits(chunk: Column) -> tuple[Column, Column]:
    """120 bits of the chunk's SHA-256 as two numbers, which aggregate in place."""
    sha = F.sha2(F.encode(chunk, "UTF-8"), 256)
    return tuple(F.conv(F.substring(sha, at, 15), 16, 10).cast("bigint") for at in (1, 16))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = CHUNK,
            chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, text_sha256, chunks: array of (h, a, b)), read from the texts once and kept as a table."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def identify(c: Column) -> Column:
        a, b = _digest_bits(c)
        return F.struct(chunk_hash(c).alias("h"), a.alias("a"), b.alias("b"))

    return cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"),
        F.transform(chunks(text, pattern), identify).alias("chunks")))


def verified_recipes(found: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, recipe, fix): the ordered identifiers, and the numbers of those that
    share a hash with another chunk (empty for nearly every document)."""
    parts = found.select("doc_id", "text_sha256", F.posexplode("chunks").alias("pos", "c")).select(
        "doc_id", "text_sha256", "pos", "c.h", "c.a", "c.b")
    # copies of a chunk combine before the shuffle, so a chunk of a third of all rows is one row per task
    distinct = parts.select("h", "a", "b").distinct()
    clash = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("h")
    # a window per clashing hash: the few digests that share it (a semi-join would be pushed below distinct)
    numbered = distinct.join(clash, "h").withColumn(
        "n", F.row_number().over(Window.partitionBy("h").orderBy("a", "b")))
    fixes = parts.join(numbered, ["h", "a", "b"]).select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "pos", "n").distinct().groupBy(
        "__id", "__sha").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("fix"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_sha256") == F.col("__sha"))
    return found.join(fixes, same, "left").select(
        "doc_id", "text_sha256", F.transform("chunks", lambda c: c["h"]).alias("recipe"), "fix")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = CHUNK,
                chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest ``doc_id`` stays. A null text
    counts as empty. Rows that repeat both id and text share every value
    (``kept`` too); a null id sorts below all others and stays only where the
    whole group has no id. An empty table gives an empty result. Columns
    besides the two named are not read, so their names can't clash.
    """
    rows = verified_recipes(recipes(docs, id_col, text_col, pattern, chunk_hash))
    rows = rows.withColumn("fix", F.coalesce(F.col("fix").cast("array<struct<pos:int,n:int>>"),
                                             F.array().cast("array<struct<pos:int,n:int>>")))
    groups = rows.groupBy("recipe", "fix").agg(F.max("doc_id").alias("keep_id"),
                                               F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["recipe", "fix"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops, all columns kept."""
    # a text with a repeated id may stay in one group and go in another: compare the text as well
    sha = F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)
    gone = exact_dedup(docs, id_col, text_col).filter(~F.col("kept")).select(
        F.col("doc_id").alias("__drop"), F.col("text_sha256").alias("__sha")).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__drop")) & (sha == F.col("__sha")), "left_anti")
