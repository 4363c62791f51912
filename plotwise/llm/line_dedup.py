"""Operator 5: line deduplication by a deletion-neighbourhood join.

A line is its words (``common.words``). Two lines are the same if their words
are equal, or, where both have ``MIN_WORDS`` words or more, if one edit (a
word put in, left out or replaced) makes them equal. A line stays if no
earlier line of the corpus is the same; earlier is by (doc_id, line number).

The deletion neighbourhood of a line is the line and its variants with one
word left out, as hashes (each a xor over the hashes of word and place). Lines at an edit of one share a variant: the same
place left out of both (replaced), or one whole line (put in or left out).
Equal variants are joined, and the earliest line of each is compared word by
word with the others, so a group gives as many pairs as lines.

What is shuffled is kept small, without loss: equal lines combine first; an
edit leaves the first or the last ``END`` words of a line alone, so lines that
share neither with another line have no variants; and only variants that
occur twice are joined. Everything is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.llm.common import WORD_GAP, cut_lineage

MIN_WORDS, END = 10, 4
#: Rows of at most 24 bytes that may be broadcast; beyond, a shuffle join.
BROADCAST_ROWS = 500_000


def words(line: Column) -> Column:
    """``common.words`` in one pass of the pattern over the line (empty words stand at its ends only)."""
    return F.array_remove(F.split(F.lower(F.coalesce(line, F.lit(""))), WORD_GAP), "")


def _small(df: DataFrame) -> DataFrame:
    """A table with a broadcast hint where its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _without(w: Column, i: Column) -> Column:
    """The words without the i-th (from 0); all of them for -1."""
    return F.when(i < 0, w).otherwise(F.concat(F.slice(w, F.lit(1), F.greatest(i, F.lit(0))),
                                               F.slice(w, F.greatest(i, F.lit(0)) + 2, F.size(w))))


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, w) for every line of every text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the outer form: for the plain one the optimizer adds a filter that cuts the text twice
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(F.split(text, "\n")).alias("line_no", "line")) \
        .select("doc_id", "line_no", words(F.col("line")).alias("w"))


def _keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"k1": F.xxhash64("w"), "k2": F.xxhash64(F.lit(1), "w")})


def distinct_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, pos, n, head, tail): the lines with words, once each, at their earliest place."""
    keyed = _keys(lines(docs, id_col, text_col)).select(
        "k1", "k2", F.struct("doc_id", "line_no").alias("pos"), F.size("w").alias("n"),
        F.xxhash64(F.lit("head"), F.slice("w", 1, END)).alias("head"),
        F.xxhash64(F.lit("tail"), F.slice("w", -END, END)).alias("tail"))
    # blank lines are one key, dropped behind the aggregate: a filter before it would be pushed below the words
    return cut_lineage(keyed.groupBy("k1", "k2").agg(
        F.min("pos").alias("pos"), F.first("n").alias("n"), F.first("head").alias("head"), F.first("tail").alias("tail"))
        .filter("n > 0"))


def near_earlier(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2) of the distinct lines that are one edit from an earlier line."""
    long = found.filter(F.col("n") >= MIN_WORDS)
    ends = long.select("k1", "k2", "pos", F.explode(F.array("head", "tail")).alias("end"))
    shared = ends.groupBy("end").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).filter("x != y").select("end")
    wanted = cut_lineage(ends.join(shared, "end").select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), "pos").distinct())
    # only these lines are cut into words again, found by their places in the texts
    places = cut_lineage(wanted.groupBy("pos.doc_id").agg(
        F.collect_list(F.struct("pos.line_no", "c1", "c2")).alias("places")))
    if wanted.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("__id"), F.split(text, "\n").alias("lines"))
    # (two uses of the lines: one alone would be replaced by the split itself, for every place)
    at = F.transform("places", lambda x: F.struct(x.alias("x"), F.when(
        F.size("lines") > x["line_no"], F.get("lines", x["line_no"])).alias("line")))
    held = texts.join(places, F.col("__id").eqNullSafe(F.col("doc_id"))).select(
        "doc_id", F.explode(at).alias("a")).select(
        F.struct("doc_id", "a.x.line_no").alias("pos"), "a.x.c1", "a.x.c2", words(F.col("a.line")).alias("w"))
    # a row that repeats an id may have another line at the place; told apart behind the aggregate, as a filter before
    # it would be pushed below the words
    right = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
    held = cut_lineage(_keys(held).groupBy("k1", "k2").agg(
        F.min(F.when(right, F.col("pos"))).alias("pos"), F.first("w").alias("w")).filter("pos IS NOT NULL"))
    # a variant's hash from those of the words before and behind the gap, whose places move up by one: running
    # xors over the words of a line, so a line of n words costs n steps and not n squared
    line = held.repartition("k1", "k2").select("k1", "k2", "pos", F.posexplode("w").alias("i", "word")).select(
        "k1", "k2", "pos", "i", F.xxhash64("i", "word").alias("here"), F.xxhash64(F.col("i") - 1, "word").alias("moved"))
    upto = Window.partitionBy("k1", "k2").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("k1", "k2")
    sums = line.select("k1", "k2", "pos", "i", "here", "moved", F.bit_xor("here").over(upto).alias("head"),
                       F.bit_xor("moved").over(upto).alias("gone"), F.bit_xor("here").over(behind).alias("whole"),
                       F.bit_xor("moved").over(behind).alias("all"))
    short = sums.select("k1", "k2", "pos", "i", F.xxhash64(F.col("head").bitwiseXOR(F.col("here")).bitwiseXOR(
        F.col("all")).bitwiseXOR(F.col("gone"))).alias("h"))
    variants = short.union(sums.filter("i = 0").select(
        "k1", "k2", "pos", F.lit(-1).alias("i"), F.xxhash64("whole").alias("h")))
    variants = cut_lineage(variants)
    live = cut_lineage(variants.groupBy("h").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("h"))
    variants = cut_lineage(variants.join(_small(live), "h"))
    whole, short = variants.filter("i < 0"), variants.filter("i >= 0")

    def earlier(rows, others, on):
        """Each row with the earliest of ``others`` that has equal ``on``, if that is earlier than itself."""
        first = others.groupBy(*on).agg(F.min(F.struct("pos", "k1", "k2", "i")).alias("e"))
        return rows.join(first, on).filter("e.pos < pos").select(
            "k1", "k2", "i", F.col("e.k1").alias("e1"), F.col("e.k2").alias("e2"), F.col("e.i").alias("ei"))

    pairs = earlier(short, short, ["h", "i"]).union(earlier(short, whole, ["h"])).union(earlier(whole, short, ["h"]))
    mine = held.select("k1", "k2", "w")
    theirs = held.select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.col("w").alias("ew"))
    same = _without(F.col("w"), F.col("i")) == _without(F.col("ew"), F.col("ei"))
    return pairs.join(mine, ["k1", "k2"]).join(theirs, ["e1", "e2"]).filter(same).select("k1", "k2").distinct()


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no) of every line with words that stays.

    Lines without words (blank ones) are not compared and always stay; they
    are not listed. A null id counts as the earliest. Lines at the same place
    of rows that repeat an id count as one place: neither is earlier than the
    other. Null and empty texts have no line with words. An empty table gives
    an empty result. Columns besides the two named are not read.
    """
    found = distinct_lines(docs, id_col, text_col)
    gone = near_earlier(docs, found, id_col, text_col)
    return found.join(gone, ["k1", "k2"], "left_anti").select("pos.doc_id", "pos.line_no")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id: doc_id, n_lines (lines with words), n_kept, kept_lines (ascending numbers from 0)."""
    # a line has words if it has one of their characters: cheaper than to cut it
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    worded = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[\p{L}\p{M}\p{N}]")))
    total = docs.select(F.col(id_col).alias("doc_id"), worded.cast("bigint").alias("n")).groupBy("doc_id").agg(
        F.sum("n").alias("n_lines"))
    kept = kept_lines(docs, id_col, text_col).groupBy("doc_id").agg(
        F.sort_array(F.collect_list("line_no")).alias("kept_lines")).withColumnRenamed("doc_id", "__id")
    none = F.array().cast("array<int>")
    return total.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select(
        "doc_id", "n_lines", F.size(F.coalesce("kept_lines", none)).cast("bigint").alias("n_kept"),
        F.coalesce("kept_lines", none).alias("kept_lines"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that don't stay cut from the texts (blank lines stay), all columns kept."""
    kept = line_dedup(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), "kept_lines")
    joined = docs.join(kept, F.col(id_col).eqNullSafe(F.col("__id")))
    parts = joined.withColumn("__lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    stay = F.filter(F.col("__lines"), lambda x, i: F.array_contains("kept_lines", i) | (F.size(words(x)) == 0))
    text = F.when(F.col(text_col).isNotNull(), F.array_join(stay, "\n"))
    return parts.withColumn(text_col, text).select(*docs.columns)
