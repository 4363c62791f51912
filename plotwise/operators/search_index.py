"""Recommendation indexes: built and stored once, scored many times (survey R1, R2, R5-R9, J6).

``build_index`` turns texts into tf-idf vectors (R1) and writes them twice:
by document, as counts (those of one id are read alone), and by term, as
postings before their norm, with the largest weight of each term. The norms
are a row for each document. So the terms of all texts are shuffled once, to
their postings; what else is shuffled are the texts themselves, by id, and
sums. A request reads the counts of its ids and the postings of their terms,
and no text.

``top`` finds the n best rows of each of many requests without scoring every
row that shares a term:

1. The rarest terms of a request already give partial scores; the n-th of
   these is a lower bound for the n-th best score.
2. Documents are in classes by their number of terms, with the largest weight
   of each term in each class. By class, a request's cheapest terms (least
   possible score for most postings) are left aside as long as all of them
   together can't reach that bound, neither by the sum of their largest
   products nor by Cauchy-Schwarz. A document that holds only such terms is
   no candidate, so their postings aren't read for candidates.
3. Candidates whose partial score plus that bound falls short of the n-th
   best partial score go; for the others the terms left aside are added.

The result is exact. Requests may be one id or every row (J6, all nearest
neighbours). Where the postings of all their terms are few (counted from the
terms' frequencies), they are scored in one pass instead, with the same result.

``build_standardised`` does the same for standardised views (R4-R6), kept as
sparse deltas from the default and one row for each entity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plotwise.functions.text import TOKEN_PATTERN, bigrams, tokens
from plotwise.operators.joins import checked_broadcast
from plotwise.operators.quantiles import computed_once
from plotwise.operators.similarity import default_stop_words, standardise_long
from plotwise.session import cut_lineage, shuffles_dropped

#: Postings in a bucket (a folder that is read or skipped whole), and the most buckets.
BUCKET_ROWS, MAX_BUCKETS = 2_000_000, 4096
#: Postings of one term that go to one file; a more frequent term is spread over several tasks.
FILE_ROWS = 2_000_000
#: Rows that the rarest terms of a request may match in the first step.
SEED_ROWS = 1000
#: Bytes of texts in a bucket of the counts by id, and in one task that counts them.
BUCKET_BYTES, TASK_BYTES = 16 << 20, 8 << 20
#: An estimate that says nothing (rows from the driver or from joins); the texts are measured then.
UNKNOWN_BYTES = 1 << 50
#: Rows of a term beyond which they are dealt to several tasks (their frequencies are broadcast, checked).
FREQUENT = 100_000
#: Slots of the term counts by hash that find frequent terms at least, and the counts that a slot has on average at most.
LEAST_SLOTS, SLOT_ROWS = 1 << 16, 25_000
#: Norms that are broadcast as one table; those of more rows are broadcast in several parts, each joined to its own rows.
NORM_ROWS = 1_000_000
#: Postings that one task sums to norms: each task sends a row for every id it meets.
NORM_TASK_ROWS = 50_000_000
#: Postings that are combined to terms before they are shuffled.
COMBINED_ROWS = 1_000_000
#: Requests whose terms have no more postings than this in all are scored on all of them, in one pass.
PLAIN_ROWS = 20_000_000
EPS = 1e-9


def bucket_of(col, buckets: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")


def raw_weight(n_docs: int) -> Column:
    """tf-idf of the columns tf and df, before the norm."""
    return F.col("tf") * (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1)


def counted_terms(df: DataFrame, id_col: str, text_col: str, stop_words=None, ngram_max: int = 2,
                  pattern: str = TOKEN_PATTERN) -> DataFrame:
    """(id, terms: array of (term, tf)) of each row with an id, counted inside the row: nothing is shuffled."""
    stops = list(stop_words if stop_words is not None else default_stop_words())
    toks = F.filter(tokens(text_col, pattern), lambda t: ~t.isin(stops)) if stops else tokens(text_col, pattern)
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), toks.alias("t"))
    grams = F.concat(F.col("t"), bigrams(F.col("t"))) if ngram_max >= 2 else F.col("t")
    # (no filter of rows without terms: pushed below, it would cut the text again for each of its words)
    rows = rows.select("id", F.array_sort(grams).alias("g"))
    # equal terms stand together: where each begins, and how far it is to the next
    places = F.when(F.size("g") > 0, F.sequence(F.lit(0), F.size("g") - 1)).otherwise(F.array().cast("array<int>"))
    begins = F.filter(places, lambda i: (i == 0) | (F.get("g", i) != F.get("g", i - 1)))
    rows = rows.select("id", "g", begins.alias("b"))
    return rows.select("id", F.transform("b", lambda s, k: F.struct(
        F.get("g", s).alias("term"), (F.coalesce(F.get("b", k + 1), F.size("g")) - s).alias("tf"))).alias("terms"))


class SearchIndex:
    """An opened index; ``path`` is all that it needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = spark.read.json(f"{path}/meta").first()
        self.n_docs, self.n_postings, self.buckets, self.id_buckets = meta.n_docs, meta.n_postings, meta.buckets, meta.id_buckets

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def items(self) -> DataFrame:
        """(id, norm) of every row that was indexed, once; a row without terms has no norm."""
        return self._read("items")

    @property
    def forward(self) -> DataFrame:
        """(bucket, id, class, terms: array of (term, tf))."""
        return self._read("forward")

    @property
    def postings(self) -> DataFrame:
        """(bucket, term, class, id, w)."""
        return normed(self._read("postings"), self.items, self.n_docs).select(
            "bucket", "term", "class", "id", (F.col("raw") / F.col("norm")).alias("w"))

    def _normed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the norm of their id."""
        return rows.join(checked_broadcast(self.items), "id")

    def _raw(self) -> Column:
        """The weight of tf and df before the norm."""
        return raw_weight(self.n_docs)

    @property
    def terms(self) -> DataFrame:
        """(bucket, term, df, classes: array of (class, df, max_w))."""
        return self._read("terms")

    def weights(self) -> DataFrame:
        """(id, term, weight)."""
        return self.postings.select("id", "term", F.col("w").alias("weight"))

    def vectors(self, requests) -> DataFrame:
        """(query_id, term, wq) of the requested ids (a list, or a table whose first column they are)."""
        rows = self.forward
        if isinstance(requests, DataFrame):
            ids = requests.select(F.col(requests.columns[0]).alias("id")).distinct()
            rows = rows.join(checked_broadcast(ids.withColumn("bucket", bucket_of("id", self.id_buckets))), ["bucket", "id"])
        else:
            one = [(F.col("bucket") == bucket_of(F.lit(i).cast(rows.schema["id"].dataType), self.id_buckets)) & (F.col("id") == i)
                   for i in dict.fromkeys(requests)]
            rows = rows.filter(reduce(lambda a, b: a | b, one, F.lit(False)))
        held = rows.select("id", F.explode("terms").alias("t")).select(
            "id", bucket_of("t.term", self.buckets).alias("bucket"), "t.term", "t.tf")
        if not isinstance(requests, DataFrame):
            # the counts of a few ids, held by the driver
            held = self.spark.createDataFrame(held.collect(), held.schema)
        found = self._buckets_read(self.terms, held) if not isinstance(requests, DataFrame) else self.terms
        raw = held.join(found.select("bucket", "term", "df"), ["bucket", "term"]).select("id", "term", self._raw().alias("raw"))
        norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
        return raw.join(norms, "id").select(F.col("id").alias("query_id"), "term", (F.col("raw") / F.col("norm")).alias("wq"))

    def _buckets_read(self, rows: DataFrame, q: DataFrame) -> DataFrame:
        """``rows`` in the buckets of the terms of ``q``: folders of other terms are not opened."""
        found = [r.bucket for r in q.select("bucket").distinct().collect()]  # at most MAX_BUCKETS numbers
        return rows if len(found) == self.buckets else rows.filter(F.col("bucket").isin(found))

    def _vectors_read(self, requests) -> DataFrame:
        """``vectors`` with the bucket of each term, read once; those of a list of ids are held by the driver."""
        q = self.vectors(requests)
        rows = cut_lineage(q) if isinstance(requests, DataFrame) else self.spark.createDataFrame(q.collect(), q.schema)
        return rows.withColumn("bucket", bucket_of("term", self.buckets))

    def _matches(self, q: DataFrame, on=("bucket", "term"), listed: bool = False) -> DataFrame:
        """(query_id, id, class, score): the sums over the postings of the terms of ``q``."""
        q = F.broadcast(q) if listed else checked_broadcast(q)
        sums = self._buckets_read(self._read("postings"), q).join(q, list(on)).groupBy("query_id", "id", "class").agg(
            F.sum(F.col("raw") * F.col("wq")).alias("sum"))
        return self._normed(sums).select("query_id", "id", "class", (F.col("sum") / F.col("norm")).alias("score"))

    def scores(self, requests) -> DataFrame:
        """R2: (query_id, id, score) of every pair that shares a term."""
        return self._matches(self._vectors_read(requests), listed=not isinstance(requests, DataFrame)).drop("class")

    def top(self, requests, n: int, rank_digits: int = 10, seed_rows: int = SEED_ROWS) -> DataFrame:
        """(query_id, rank, id, score): the ``n`` rows of highest score for each request, the request's own row
        included, ties (at ``rank_digits``) by id, and rows of score 0 by id where no others are left. Unknown ids
        give no rows."""
        listed = not isinstance(requests, DataFrame)
        q = self._vectors_read(requests)
        if self.n_postings > PLAIN_ROWS or not listed:
            q = cut_lineage(q.join(self._buckets_read(self.terms, q) if listed else self.terms, ["bucket", "term"]))
            pruned = (q.agg(F.sum("df")).first()[0] or 0) > PLAIN_ROWS
        else:
            pruned = False
        scored = self._pruned(q, n, seed_rows) if pruned else self._matches(
            q.select("bucket", "term", "query_id", "wq"), listed=listed).drop("class")
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", rank_digits)), "id")
        found = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(
            "query_id", "rank", "id", "score")
        # of a list, n rows for each; else a table
        found = self.spark.createDataFrame(found.collect(), found.schema) if listed else cut_lineage(found)
        return self._filled(found, requests, n).select("query_id", "rank", "id", "score")

    def _pruned(self, q: DataFrame, n: int, seed_rows: int) -> DataFrame:
        """(query_id, id, score) of rows that hold the ``n`` best of each request; see the head of the module."""
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

        def nth(scored: DataFrame) -> DataFrame:
            return scored.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= n).groupBy("query_id").agg(
                F.when(F.count(F.lit(1)) >= n, F.min("score")).alias("bound"))

        # 1. a lower bound from the rarest terms
        rare = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
        seeds = q.withColumn("before", F.coalesce(F.sum("df").over(rare), F.lit(0))).filter(
            F.col("before") < seed_rows).select("bucket", "term", "query_id", "wq")
        bound = cut_lineage(nth(self._matches(cut_lineage(seeds))))
        # 2. the terms that can be left aside, by class
        by_class = q.select("query_id", "bucket", "term", "wq", F.col("df").alias("all"), F.explode("classes").alias("c")).select(
            "query_id", "bucket", "term", "wq", "all", "c.class", "c.df", (F.col("wq") * F.col("c.max_w")).alias("ub"))
        cheap = Window.partitionBy("query_id", "class").orderBy(F.col("ub") / F.col("df"), "term").rowsBetween(
            Window.unboundedPreceding, 0)
        most = F.least(F.sum("ub").over(cheap), F.sqrt(F.sum(F.col("wq") * F.col("wq")).over(cheap)))
        split = cut_lineage(by_class.withColumn("most", most).join(checked_broadcast(bound), "query_id", "left").withColumn(
            "aside", F.coalesce(F.col("most") < F.col("bound") - EPS, F.lit(False))).drop("df", "ub"))
        rest = split.filter("aside").groupBy("query_id", "class").agg(F.max("most").alias("rest"))
        essential = split.filter(~F.col("aside")).select("bucket", "term", "class", "query_id", "wq")
        partial = cut_lineage(self._matches(essential, ("bucket", "term", "class")))
        # 3. what the terms left aside add to those still in question
        bound2 = nth(partial)
        near = partial.join(checked_broadcast(cut_lineage(bound2)), "query_id", "left").join(
            checked_broadcast(cut_lineage(rest)), ["query_id", "class"], "left")
        near = cut_lineage(near.filter(F.col("bound").isNull() | (
            F.col("score") + F.coalesce("rest", F.lit(0.0)) >= F.col("bound") - EPS)).select("query_id", "id", "class", "score"))
        aside = split.filter("aside").select("query_id", "class", "term", "wq", F.col("all").alias("df"))
        unsure = near.join(aside.select("query_id", "class").distinct(), ["query_id", "class"], "left_semi")
        held = self.forward.select("bucket", "id", "terms").join(
            checked_broadcast(unsure.withColumn("bucket", bucket_of("id", self.id_buckets))), ["bucket", "id"])
        sums = held.select("query_id", "id", "class", F.explode("terms").alias("t")).select(
            "query_id", "id", "class", "t.term", "t.tf").join(aside, ["query_id", "class", "term"]).groupBy(
            "query_id", "id").agg(F.sum(self._raw() * F.col("wq")).alias("sum"))
        more = self._normed(sums).select("query_id", "id", (F.col("sum") / F.col("norm")).alias("more"))
        return near.join(more, ["query_id", "id"], "left").select(
            "query_id", "id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))

    def _filled(self, found: DataFrame, requests, n: int) -> DataFrame:
        """Rows of score 0, in the order of their ids, for requests with fewer than ``n`` rows."""
        if isinstance(requests, DataFrame):
            asked = requests.select(F.col(requests.columns[0]).alias("query_id")).distinct()
        else:
            ids = list(dict.fromkeys(requests))
            rows = found.collect()
            if ids and all(sum(r.query_id == i for r in rows) == n for i in ids):
                return found
            asked = self.spark.createDataFrame([(i,) for i in ids], "query_id string" if ids and isinstance(ids[0], str) else "query_id bigint")
        asked = asked.join(self.items.select(F.col("id").alias("query_id")), "query_id", "left_semi")
        have = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
        short = cut_lineage(asked.join(have, "query_id", "left").select(
            "query_id", F.coalesce("have", F.lit(0)).alias("have")).filter(F.col("have") < n))
        if short.isEmpty():
            return found
        # of the 2n least ids, at most n are in the result already
        least = [r.id for r in self.items.orderBy("id").limit(2 * n).collect()]
        spare = short.select("query_id", "have", F.explode(F.array(*map(F.lit, least))).alias("id")).join(
            found.select("query_id", "id"), ["query_id", "id"], "left_anti")
        order = Window.partitionBy("query_id").orderBy("id")
        added = spare.withColumn("rank", F.col("have") + F.row_number().over(order)).filter(F.col("rank") <= n)
        return found.select("query_id", "rank", "id", "score").unionByName(
            added.select("query_id", F.col("rank").cast("int").alias("rank"), "id", F.lit(0.0).alias("score")))

    def recommend(self, requests, n: int = 5, exclude_self: bool = False, digits: int | None = 4) -> DataFrame:
        """R7 for many requests: rank 1 (taken to be the row itself) is skipped and the next ``n`` returned, or the
        row itself is left out (``exclude_self``)."""
        best = self.top(requests, n + 1)
        if exclude_self:
            order = Window.partitionBy("query_id").orderBy("rank")
            kept = best.filter(F.col("id") != F.col("query_id")).withColumn("rank", F.row_number().over(order))
            kept = kept.filter(F.col("rank") <= n)
        else:
            kept = best.filter(F.col("rank") > 1).withColumn("rank", F.col("rank") - 1)
        return kept.withColumn("score", F.round("score", digits)) if digits is not None else kept


def normed(rows: DataFrame, items: DataFrame, n_docs: int) -> DataFrame:
    """Postings with the norm of their id. Their texts are never shuffled: where the norms are too many for one broadcast,
    each part of the ids is, and a scan of the postings for each part joins its own rows."""
    parts = max(1, -(-n_docs // NORM_ROWS))
    if parts == 1:
        return rows.join(F.broadcast(items), "id")
    part = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts))
    # an id's copies are one row of the items, so that a part holds NORM_ROWS rows, more or less
    each = [rows.filter(part == k).join(F.broadcast(items.filter(part == k)), "id") for k in range(parts)]
    return reduce(DataFrame.unionByName, each)


def _combining(most: int):
    """For each task: (bucket, term, class, df, max_w) of its postings, some ``most`` at a time."""
    def done(held):
        rows = pa.Table.from_batches(held)
        found = rows.group_by(["bucket", "term", "class"], use_threads=False).aggregate([("w", "count"), ("w", "max")])
        return found.select(["bucket", "term", "class", "w_count", "w_max"]).rename_columns(
            ["bucket", "term", "class", "df", "max_w"]).to_batches(max_chunksize=100_000)

    # (a closure, so that the tasks need not import this module)
    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= most:
                yield from done(held)
                held, n = [], 0
        if held:
            yield from done(held)

    return combined


def build_index(df: DataFrame, id_col: str, text_col: str, path: str, stop_words=None, ngram_max: int = 2,
                pattern: str = TOKEN_PATTERN, buckets: int | None = None) -> SearchIndex:
    """Write the index of ``df`` to ``path`` (in shared storage) and open it. Rows that repeat an id count as one text;
    rows without an id are counted in n, as in R1, but can't be found."""
    with shuffles_dropped(df.sparkSession):
        return _build_index(df, id_col, text_col, path, stop_words, ngram_max, pattern, buckets)


def _frequent(counts: DataFrame, total: int) -> DataFrame:
    """(term, many): the rows of each term with more than ``FREQUENT``, of which there are at most ``total / FREQUENT``.
    Counts by a hash of the term, of bounded number, say which terms are counted themselves: all others are rarer."""
    slot = F.pmod(F.xxhash64("term", F.lit(3)), F.lit(max(LEAST_SLOTS, total // SLOT_ROWS))).alias("slot")
    held = counts.select("term", slot)
    full = cut_lineage(held.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FREQUENT).select("slot"))
    return cut_lineage(held.join(F.broadcast(full), "slot").groupBy("term").agg(F.count(F.lit(1)).alias("many")).filter(
        F.col("many") > FREQUENT))


def _build_index(df: DataFrame, id_col: str, text_col: str, path: str, stop_words, ngram_max: int, pattern: str,
                 buckets: int | None) -> SearchIndex:
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN_BYTES:
        size = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("bigint"))).first()[0] or 0
    n_docs = df.count()
    # by id: the texts are shuffled, not the several times larger lists of their terms
    id_buckets = buckets or max(8, min(MAX_BUCKETS, size // BUCKET_BYTES))
    tasks = max(spark.sparkContext.defaultParallelism, min(MAX_BUCKETS, size // TASK_BYTES))
    places = [bucket_of("id", id_buckets), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(-(-tasks // id_buckets)))]
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null").repartition(tasks, *places)
    rows = counted_terms(texts, "id", "text", stop_words, ngram_max, pattern)
    if not df.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").isEmpty():
        once = rows.select("id", F.explode_outer("terms").alias("t")).select("id", "t.*").groupBy("id", "term").agg(
            F.sum("tf").cast("int").alias("tf"))
        rows = once.groupBy("id").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("terms"))
    schema = f"id {kind}, class int, terms array<struct<term string, tf int>>, bucket int"
    rows.select("id", F.floor(F.log2(F.size("terms"))).cast("int").alias("class"), "terms", places[0].alias("bucket")).write.partitionBy(
        "bucket").parquet(f"{path}/forward")
    forward = spark.read.schema(schema).parquet(f"{path}/forward")
    total = forward.agg(F.sum(F.size("terms").cast("bigint"))).first()[0] or 0
    if not n_docs:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/forward")
    buckets = buckets or max(8, min(MAX_BUCKETS, -(-total // BUCKET_ROWS)))
    if total:
        counts = forward.select("id", "class", F.explode("terms").alias("t")).select("id", "class", "t.term", "t.tf")
        parts = F.pmod(F.xxhash64("term", F.lit(1)), F.lit(max(1, total // buckets // FILE_ROWS)))
        dealt = counts.join(F.broadcast(_frequent(counts, total)), "term", "left").select(
            bucket_of("term", buckets).alias("bucket"), "term", "class", "id", "tf", "many",
            F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("many", F.lit(1)) / FREQUENT)).cast("int").alias("salt"))
        dealt = dealt.withColumn("part", parts.cast("int")).repartition("bucket", "part", "salt")
        alone = F.count(F.lit(1)).over(Window.partitionBy("bucket", "part", "salt", "term"))
        dealt.withColumn("df", F.coalesce("many", alone)).select(
            "bucket", "term", "class", "id", raw_weight(n_docs).alias("raw")).write.partitionBy("bucket").parquet(f"{path}/postings")
        postings = spark.read.schema(f"term string, class int, id {kind}, raw double, bucket int").parquet(f"{path}/postings")
        tasks = max(spark.sparkContext.defaultParallelism, total // NORM_TASK_ROWS)
        norms = postings.select("id", "raw").coalesce(tasks).groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
        forward.select("id").join(norms, "id", "left").write.parquet(f"{path}/items")
        items = spark.read.schema(f"id {kind}, norm double").parquet(f"{path}/items")
        # combined in the tasks and shuffled once, by what the folders and files are dealt by
        tops = normed(postings, items, n_docs).select("bucket", "term", "class", (F.col("raw") / F.col("norm")).alias("w")).mapInArrow(
            _combining(COMBINED_ROWS), "bucket int, term string, class int, df bigint, max_w double")
        tops = tops.withColumn("part", parts.cast("int")).repartition("bucket", "part").groupBy("bucket", "part", "term", "class").agg(
            F.sum("df").alias("df"), F.max("max_w").alias("max_w"))
        tops.groupBy("bucket", "part", "term").agg(
            F.sum("df").alias("df"), F.sort_array(F.collect_list(F.struct("class", "df", "max_w"))).alias("classes")).drop(
            "part").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    else:
        forward.select("id", F.lit(None).cast("double").alias("norm")).write.parquet(f"{path}/items")
        for name, schema in (("postings", f"term string, class int, id {kind}, raw double"),
                             ("terms", "term string, df bigint, classes array<struct<class int, df bigint, max_w double>>")):
            spark.createDataFrame([], f"bucket int, {schema}").write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(n_docs, total, buckets, id_buckets)],
                          "n_docs bigint, n_postings bigint, buckets int, id_buckets int").coalesce(1).write.json(f"{path}/meta")
    return SearchIndex(spark, path)


class StandardisedIndex:
    """R4-R6 stored: deltas by key and by entity, and for each entity its sums; see ``build_standardised``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = spark.read.json(f"{path}/meta").first()
        self.s0, self.buckets = meta.s0, meta.buckets

    def scores(self, requests: list) -> DataFrame:
        """(query_id, id, score): the cosine of every entity with each of a few requested ones. Unknown ids give no rows."""
        entities = self.spark.read.parquet(f"{self.path}/entities")
        by_id = self.spark.read.parquet(f"{self.path}/by_id")
        kind = entities.schema["id"].dataType
        ids = list(dict.fromkeys(requests))
        asked = entities.filter(F.col("id").isin(ids)).collect()  # a row for each request
        if not asked:
            return entities.limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"))
        own = reduce(lambda a, b: a | b, [(F.col("bucket") == bucket_of(F.lit(i).cast(kind), self.buckets)) & (F.col("id") == i)
                                          for i in ids])
        q = cut_lineage(by_id.filter(own).select(F.col("id").alias("query_id"), "key", F.col("d").alias("dq")).withColumn(
            "bucket", bucket_of("key", self.buckets)))
        found = [r.bucket for r in q.select("bucket").distinct().collect()]
        by_key = self.spark.read.parquet(f"{self.path}/by_key").filter(F.col("bucket").isin(found))
        cross = by_key.join(checked_broadcast(q), ["bucket", "key"]).groupBy("query_id", "id").agg(
            F.sum(F.col("d") * F.col("dq")).alias("c"))
        each = F.explode(F.array(*[F.struct(F.lit(r.id).cast(kind).alias("query_id"), F.lit(r.p).alias("pq"),
                                            F.lit(r.norm).alias("nq")) for r in asked]))
        base = entities.select("id", "p", "norm", each.alias("r")).select("id", "p", "norm", "r.*")
        dot = self.s0 + F.col("pq") + F.col("p") + F.coalesce("c", F.lit(0.0))
        score = F.when((F.col("norm") > 0) & (F.col("nq") > 0), dot / (F.col("norm") * F.col("nq"))).otherwise(0.0)
        return base.join(cross, ["query_id", "id"], "left").select("query_id", "id", score.alias("score"))


def build_standardised(long_df: DataFrame, entities: DataFrame, id_col: str, key: str, value: str, default: float,
                       path: str, buckets: int | None = None) -> StandardisedIndex:
    """Write the standardised sparse view (R4) to ``path`` and open it.

    With z = z0 + delta, dot(a, b) = sum z0^2 + sum_a d*z0 + sum_b d*z0 + sum_{a and b} d_a*d_b: what is stored of an
    entity are its second sum and its norm, and the deltas by key for the last sum.
    """
    spark = entities.sparkSession
    # statistics and deltas both read the entries
    entries = computed_once(long_df)
    stats, deltas = standardise_long(entries, entities, id_col, key, value, default)
    buckets = buckets or max(8, min(MAX_BUCKETS, -(-entries.count() // BUCKET_ROWS)))
    s0 = stats.agg(F.sum(F.col("z0") * F.col("z0"))).first()[0] or 0.0
    # the deltas are stored once, by entity: all else reads them there, where an entity's sums are whole before they are shuffled
    held = deltas.select(F.col(id_col).alias("id"), F.col(key).cast("string").alias("key"), "d", "z0",
                         bucket_of(id_col, buckets).alias("bucket"))
    held.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/by_id")
    deltas = spark.read.schema(held.schema).parquet(f"{path}/by_id")
    per = deltas.groupBy("id").agg(F.sum(F.col("d") * F.col("z0")).alias("p"), F.sum(F.col("d") * F.col("d")).alias("qq"))
    entities.select(F.col(id_col).alias("id")).join(per, "id", "left").fillna(0.0, subset=["p", "qq"]).select(
        "id", "p", F.sqrt(F.greatest(s0 + 2 * F.col("p") + F.col("qq"), F.lit(0.0))).alias("norm")).write.parquet(f"{path}/entities")
    # there may be few keys, each with an entry of every entity: the largest bucket decides how many tasks share one
    place = bucket_of("key", buckets).alias("bucket")
    most = deltas.groupBy(place).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    deltas.select(place, "key", "id", "d").repartition(
        "bucket", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-most // FILE_ROWS))))).sortWithinPartitions(
        "bucket", "key").write.partitionBy("bucket").parquet(f"{path}/by_key")
    spark.createDataFrame([(float(s0), buckets)], "s0 double, buckets int").coalesce(1).write.json(f"{path}/meta")
    return StandardisedIndex(spark, path)
