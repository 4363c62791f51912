"""Operator 6: mixing sources to target weights by Pfair scheduling.

The documents of a source, in a fixed pseudo-random order, are cut into
blocks. Block j of a source with weight w is released at slot
floor((j - 1) / w) and due at slot ceil(j / w); of the released blocks the
one due first takes the next slot. For unit blocks and weights that sum to
one this meets every deadline, so at any slot each source has had its share
to within less than one block.

Weights are whole shares of ``sum(shares)`` slots, and the schedule repeats
after that many slots. The pattern of one round depends on the weights
alone; a block's slot follows from its number by arithmetic. So no task and
no driver ever walks over the blocks. When a source has run out, its slots
stay idle, and the others keep their proportions.

Everything on the main path is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.llm.common import cut_lineage

#: The group of all sources that no share names, and of null sources.
REST = "other"


def pattern(shares: dict[str, int]) -> list[tuple[str, int, int]]:
    """One round: (source, number of its block within the round, slot), by earliest deadline first.

    Ties of deadline go to the later release, then to the name.
    """
    if not shares or any(n < 1 for n in shares.values()):
        raise ValueError("shares must be positive whole numbers")
    round_slots = sum(shares.values())
    done = dict.fromkeys(shares, 0)
    out = []
    for slot in range(round_slots):
        ready = [(-(-(done[s] + 1) * round_slots // n), -(done[s] * round_slots // n), s)
                 for s, n in shares.items() if done[s] < n and done[s] * round_slots // n <= slot]
        s = min(ready)[2]
        out.append((s, done[s], slot))
        done[s] += 1
    return out


def order_key(id_col: str) -> Column:
    """A pseudo-random but fixed order of the documents within a source."""
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def mix(docs: DataFrame, shares: dict[str, int], block: int = 16, id_col: str = "doc_id",
        source_col: str = "source", bucket_rows: int = 2_000) -> DataFrame:
    """``docs`` with ``mix_source``, ``mix_block``, ``mix_slot`` and ``mix_offset``.

    ``shares``: whole shares per source; sources without one, null included,
    are pooled under ``"other"`` (which gets one share if it has none).
    Reading in the order (mix_slot, mix_offset) interleaves the sources. All
    rows are kept. Rows that repeat an id follow one another in an arbitrary
    order. An empty table gives an empty result. Columns of ``docs`` that have
    one of the four new names are replaced.

    A source is numbered in buckets of its order key (some ``bucket_rows``
    rows each), so a hot source spreads over many tasks.
    """
    shares = dict(shares)
    shares.setdefault(REST, 1)
    docs = docs.drop("mix_source", "mix_block", "mix_slot", "mix_offset")
    spark = docs.sparkSession
    named = [s for s in shares if s != REST]
    group = F.when(F.col(source_col).isin(named), F.col(source_col)).otherwise(F.lit(REST))
    n_buckets = max(1, docs.count() // bucket_rows)
    key = order_key(id_col)
    # the leading 28 bits of the key, scaled: buckets in the order of the key
    bucket = F.floor(F.conv(F.substring(key, 1, 7), 16, 10).cast("bigint") * F.lit(n_buckets) / F.lit(1 << 28))
    slim = docs.select(group.alias("mix_source"), bucket.cast("bigint").alias("__bucket"))
    # at most sources x buckets rows
    sizes = cut_lineage(slim.groupBy("mix_source", "__bucket").agg(F.count(F.lit(1)).alias("__n")))
    ahead = Window.partitionBy("mix_source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("mix_source").alias("__s"), F.col("__bucket").alias("__b"),
                          F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    rows = docs.withColumns({"mix_source": group, "__bucket": bucket.cast("bigint"), "__key": key}).join(
        starts, (F.col("mix_source") == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    within = Window.partitionBy("mix_source", "__bucket").orderBy("__key", id_col)
    rank = F.col("__start") + F.row_number().over(within) - 1
    rounds = spark.createDataFrame(pattern(shares), "__ps string, __pj bigint, __pslot bigint")
    quota = F.create_map(*(F.lit(x) for s, n in shares.items() for x in (s, n)))[F.col("mix_source")].cast("bigint")
    rows = rows.withColumn("__rank", rank).withColumns({
        "mix_block": F.floor(F.col("__rank") / block).cast("bigint"),
        "mix_offset": (F.col("__rank") % block).cast("int")}).withColumns({
        "__j": F.col("mix_block") % quota, "__round": F.floor(F.col("mix_block") / quota).cast("bigint")})
    # the pattern has one row per slot of a round: its size is that of the weights, not of the data
    rows = rows.join(F.broadcast(rounds), (F.col("mix_source") == F.col("__ps")) & (F.col("__j") == F.col("__pj")))
    return rows.withColumn("mix_slot", F.col("__round") * sum(shares.values()) + F.col("__pslot")).select(
        *docs.columns, "mix_source", "mix_block", "mix_slot", "mix_offset")


def mixed_order(docs: DataFrame, shares: dict[str, int], **options) -> DataFrame:
    """``docs`` with its own columns only, its rows (and so the files written from it) in mixed order."""
    return mix(docs, shares, **options).orderBy("mix_slot", "mix_offset").select(*docs.columns)


def mix_sql(shares: dict[str, int], block: int, columns: str = "doc_id, source", src: str = "documents") -> str:
    """DuckDB SQL with the rows of ``mix``; the pattern of one round is a parameter of the query."""
    shares = dict(shares)
    shares.setdefault(REST, 1)
    named = ", ".join(f"'{s}'" for s in shares if s != REST)
    rounds = ", ".join(f"('{s}', {j}, {slot}, {shares[s]})" for s, j, slot in pattern(shares))
    return f"""
WITH rounds(s, j, slot, quota) AS (VALUES {rounds}),
d AS (SELECT *, CASE WHEN source IN ({named}) THEN source ELSE '{REST}' END AS mix_source FROM {src}),
r AS (SELECT *, row_number() OVER (PARTITION BY mix_source
      ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rk FROM d),
q AS (SELECT r.*, rk // {block} AS mix_block, CAST(rk % {block} AS INTEGER) AS mix_offset, n.quota
      FROM r JOIN (SELECT DISTINCT s, quota FROM rounds) n ON n.s = r.mix_source)
SELECT {columns}, mix_source, mix_block,
       CAST((mix_block // q.quota) * {sum(shares.values())} + rounds.slot AS BIGINT) AS mix_slot, mix_offset
FROM q JOIN rounds ON rounds.s = q.mix_source AND rounds.j = mix_block % q.quota"""
