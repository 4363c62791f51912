"""Profiles as stored sketches that can be merged (survey A3, A15, V10).

One pass makes a row for each group and column: counts, sum, least and
greatest value, and three sketches of bounded size, for distinct values
(HyperLogLog), quantiles (KLL) and frequent values (top-k). The rows are a
table like any other: those of days, files or sources are made once, kept, and
merged to the profile of any of their unions without reading the data again.
``estimates`` reads them; ``aggregates.profile`` is the exact form.

Sketches combine in the tasks that read the rows, so a group of a third of all
rows is one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

#: Size of the distinct-value sketch (2^k registers), of the quantile sketch, and items that a top-k sketch tracks.
DISTINCT_BITS, QUANTILE_K, TRACKED = 14, 800, 1000
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def sketch_profile(df: DataFrame, cols=None, by=(), tracked: int = TRACKED) -> DataFrame:
    """(by..., column_name, n, nulls, total, least, greatest, distinct, quantiles, frequent) of each group and column.

    ``total``, ``least``, ``greatest`` and ``quantiles`` are null for columns that are no numbers. Other columns (texts,
    dates, booleans) count as texts. An empty table without ``by`` gives rows of zero counts.
    """
    by = list(by)
    cols = [c for c in (cols or df.columns) if c not in by]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for i, c in enumerate(cols):
        x, text = F.col(f"`{c}`"), f"cast(`{c}` as string)"
        aggs += [F.count(x).alias(f"n{i}"), F.count_if(x.isNull()).alias(f"z{i}"),
                 F.hll_sketch_agg(F.expr(text), DISTINCT_BITS).alias(f"d{i}"),
                 F.expr(f"approx_top_k_accumulate({text}, {int(tracked)})").alias(f"f{i}")]
        if isinstance(kinds[c], _NUMBERS):
            v = x.cast("double")
            aggs += [F.sum(v).alias(f"s{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                     F.kll_sketch_agg_double(v, QUANTILE_K).alias(f"q{i}")]
    row = df.groupBy(*by).agg(*aggs)
    none, parts = F.lit(None), []
    for i, c in enumerate(cols):
        number = isinstance(kinds[c], _NUMBERS)
        parts.append(F.struct(
            F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"z{i}").alias("nulls"),
            *[(F.col(f"{k}{i}") if number else none).cast(t).alias(name)
              for k, name, t in (("s", "total", "double"), ("lo", "least", "double"), ("hi", "greatest", "double"))],
            F.col(f"d{i}").alias("distinct"), (F.col(f"q{i}") if number else none).cast("binary").alias("quantiles"),
            F.col(f"f{i}").alias("frequent")))
    return row.select(*by, F.explode(F.array(*parts)).alias("p")).select(*by, "p.*")


def merge_profiles(profiles: DataFrame, by=(), tracked: int = TRACKED) -> DataFrame:
    """The profiles of the unions: those of the same ``by`` and column become one."""
    return profiles.groupBy(*by, "column_name").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("total").alias("total"), F.min("least").alias("least"),
        F.max("greatest").alias("greatest"), F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.expr(f"approx_top_k_combine(frequent, {int(tracked)})").alias("frequent"))


def estimates(profiles: DataFrame, qs=(0.25, 0.5, 0.75), k: int = 5) -> DataFrame:
    """What the sketches say: column_name, n, nulls, n_distinct, mean, min, max, quantiles (array, as ``qs``) and top
    (array of (item, count), the ``k`` most frequent values as texts), with whatever names the groups."""
    rest = [c for c in profiles.columns if c not in ("column_name", "n", "nulls", "total", "least", "greatest", "distinct",
                                                     "quantiles", "frequent")]
    known = F.col("least").isNotNull()  # a sketch of no numbers has no quantiles
    return profiles.select(
        *rest, "column_name", "n", "nulls", F.hll_sketch_estimate("distinct").alias("n_distinct"),
        F.try_divide("total", "n").alias("mean"), F.col("least").alias("min"), F.col("greatest").alias("max"),
        F.when(known, F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(float(q))) for q in qs])).alias("quantiles"),
        F.expr(f"approx_top_k_estimate(frequent, {int(k)})").alias("top"))
