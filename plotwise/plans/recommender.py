"""The apartment recommender: from scraped text to three stored views, and recommendations from them (survey 3, R1-R9).

Input is the apartments export (``sources.io.APARTMENT_SCHEMA``): a name, a
list of facilities, a dictionary of price details by configuration and one of
distances by landmark, all as text. ``build`` parses them (T15-T18, T21) and
writes the facilities index and the standardised price and location views
under one path; ``scores`` and ``recommend`` read those alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plotwise.functions import rules
from plotwise.functions import text as T
from plotwise.operators import search_index as I
from plotwise.operators import similarity as R
from plotwise.operators.quantiles import computed_once
from plotwise.session import cut_lineage

VIEWS = R.VIEWS


def facilities_text(apartments: DataFrame, name: str = "PropertyName", col: str = "TopFacilities") -> DataFrame:
    """(id, text): the listed facilities as one text."""
    return apartments.select(F.col(name).alias("id"), T.join_list(T.parse_list(col)).alias("text"))


def price_long(apartments: DataFrame, name: str = "PropertyName", col: str = "PriceDetails", configs=rules.CONFIGS) -> DataFrame:
    """(id, feature, value): areas and prices of each configuration, and its building types as drop-first one-hot columns."""
    # one text of each name is parsed, in the tasks that the names are dealt to: the export may be a single file
    texts = apartments.select(F.col(name).alias("id"), F.col(col).alias("text")).repartition("id").dropDuplicates(["id"])
    parsed = texts.select("id", T.price_details_map("text").alias("m"))
    structs = {f"{c} ": F.try_element_at(F.col("m"), F.lit(c)) for c in configs}
    wide = T.config_facts_wide(parsed, structs, ["id"])
    if "Land" in configs:
        kind = F.col("`Land building_type`")
        wide = wide.withColumn("Land building_type", F.when(kind == "", "Land").otherwise(kind))
    wide = computed_once(wide)
    numbers = [f"{c} {k}" for c in configs for k in ("area_low", "area_high", "price_low", "price_high")]
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("value")) for n in numbers])
    long = wide.select("id", F.explode(cells).alias("c")).select("id", "c.feature", "c.value").filter("value is not null")
    kinds = F.array(*[F.struct(F.lit(f"{c} building_type").alias("column"), F.col(f"`{c} building_type`").alias("kind"))
                      for c in configs])
    hot = wide.select("id", F.explode(kinds).alias("c")).select("id", "c.column", "c.kind").filter("kind is not null")
    first = hot.groupBy("column").agg(F.min("kind").alias("first"))  # a row for each configuration
    hot = hot.join(F.broadcast(first), "column").filter("kind != first").select(
        "id", F.concat("column", F.lit("_"), "kind").alias("feature"), F.lit(1.0).alias("value"))
    return long.unionByName(hot)


def location_long(apartments: DataFrame, name: str = "PropertyName", col: str = "LocationAdvantages") -> DataFrame:
    """(id, landmark, metres) of the distances that can be read."""
    parsed = F.from_json(F.col(col), "map<string,string>", {"allowSingleQuotes": "true"})
    texts = apartments.select(F.col(name).alias("id"), F.col(col)).repartition("id")
    long = texts.select("id", F.explode(parsed).alias("landmark", "distance")).select(
        "id", "landmark", T.distance_to_meters("distance").alias("metres")).filter("metres is not null")
    return long.groupBy("id", "landmark").agg(F.max("metres").alias("metres"))


def build(apartments: DataFrame, path: str, name: str = "PropertyName") -> None:
    """Write the three views of ``apartments`` under ``path``. Rows without a name are left out; of rows that repeat one
    the facilities count together and the price details of one of them count."""
    rows = apartments.filter(F.col(name).isNotNull())
    entities = cut_lineage(rows.select(F.col(name).alias("id")).distinct())
    I.build_index(facilities_text(rows, name), "id", "text", f"{path}/facilities")
    I.build_standardised(price_long(rows, name), entities, "id", "feature", "value", 0.0, f"{path}/price")
    I.build_standardised(location_long(rows, name), entities, "id", "landmark", "metres", rules.MISSING_DISTANCE_M,
                         f"{path}/location")


def scores(spark: SparkSession, path: str, requests: list, weights: dict = rules.HYBRID_WEIGHTS) -> DataFrame:
    """(query_id, id, score) of every apartment for each of a few requested names: the weighted sum of the views
    that ``weights`` names. Unknown names give no rows."""
    unknown = set(weights) - set(VIEWS)
    if unknown or not weights:
        raise ValueError(f"views must be of {VIEWS}, not {sorted(unknown)}")
    parts = []
    for view, weight in weights.items():
        found = (I.SearchIndex(spark, f"{path}/facilities") if view == "facilities" else
                 I.StandardisedIndex(spark, f"{path}/{view}")).scores(requests)
        parts.append(found.select("query_id", "id", (F.col("score") * float(weight)).alias("score")))
    if "facilities" in weights and len(weights) == 1:
        # the other views have a row for every apartment
        every = I.StandardisedIndex(spark, f"{path}/price").scores(requests)
        parts.append(every.select("query_id", "id", F.lit(0.0).alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "id").agg(F.sum("score").alias("score"))


def recommend(spark: SparkSession, path: str, requests: list, n: int = 5, weights: dict = rules.HYBRID_WEIGHTS,
              digits: int = 4) -> DataFrame:
    """(query_id, rank, id, score): rank 1 (taken to be the apartment itself) is skipped, ties by name."""
    if not 1 <= n <= 20:
        raise ValueError("n must be within 1..20")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 10)), "id")
    # a bound on the row number itself: each task keeps the best rows of a request, and only these are ranked together
    ranked = scores(spark, path, requests, weights).withColumn("row", F.row_number().over(order)).filter(F.col("row") <= n + 1)
    return ranked.filter("row > 1").select(
        "query_id", (F.col("row") - 1).alias("rank"), "id", F.round("score", digits).alias("score"))
