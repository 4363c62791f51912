"""End-to-end listing preparation (survey 3.1): raw flats + raw houses ->
cleaned -> union -> locality -> features -> outliers -> imputation ->
binned model table. One lazy chain; the blocking points are the grouped
aggregates (frequency filter, IQR bounds, ratio medians, modes) and the
furnishing k-means fit.

Row-label corrections of the reference (``drop(index=...)``,
``loc[i, col] = v``) are data, not code: pass them as a corrections table
``(listing_id, column, value)`` with ``value`` null for a drop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plotwise.functions import recode as B
from plotwise.functions import rules
from plotwise.functions import text as X
from plotwise.operators import encode as E
from plotwise.operators import filters as Fl
from plotwise.operators import joins as J
from plotwise.operators import outliers as Q
from plotwise.operators import similarity as R
from plotwise.session import cut_lineage
from plotwise.streaming.rowwise import clean_listing_columns


def clean_source(raw: DataFrame, kind: str) -> DataFrame:
    """Stage 1 (per source): drop the sentinel price, parse every text column,
    drop rows without bedrooms, derive the area from price and rate."""
    df = Fl.drop_sentinel(raw, "price", "Price on Request")
    df = Fl.not_null(df, "bedRoom")
    out = clean_listing_columns(df, kind)
    out = out.withColumn("area", X.half_even(X.safe_div(F.col("price") * 1e7, F.col("price_per_sqft")), 0))
    return out.withColumn("facing", F.coalesce("facing", F.lit("NA")))


def with_sector(df: DataFrame, min_count: int = rules.LOCALITY_MIN_COUNT) -> DataFrame:
    """Stage 3: locality from the name, rule round 1, frequency filter, round 2."""
    df = df.withColumn("sector", X.apply_replacements(X.extract_locality("property_name"),
                                                     rules.LOCALITY_RULES_ROUND1))
    df = Fl.frequent_keys(df, "sector", min_count)
    return df.withColumn("sector", X.apply_replacements("sector", rules.LOCALITY_RULES_ROUND2)).drop("property_name")


def apply_corrections(df: DataFrame, corrections: DataFrame | None) -> DataFrame:
    """keyed drops (value null) and patches (one row per listing/column)."""
    if corrections is None:
        return df
    return Fl.apply_patches(df, corrections, "listing_id")


def with_features(df: DataFrame, apartments: DataFrame | None = None, furnish_items=None, stage=lambda d: d) -> DataFrame:
    """Stage 4: areas, extra-room flags, age category, furnishing cluster,
    facilities (filled from the apartments table) and the luxury score.
    Scaling, ranking and labelling the clusters read the rows anew: ``stage`` may write them before."""
    t = "areaWithType"
    df = df.withColumns({"super_built_up_area": X.to_sqft(t, X.super_built_up(t)),
                         "built_up_area": X.to_sqft(t, X.built_up(t)),
                         "carpet_area": X.to_sqft(t, X.carpet(t))})
    none = Fl.all_null(["super_built_up_area", "built_up_area", "carpet_area"])
    df = df.withColumn("built_up_area", F.when(none, X.convert_plot_scale("area", X.plot_area(t)))
                       .otherwise(F.col("built_up_area")))
    df = df.withColumns(X.contains_flags("additionalRoom", rules.ADDITIONAL_ROOMS))
    if furnish_items is None:
        vocab = df.select(F.explode(X.furnishing_items("furnishDetails")).alias("i")).distinct()
        furnish_items = E.categories(vocab, "i")
    if furnish_items:
        # the counts stand beside the other columns, so that no row is joined back to its cluster
        names = [f"__f{j}" for j in range(len(furnish_items))]
        df = df.withColumns({n: X.item_count("furnishDetails", i).cast("double") for n, i in zip(names, furnish_items)})
        df = E.kmeans_labels(stage(df.drop("furnishDetails")), names, k=3, out="furnishing_type", fit_df=df).drop(*names)
    if apartments is not None:
        df = J.fill_from(df, apartments, "society", "PropertyName", "features", "TopFacilities")
    df = df.withColumn("luxury_score", R.weighted_label_score(X.parse_list("features")))
    return df.drop("furnishDetails", "features", "additionalRoom")


def treat_outliers(df: DataFrame, stage=lambda d: d) -> DataFrame:
    """Stage 5a: duplicates, rate outliers rescaled, hard thresholds, rate recomputed."""
    df = stage(df.dropDuplicates([c for c in df.columns if c != "listing_id"]))
    df = Q.rescale_outliers(df, "price_per_sqft", "area", "price")
    df = Fl.threshold(df, "price_per_sqft", "<=", 50000)
    df = Fl.threshold(df, "area", "<", 100000)
    df = Fl.threshold(df, "bedRoom", "<=", 10)
    return df.withColumn("price_per_sqft", X.half_even(X.safe_div(F.col("price") * 1e7, F.col("area")), 0))


def impute(df: DataFrame) -> DataFrame:
    """Stage 5b: built-up area from super/carpet, anomaly repair, floor fill,
    three-pass mode imputation of the age category."""
    df = Q.impute_built_up(df)
    df = Q.repair_anomaly(df)
    df = df.drop("area", "areaWithType", "super_built_up_area", "carpet_area", "facing")
    df = Q.impute_constant(df, "floorNum", rules.FLOOR_FILL)
    return Q.mode_impute(df, "agePossession", [("sector", "property_type"), ("sector",), ("property_type",)])


def model_table(df: DataFrame) -> DataFrame:
    """Stage 6: bins and the fixed feature order (+ price)."""
    df = df.withColumns({"luxury_category": B.categorise_luxury("luxury_score"),
                         "floor_category": B.categorise_floor("floorNum"),
                         "furnishing_type": B.recode(F.col("furnishing_type").cast("string"),
                                                     {str(k): v for k, v in rules.FURNISHING_NAMES.items()})})
    cols = ["listing_id", "property_type", "sector", "bedRoom", "bathroom", "balcony", "agePossession",
            "built_up_area", F.col("servant room").cast("double").alias("servant room"),
            F.col("store room").cast("double").alias("store room"), "furnishing_type", "luxury_category",
            "floor_category", "price"]
    return df.select(*cols)


def prepare(flats: DataFrame, houses: DataFrame, apartments: DataFrame | None = None,
            corrections: DataFrame | None = None, furnish_items=None, cut_stages: bool = True) -> DataFrame:
    """The whole chain, raw exports -> model table.

    Every grouped pass (IQR bounds, modes) reads its whole input again, so
    without a cut the plan of each stage contains its upstream several
    times over. ``cut_stages`` writes the stage outputs (where the reference
    writes its CSV files) to the shared checkpoint folder instead.
    """
    stage = cut_lineage if cut_stages else (lambda d: d)
    both = J.union_by_name(clean_source(flats, "flat"), clean_source(houses, "house"))
    both = apply_corrections(with_sector(both), corrections)
    feats = with_features(both, apartments, furnish_items, stage)
    return model_table(impute(stage(treat_outliers(feats, stage))))
