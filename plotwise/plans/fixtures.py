"""Listing-shaped views over the driver tables (mapping in FIXTURES.md §2).

Each derived column is one SQL expression valid in both Spark SQL and
DuckDB, so the Spark side (``selectExpr``) and the oracle side (a CTE)
start from identical inputs and only the operators under test differ.
Text columns imitate the scraped forms (``85 Lac``, ``3 of 10``, ...)
and are built from the numbers of each row; every view keeps all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------
# listing: one row per order (listing_id = o_orderkey)
# ---------------------------------------------------------------------------
LISTING_COLS = [
    ("listing_id", "o_orderkey"),
    ("price", "o_totalprice / CAST(100000 AS DOUBLE)"),
    ("sector", "n_name"),
    ("property_type", "c_mktsegment"),
    ("age_text", "o_orderpriority"),
    ("status", "o_orderstatus"),
    ("cust_id", "o_custkey"),
    ("nation_key", "n_nationkey"),
    ("region_key", "n_regionkey"),
]

LISTING_SQL = ("SELECT {cols} FROM orders JOIN customer ON o_custkey = c_custkey "
               "JOIN nation ON c_nationkey = n_nationkey")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.selectExpr(*[f"{e} AS {a}" for a, e in LISTING_COLS])


# ---------------------------------------------------------------------------
# unit: one row per line item (unit_id unique), with the part's attributes
# ---------------------------------------------------------------------------
UNIT_COLS = [
    ("unit_id", "l_orderkey * 10 + l_linenumber"),
    ("listing_id", "l_orderkey"),
    ("part_id", "l_partkey"),
    ("supp_id", "l_suppkey"),
    ("area", "l_quantity * 100"),
    ("price", "l_extendedprice / CAST(100000 AS DOUBLE)"),
    ("price_per_sqft", "l_extendedprice / l_quantity"),
    ("bedRoom", "p_size"),
    ("society", "p_brand"),
    ("kind", "p_type"),
    ("retail", "p_retailprice"),
    ("returnflag", "l_returnflag"),
    ("linestatus", "l_linestatus"),
    ("discount", "l_discount"),
]

UNIT_SQL = "SELECT {cols} FROM lineitem JOIN part ON l_partkey = p_partkey"


def unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part")
    return li.join(p, li.l_partkey == p.p_partkey).selectExpr(*[f"{e} AS {a}" for a, e in UNIT_COLS])


def _s(text: str) -> str:
    """A string literal for both dialects; quotes are spelled ``chr(39)``."""
    pieces = text.split("'")
    parts = []
    for i, p in enumerate(pieces):
        if p:
            parts.append("'" + p + "'")
        if i < len(pieces) - 1:
            parts.append("chr(39)")
    return parts[0] if len(parts) == 1 else "concat(" + ", ".join(parts) + ")"


def _cat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


# ---------------------------------------------------------------------------
# raw: scraped-text forms of a listing (one row per order)
# ---------------------------------------------------------------------------
_K = "o_orderkey"
_LAKH = "CAST(FLOOR(o_totalprice / 1000) AS BIGINT)"
_RATE = "CAST(FLOOR(o_totalprice / 40) AS BIGINT)"
_SUP = "(CAST(FLOOR(o_totalprice / 300) AS BIGINT) + 300)"
_SECTOR = "lower(replace(n_name, '_', ' '))"

RAW_COLS = [
    ("listing_id", _K),
    ("property_name",
     f"CASE WHEN {_K} % 9 = 0 THEN concat('Plot at ', {_SECTOR}) "
     f"ELSE concat(CASE WHEN {_K} % 2 = 0 THEN 'Flat' ELSE 'Independent House' END, ' in ', {_SECTOR}, ' Gurgaon') END"),
    ("society",
     f"CASE WHEN {_K} % 11 = 0 THEN NULL ELSE concat(lower(c_mktsegment), ' heights ', CAST(o_custkey % 97 AS STRING), "
     f"CASE WHEN {_K} % 3 = 0 THEN concat(' ', CAST({_K} % 5 AS STRING), '.', CAST({_K} % 10 AS STRING), ' ★') "
     f"WHEN {_K} % 3 = 1 THEN ' 4★' ELSE '' END) END"),
    ("price_text",
     f"CASE WHEN {_K} % 10 = 0 THEN 'Price on Request' WHEN {_K} % 10 = 1 THEN NULL "
     f"WHEN {_LAKH} >= 100 THEN concat(CAST(CAST(FLOOR({_LAKH} / 100) AS BIGINT) AS STRING), '.', "
     f"lpad(CAST({_LAKH} % 100 AS STRING), 2, '0'), ' Crore') "
     f"ELSE concat(CAST({_LAKH} AS STRING), ' Lac') END"),
    ("rate_text",
     f"CASE WHEN {_RATE} >= 1000 THEN concat('₹ ', CAST(CAST(FLOOR({_RATE} / 1000) AS BIGINT) AS STRING), ',', "
     f"lpad(CAST({_RATE} % 1000 AS STRING), 3, '0'), '/sq.ft.') "
     f"ELSE concat('₹ ', CAST({_RATE} AS STRING), '/sq.ft.') END"),
    ("bedroom_text", f"concat(CAST({_K} % 5 + 1 AS STRING), ' Bedrooms')"),
    ("bathroom_text", f"concat(CAST({_K} % 4 + 1 AS STRING), ' Bathrooms')"),
    ("balcony_text",
     f"CASE {_K} % 5 WHEN 0 THEN 'No Balcony' WHEN 1 THEN '1 Balcony' WHEN 2 THEN '2 Balconies' "
     f"WHEN 3 THEN '3 Balconies' ELSE '3+ Balconies' END"),
    ("floor_text",
     f"CASE {_K} % 7 WHEN 0 THEN 'Ground of 4' WHEN 1 THEN 'Basement' WHEN 2 THEN 'Lower' WHEN 3 THEN NULL "
     f"ELSE concat(CAST({_K} % 23 AS STRING), ' of 25') END"),
    ("area_text",
     f"CASE {_K} % 6 "
     f"WHEN 0 THEN concat('Super Built up area ', CAST({_SUP} AS STRING), 'Built Up area: ', "
     f"CAST(CAST(FLOOR({_SUP} * 0.9) AS BIGINT) AS STRING), ' sq.ft.Carpet area: ', "
     f"CAST(CAST(FLOOR({_SUP} * 0.8) AS BIGINT) AS STRING), ' sq.ft.') "
     f"WHEN 1 THEN concat('Super Built up area ', CAST({_SUP} AS STRING), '.0 (', CAST({_K} % 300 + 50 AS STRING), ' sq.m.)') "
     f"WHEN 2 THEN concat('Carpet area: ', CAST({_SUP} AS STRING), ' sq.ft.') "
     f"WHEN 3 THEN concat('Plot area ', CAST({_K} % 500 + 40 AS STRING), '(', CAST({_K} % 400 AS STRING), ' sq.m.)') "
     f"WHEN 4 THEN concat('Built Up area: ', CAST({_SUP} AS STRING), ' sq.ft.') "
     f"ELSE concat('Super Built up area ', CAST({_SUP} AS STRING), 'Carpet area: ', "
     f"CAST(CAST(FLOOR({_SUP} * 0.7) AS BIGINT) AS STRING), ' sq.ft.') END"),
    ("additional_room",
     f"CASE {_K} % 6 WHEN 0 THEN 'servant room,study room' WHEN 1 THEN NULL WHEN 2 THEN 'pooja room' "
     f"WHEN 3 THEN 'store room,others' WHEN 4 THEN 'servant room' ELSE 'not available' END"),
    ("age_possession",
     f"CASE {_K} % 9 WHEN 0 THEN '0 to 1 Year Old' WHEN 1 THEN '1 to 5 Year Old' WHEN 2 THEN 'Within 6 months' "
     f"WHEN 3 THEN concat('By ', CAST(2020 + {_K} % 6 AS STRING)) WHEN 4 THEN concat('May ', CAST(2023 + {_K} % 3 AS STRING)) "
     f"WHEN 5 THEN NULL WHEN 6 THEN '10+ Year Old' WHEN 7 THEN '5 to 10 Year Old' ELSE 'soon' END"),
    ("furnish_details",
     f"CASE WHEN {_K} % 8 = 0 THEN NULL ELSE " + _cat(
         _s("['"), f"CAST({_K} % 4 AS STRING)", _s(" Fan', '"),
         f"CASE WHEN {_K} % 3 = 0 THEN 'No AC' ELSE 'AC' END", _s("', '"),
         f"CAST({_K} % 5 + 1 AS STRING)", _s(" Light', '"),
         f"CASE WHEN {_K} % 2 = 0 THEN 'Stove' ELSE 'No Stove' END", _s("']")) + " END"),
    ("features",
     f"CASE WHEN {_K} % 5 = 0 THEN NULL ELSE " + _cat(
         _s("['"), f"CASE WHEN {_K} % 2 = 0 THEN 'Park' ELSE 'Swimming Pool' END", _s("', '"),
         f"CASE WHEN {_K} % 3 = 0 THEN 'Club House' ELSE 'Lift' END", _s("', 'Park']")) + " END"),
    ("distance_text",
     f"CASE {_K} % 4 WHEN 0 THEN concat(CAST({_K} % 30 AS STRING), '.5 Km') "
     f"WHEN 1 THEN concat(CAST({_K} % 900 AS STRING), ' Meter') WHEN 2 THEN 'near' "
     f"ELSE concat(CAST({_K} % 12 AS STRING), ' KM') END"),
    ("coordinates",
     f"concat(CAST(n_nationkey + 20 AS STRING), '.', lpad(CAST(o_custkey % 10000 AS STRING), 4, '0'), '° N, ', "
     f"CAST(n_regionkey + 70 AS STRING), '.', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'), '° E')"),
    ("price_details",
     f"CASE WHEN {_K} % 13 = 0 THEN 'not a dict' ELSE " + _cat(
         _s("{'"), f"CAST({_K} % 4 + 1 AS STRING)", _s(" BHK': {'building_type': 'Apartment', 'area': '"),
         f"CAST({_SUP} AS STRING)", "' - '", f"CAST({_SUP} + 500 AS STRING)",
         _s(" sq.ft.', 'price-range': '₹ "), f"CAST({_K} % 90 + 10 AS STRING)", "' L - '",
         f"CAST({_K} % 5 + 1 AS STRING)", _s(".5 Cr'}, 'Land': {'building_type': '', 'area': '"),
         f"CAST({_K} % 700 + 100 AS STRING)", _s(" sq.ft.', 'price-range': '₹ 1 Cr'}}")) + " END"),
    ("sector_name", _SECTOR),
    ("property_type", "c_mktsegment"),
]

RAW_SQL = ("SELECT {cols} FROM orders JOIN customer ON o_custkey = c_custkey "
           "JOIN nation ON c_nationkey = n_nationkey")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.selectExpr(*[f"{e} AS {a}" for a, e in RAW_COLS])


def cte(name: str, sql: str, cols) -> str:
    return f"{name} AS ({sql.format(cols=', '.join(f'{e} AS {a}' for a, e in cols))})"


def with_views(body: str, *names: str) -> str:
    """Oracle SQL with the requested views as CTEs."""
    defs = {"listing": (LISTING_SQL, LISTING_COLS), "unit": (UNIT_SQL, UNIT_COLS), "raw": (RAW_SQL, RAW_COLS),
            "model": (MODEL_SQL, MODEL_COLS)}
    ctes = [cte(n, *defs[n]) for n in names]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


# ---------------------------------------------------------------------------
# model: the 12-feature model table (one row per line item) + price (crore)
# ---------------------------------------------------------------------------
MODEL_COLS = [
    ("listing_id", "l_orderkey * 10 + l_linenumber"),
    ("property_type", "c_mktsegment"),
    ("sector", "n_name"),
    ("bedRoom", "CAST(p_size % 6 + 1 AS DOUBLE)"),
    ("bathroom", "CAST(l_linenumber AS DOUBLE)"),
    ("balcony", "CASE l_linenumber % 5 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' ELSE '3+' END"),
    ("agePossession", "o_orderpriority"),
    ("built_up_area", "l_quantity * 100"),
    ("servant_room", "CAST(p_partkey % 2 AS DOUBLE)"),
    ("store_room", "CAST(l_suppkey % 2 AS DOUBLE)"),
    ("furnishing_type", "CASE p_partkey % 3 WHEN 0 THEN 'unfurnished' WHEN 1 THEN 'semifurnished' ELSE 'furnished' END"),
    ("luxury_category", "CASE WHEN p_size < 17 THEN 'Low' WHEN p_size < 34 THEN 'Medium' ELSE 'High' END"),
    ("floor_category", "CASE WHEN l_linenumber <= 2 THEN 'Low Floor' WHEN l_linenumber <= 5 THEN 'Mid Floor' ELSE 'High Floor' END"),
    ("price", "l_extendedprice / CAST(100000 AS DOUBLE)"),
]

MODEL_SQL = ("SELECT {cols} FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey "
             "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")

MODEL_NUM = ["bedRoom", "bathroom", "built_up_area", "servant_room", "store_room"]
MODEL_CAT = ["property_type", "sector", "balcony", "agePossession", "furnishing_type", "luxury_category",
             "floor_category"]


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part")
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    j = (li.join(p, li.l_partkey == p.p_partkey).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")))
    return j.selectExpr(*[f"{e} AS {a}" for a, e in MODEL_COLS])
