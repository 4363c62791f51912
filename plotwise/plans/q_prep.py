"""Registered queries for columns, filters, nulls, parsing, recoding and
joins (survey 2.2-2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotwise.functions import recode as B
from plotwise.functions import rules
from plotwise.functions import text as T
from plotwise.operators import aggregates as A
from plotwise.operators import columns as P
from plotwise.operators import filters as Fl
from plotwise.operators import joins as J
from plotwise.operators import nulls as D
from plotwise.plans import fixtures as fx
from plotwise.plans.registry import query

WS = r"'^\s+|\s+$', '', 'g'"


def _strip(e: str) -> str:
    return f"regexp_replace({e}, {WS})"


# --- 2.2 projections ---------------------------------------------------------
@query("p1_drop_columns", fx.with_views(
    "SELECT listing_id, price, sector, property_type, age_text, nation_key, region_key FROM listing", "listing"))
def p1(spark, d):
    return P.drop_columns(fx.listing(spark, d), ["status", "cust_id"])


@query("p2_rename_columns", fx.with_views(
    "SELECT listing_id, price_per_sqft AS rate, area AS sqft FROM unit", "unit"))
def p2(spark, d):
    return P.rename_columns(fx.unit(spark, d).select("listing_id", "price_per_sqft", "area"),
                            {"price_per_sqft": "rate", "area": "sqft"})


@query("p3_insert_column", fx.with_views(
    "SELECT listing_id, 'flat' AS kind_label, price FROM listing", "listing"))
def p3(spark, d):
    return P.insert_column(fx.listing(spark, d).select("listing_id", "price"), 1, "kind_label", "flat")


@query("p4_derive_area", fx.with_views("""
SELECT unit_id, round_even(price * CAST(10000000 AS DOUBLE) / nullif(price_per_sqft, 0), 0) AS area_est,
       round_even(price * CAST(10000000 AS DOUBLE) / nullif(area, 0), 0) AS rate_est FROM unit""", "unit"))
def p4(spark, d):
    u = fx.unit(spark, d)
    u = P.with_area(u, "price", "price_per_sqft", "area_est")
    u = P.with_rate(u, "price", "area", "rate_est")
    return u.select("unit_id", "area_est", "rate_est")


@query("p5_log_target", fx.with_views("""
SELECT listing_id, round(ln(1 + price), 6) AS log_price, round(exp(ln(1 + price)) - 1, 9) AS price_back
FROM listing""", "listing"))
def p5(spark, d):
    l = P.log_target(fx.listing(spark, d), "price", "log_price")
    l = P.unlog_target(l, "log_price", "price_back")
    return l.select("listing_id", F.round("log_price", 6).alias("log_price"),
                    F.round("price_back", 9).alias("price_back"))


@query("p6_sample_rows", fx.with_views("""
SELECT * FROM listing ORDER BY md5(concat(CAST(listing_id AS VARCHAR), ':42')), listing_id LIMIT 1000""", "listing"))
def p6(spark, d):
    return P.sample_rows(fx.listing(spark, d), 1000, "listing_id", seed=42)


# --- 2.3 filters -------------------------------------------------------------
@query("f1_drop_sentinel", fx.with_views(
    "SELECT listing_id, price_text FROM raw WHERE price_text IS DISTINCT FROM 'Price on Request'", "raw"))
def f1(spark, d):
    return Fl.drop_sentinel(fx.raw(spark, d).select("listing_id", "price_text"), "price_text", "Price on Request")


@query("f2_not_null", fx.with_views(
    "SELECT listing_id, price_text FROM raw WHERE price_text IS NOT NULL", "raw"))
def f2(spark, d):
    return Fl.not_null(fx.raw(spark, d).select("listing_id", "price_text"), "price_text")


@query("f3_thresholds", fx.with_views("""
SELECT unit_id FROM unit WHERE price_per_sqft <= 1800 AND area < 4500 AND bedRoom <= 10""", "unit"))
def f3(spark, d):
    u = fx.unit(spark, d)
    u = Fl.threshold(u, "price_per_sqft", "<=", 1800)
    u = Fl.threshold(u, "area", "<", 4500)
    return Fl.threshold(u, "bedRoom", "<=", 10).select("unit_id")


@query("f4_match_and_range", fx.with_views("""
SELECT unit_id, area FROM unit WHERE society = 'Brand#7' AND kind = 'STANDARD' AND bedRoom BETWEEN 4 AND 6""", "unit"))
def f4(spark, d):
    return Fl.match_and_range(fx.unit(spark, d), {"society": "Brand#7", "kind": "STANDARD"}, "bedRoom", 4, 6).select(
        "unit_id", "area")


_AREAS = """
, pa AS (SELECT listing_id,
  TRY_CAST(nullif(regexp_extract(area_text, 'Super Built up area (\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS super_built_up_area,
  TRY_CAST(nullif(regexp_extract(area_text, 'Built Up area\\s*:\\s*(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS built_up_area,
  TRY_CAST(nullif(regexp_extract(area_text, 'Carpet area\\s*:\\s*(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS carpet_area,
  area_text FROM raw)"""


def _areas(spark, d):
    r = fx.raw(spark, d)
    return r.select("listing_id", T.super_built_up("area_text").alias("super_built_up_area"),
                    T.built_up("area_text").alias("built_up_area"), T.carpet("area_text").alias("carpet_area"),
                    "area_text")


_A3 = ["super_built_up_area", "built_up_area", "carpet_area"]


@query("f5_null_masks", fx.with_views(_AREAS + """
SELECT count(*) FILTER (WHERE super_built_up_area IS NULL AND built_up_area IS NULL AND carpet_area IS NULL) AS all_null,
       count(*) FILTER (WHERE super_built_up_area IS NULL OR built_up_area IS NULL OR carpet_area IS NULL) AS any_null
FROM pa""", "raw"))
def f5(spark, d):
    a = _areas(spark, d)
    return a.agg(F.count_if(Fl.all_null(_A3)).alias("all_null"), F.count_if(Fl.any_null(_A3)).alias("any_null"))


@query("f6_contains", fx.with_views("SELECT listing_id FROM raw WHERE contains(area_text, 'Plot')", "raw"))
def f6(spark, d):
    return Fl.contains(fx.raw(spark, d), "area_text", "Plot").select("listing_id")


@query("f7_frequent_keys", fx.with_views("""
SELECT listing_id, cust_id FROM listing WHERE cust_id IN (
  SELECT cust_id FROM listing GROUP BY cust_id HAVING count(*) >= 12)""", "listing"))
def f7(spark, d):
    return Fl.frequent_keys(fx.listing(spark, d).select("listing_id", "cust_id"), "cust_id", 12)


@query("f8_exclude_then_rank", fx.with_views("""
SELECT property_type, count(*) AS count FROM listing WHERE property_type <> 'BUILDING'
GROUP BY property_type ORDER BY count DESC, property_type LIMIT 3""", "listing"))
def f8(spark, d):
    return A.value_counts(Fl.exclude_value(fx.listing(spark, d), "property_type", "BUILDING"), "property_type").limit(3)


@query("f9_keyed_corrections", fx.with_views("""
, drops AS (SELECT o_orderkey AS listing_id FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000),
patches AS (SELECT o_orderkey AS listing_id, o_totalprice / CAST(50000 AS DOUBLE) AS value FROM orders
            WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
SELECT l.listing_id, coalesce(p.value, l.price) AS price FROM listing l LEFT JOIN patches p ON l.listing_id = p.listing_id
WHERE l.listing_id NOT IN (SELECT listing_id FROM drops)""", "listing"))
def f9(spark, d):
    o = fx.table(spark, d, "orders")
    drops = o.filter((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000)).select(
        F.col("o_orderkey").alias("listing_id"))
    patches = o.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")).select(
        F.col("o_orderkey").alias("listing_id"), (F.col("o_totalprice") / 50000.0).alias("value"))
    l = Fl.drop_keys(fx.listing(spark, d).select("listing_id", "price"), drops, "listing_id")
    return Fl.patch_values(l, patches, "listing_id", "price")


# --- 2.4 duplicates and nulls -----------------------------------------------
@query("d1_duplicate_count", fx.with_views("""
SELECT CAST((SELECT count(*) FROM unit) - (SELECT count(*) FROM (SELECT DISTINCT society, bedRoom, kind FROM unit))
       AS BIGINT) AS n_duplicates""", "unit"))
def d1(spark, d):
    return D.duplicate_count(fx.unit(spark, d).select("society", "bedRoom", "kind"))


@query("d2_drop_duplicates", fx.with_views("SELECT DISTINCT society, bedRoom, kind FROM unit", "unit"))
def d2(spark, d):
    return D.drop_duplicates(fx.unit(spark, d).select("society", "bedRoom", "kind"))


@query("d3_null_counts", fx.with_views("""
SELECT count(*) FILTER (WHERE society IS NULL) AS society, count(*) FILTER (WHERE price_text IS NULL) AS price_text,
       count(*) FILTER (WHERE floor_text IS NULL) AS floor_text,
       count(*) FILTER (WHERE additional_room IS NULL) AS additional_room,
       count(*) FILTER (WHERE furnish_details IS NULL) AS furnish_details,
       count(*) FILTER (WHERE society IS NULL) + count(*) FILTER (WHERE price_text IS NULL)
       + count(*) FILTER (WHERE floor_text IS NULL) + count(*) FILTER (WHERE additional_room IS NULL)
       + count(*) FILTER (WHERE furnish_details IS NULL) AS total FROM raw""", "raw"))
def d3(spark, d):
    return D.null_counts(fx.raw(spark, d), ["society", "price_text", "floor_text", "additional_room", "furnish_details"])


@query("d4_fill_constant", fx.with_views("""
SELECT listing_id, coalesce(additional_room, 'not available') AS additional_room,
       coalesce(society, 'NA') AS society FROM raw""", "raw"))
def d4(spark, d):
    r = fx.raw(spark, d).select("listing_id", "additional_room", "society")
    return D.fill_constant(r, {"additional_room": "not available", "society": "NA"})


@query("d5_update_from", fx.with_views("""
, patch AS (SELECT listing_id, CASE WHEN listing_id % 3 = 0 THEN NULL ELSE price * 2 END AS price FROM listing
            WHERE status = 'O')
SELECT l.listing_id, coalesce(p.price, l.price) AS price FROM listing l LEFT JOIN patch p ON l.listing_id = p.listing_id""",
    "listing"))
def d5(spark, d):
    l = fx.listing(spark, d).select("listing_id", "price", "status")
    patch = l.filter(F.col("status") == "O").select(
        "listing_id", F.when(F.col("listing_id") % 3 == 0, None).otherwise(F.col("price") * 2).alias("price"))
    return D.update_from(l.drop("status"), patch, "listing_id", ["price"])


# --- 2.5 parsing ---------------------------------------------------------------
@query("t1_clean_society", fx.with_views(
    "SELECT listing_id, lower(" + _strip(r"regexp_replace(society, '\d+(\.\d+)?\s?★', '', 'g')") + ") AS society FROM raw",
    "raw"))
def t1(spark, d):
    return fx.raw(spark, d).select("listing_id", T.clean_society("society").alias("society"))


_PRICE = ("round_even(CASE WHEN split_part(price_text, ' ', 2) = 'Lac' "
          "THEN TRY_CAST(split_part(price_text, ' ', 1) AS DOUBLE) / 100 "
          "ELSE TRY_CAST(split_part(price_text, ' ', 1) AS DOUBLE) END, 2)")


@query("t2_parse_price", fx.with_views(f"SELECT listing_id, {_PRICE} AS price FROM raw", "raw"))
def t2(spark, d):
    return fx.raw(spark, d).select("listing_id", T.parse_price("price_text").alias("price"))


@query("t3_parse_rate", fx.with_views(
    "SELECT listing_id, TRY_CAST(" + _strip("translate(split_part(rate_text, '/', 1), '₹,', '')")
    + " AS DOUBLE) AS price_per_sqft FROM raw", "raw"))
def t3(spark, d):
    return fx.raw(spark, d).select("listing_id", T.parse_rate("rate_text").alias("price_per_sqft"))


@query("t4_t5_rooms", fx.with_views("""
SELECT listing_id, TRY_CAST(split_part(bedroom_text, ' ', 1) AS INTEGER) AS bedRoom,
       TRY_CAST(split_part(bathroom_text, ' ', 1) AS INTEGER) AS bathroom,
       replace(split_part(balcony_text, ' ', 1), 'No', '0') AS balcony FROM raw""", "raw"))
def t4(spark, d):
    return fx.raw(spark, d).select("listing_id", T.leading_int("bedroom_text").alias("bedRoom"),
                                   T.leading_int("bathroom_text").alias("bathroom"),
                                   T.balcony("balcony_text").alias("balcony"))


_FLOOR_TOK = ("replace(replace(CASE WHEN split_part(floor_text, ' ', 1) = 'Ground' THEN '0' "
              "ELSE split_part(floor_text, ' ', 1) END, 'Basement', '-1'), 'Lower', '0')")


@query("t6_floor_number", fx.with_views(f"""
SELECT listing_id, TRY_CAST(nullif(regexp_extract({_FLOOR_TOK}, '(\\d+)', 1), '') AS DOUBLE) AS floor_num,
       TRY_CAST(nullif(regexp_extract({_FLOOR_TOK}, '(-?\\d+)', 1), '') AS DOUBLE) AS floor_signed,
       TRY_CAST(split_part(floor_text, ' ', 1) AS DOUBLE) AS floors_house FROM raw""", "raw"))
def t6(spark, d):
    return fx.raw(spark, d).select("listing_id", T.floor_number("floor_text").alias("floor_num"),
                                   T.floor_number("floor_text", signed=True).alias("floor_signed"),
                                   T.floor_number("floor_text", kind="house").alias("floors_house"))


@query("t7_extract_locality", fx.with_views(
    "SELECT listing_id, lower(" + _strip("replace(string_split(property_name, 'in')[2], 'Gurgaon', '')")
    + ") AS sector FROM raw", "raw"))
def t7(spark, d):
    return fx.raw(spark, d).select("listing_id", T.extract_locality("property_name").alias("sector"))


# FIXED VALUES (test input): locality names fed to the canonicalisation rules.
LOCALITY_SAMPLES = ["ashok vihar phase 2", "ashok vihar phase 3 extension", "sohna road", "sohna", "dlf phase 1",
                    "sector 95a", "sector 110 a", "mehrauli  road", "a block sector 43", "sector 1a manesar",
                    "sushant lok phase 1", "palam vihar", "new colony", "sector 36 sohna road", "imt manesar",
                    "south city 1", "malibu town", "sector 89 a", "shivaji nagar", "valley view estate"]


def _locality_expr() -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(LOCALITY_SAMPLES))
    return f"CASE cust_id % {len(LOCALITY_SAMPLES)} {cases} END"


def _rules_sql(col: str, rule_list) -> str:
    e = col
    for a, b in rule_list:
        e = f"replace({e}, '{a}', '{b}')"
    return e


@query("t8_canonical_locality", fx.with_views(f"""
, r1 AS (SELECT listing_id, {_rules_sql(_locality_expr(), rules.LOCALITY_RULES_ROUND1)} AS loc FROM listing),
kept AS (SELECT * FROM r1 WHERE loc IN (SELECT loc FROM r1 GROUP BY loc HAVING count(*) >= 3))
SELECT listing_id, {_rules_sql('loc', rules.LOCALITY_RULES_ROUND2)} AS sector FROM kept""", "listing"))
def t8(spark, d):
    l = fx.listing(spark, d).selectExpr("listing_id", f"{_locality_expr()} AS loc")
    l = l.withColumn("loc", T.apply_replacements("loc", rules.LOCALITY_RULES_ROUND1))
    l = Fl.frequent_keys(l, "loc", rules.LOCALITY_MIN_COUNT)
    return l.select("listing_id", T.apply_replacements("loc", rules.LOCALITY_RULES_ROUND2).alias("sector"))


def _every_rule_expr() -> str:
    """A text with each rule's left side in turn, and names that only one listing has."""
    samples = [a for a, _ in rules.LOCALITY_RULES_ROUND1 + rules.LOCALITY_RULES_ROUND2]
    cases = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(samples))
    rare = "concat('lane ', CAST(listing_id AS STRING))"
    return f"CASE WHEN listing_id % 101 = 0 THEN {rare} ELSE CASE listing_id % {len(samples)} {cases} END END"


@query("t8_every_rule", fx.with_views(f"""
, r1 AS (SELECT listing_id, {_rules_sql(_every_rule_expr(), rules.LOCALITY_RULES_ROUND1)} AS loc FROM listing),
kept AS (SELECT * FROM r1 WHERE loc IN (SELECT loc FROM r1 GROUP BY loc HAVING count(*) >= 3))
SELECT listing_id, {_rules_sql('loc', rules.LOCALITY_RULES_ROUND2)} AS sector FROM kept""", "listing"))
def t8_every(spark, d):
    """All rules of both rounds are reached, and the filter drops the rare names."""
    l = fx.listing(spark, d).selectExpr("listing_id", f"{_every_rule_expr()} AS loc")
    l = l.withColumn("loc", T.apply_replacements("loc", rules.LOCALITY_RULES_ROUND1))
    l = Fl.frequent_keys(l, "loc", rules.LOCALITY_MIN_COUNT)
    return l.select("listing_id", T.apply_replacements("loc", rules.LOCALITY_RULES_ROUND2).alias("sector"))


@query("s1_rejected_rows", fx.with_views("""
SELECT CAST(count(*) FILTER (WHERE listing_id % 50 > 2) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE listing_id % 50 <= 2) AS BIGINT) AS n_rejected,
  CAST(sum(CASE WHEN listing_id % 50 > 2 THEN listing_id ELSE 0 END) AS BIGINT) AS id_sum,
  CAST(sum(CASE WHEN listing_id % 50 <= 2 THEN length(CAST(listing_id AS VARCHAR)) ELSE 0 END) AS BIGINT) AS rejected_digits,
  CAST(count(*) FILTER (WHERE listing_id % 50 > 2 AND listing_id % 7 = 0) AS BIGINT) AS n_null_names FROM listing""", "listing"))
def s1_rejected(spark, d):
    """Lines with a field too few, one too many, or a text for a number are kept apart from the rows."""
    from pyspark.sql import types as TT
    from plotwise.session import shared_path
    from plotwise.sources import io
    k = F.col("listing_id")
    name = F.when(k % 7 == 0, F.lit("nan")).otherwise(F.lit('"a, ""quoted"" name"'))
    line = F.when(k % 50 == 0, F.concat(k.cast("string"), F.lit(","), name)).when(
        k % 50 == 1, F.concat_ws(",", k.cast("string"), name, F.lit("1.5,6"))).when(
        k % 50 == 2, F.concat_ws(",", k.cast("string"), name, F.lit("many"))).otherwise(
        F.concat_ws(",", k.cast("string"), name, F.lit("1.5")))
    path = shared_path(spark, "csv")
    fx.listing(spark, d).select(line.alias("value")).write.text(path)
    schema = TT.StructType([TT.StructField("listing_id", TT.LongType()), TT.StructField("name", TT.StringType()),
                            TT.StructField("price", TT.DoubleType())])
    rows, rejected = io.read_csv_checked(spark, path, schema, header=False)
    good = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("listing_id").alias("id_sum"),
                    F.count_if(F.col("name").isNull()).alias("n_null_names"))
    digits = F.length(F.regexp_extract("line", r"^(\d+),", 1))
    bad = rejected.agg(F.count(F.lit(1)).alias("n_rejected"), F.sum(digits).alias("rejected_digits"))
    return good.select("n_rows", bad.select("n_rejected").scalar().alias("n_rejected"), "id_sum",
                       bad.select("rejected_digits").scalar().alias("rejected_digits"), "n_null_names")


@query("t9_areas_from_text", fx.with_views(_AREAS + """
SELECT listing_id, super_built_up_area, built_up_area, carpet_area FROM pa""", "raw"))
def t9(spark, d):
    return _areas(spark, d).drop("area_text")


def _sqft_sql(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL THEN NULL WHEN nullif(regexp_extract(area_text, CAST({v} AS VARCHAR) || "
            f"' \\((\\d+\\.?\\d*) sq.m.\\)', 1), '') IS NOT NULL THEN TRY_CAST(regexp_extract(area_text, "
            f"CAST({v} AS VARCHAR) || ' \\((\\d+\\.?\\d*) sq.m.\\)', 1) AS DOUBLE) * CAST(10.7639 AS DOUBLE) ELSE {v} END")


@query("t10_to_sqft", fx.with_views(_AREAS + f"""
SELECT listing_id, round({_sqft_sql('super_built_up_area')}, 6) AS super_sqft,
       round({_sqft_sql('built_up_area')}, 6) AS built_sqft FROM pa""", "raw"))
def t10(spark, d):
    a = _areas(spark, d)
    return a.select("listing_id", F.round(T.to_sqft("area_text", "super_built_up_area"), 6).alias("super_sqft"),
                    F.round(T.to_sqft("area_text", "built_up_area"), 6).alias("built_sqft"))


@query("t11_plot_area", fx.with_views(_AREAS + """
, pl AS (SELECT listing_id, CAST(listing_id % 5000 AS DOUBLE) AS area,
  TRY_CAST(nullif(regexp_extract(area_text, 'Plot area (\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS plot FROM pa
  WHERE super_built_up_area IS NULL AND built_up_area IS NULL AND carpet_area IS NULL)
SELECT listing_id, round(CASE WHEN round_even(area / nullif(plot, 0), 0) = 9 THEN plot * 9
  WHEN round_even(area / nullif(plot, 0), 0) = 11 THEN plot * CAST(10.7 AS DOUBLE) ELSE plot END, 6) AS built_up_area
FROM pl""", "raw"))
def t11(spark, d):
    a = _areas(spark, d).filter(Fl.all_null(_A3))
    a = a.select("listing_id", (F.col("listing_id") % 5000).cast("double").alias("area"),
                 T.plot_area("area_text").alias("plot"))
    return a.select("listing_id", F.round(T.convert_plot_scale("area", "plot"), 6).alias("built_up_area"))


def _flag_name(label: str) -> str:
    return label.replace(" ", "_")


@query("t12_contains_flags", fx.with_views(
    "SELECT listing_id, " + ", ".join(
        f"coalesce(CAST(contains(additional_room, '{lab}') AS INTEGER), 0) AS {_flag_name(lab)}"
        for lab in rules.ADDITIONAL_ROOMS) + " FROM raw", "raw"))
def t12(spark, d):
    flags = T.contains_flags("additional_room", rules.ADDITIONAL_ROOMS)
    return fx.raw(spark, d).select("listing_id", *[v.alias(_flag_name(k)) for k, v in flags.items()])


def _age_sql(col: str) -> str:
    from plotwise.plans.q_stats import _age_sql as age
    return age(col)


@query("t13_categorise_age", fx.with_views(
    f"SELECT listing_id, {_age_sql('age_possession')} AS agePossession FROM raw", "raw"))
def t13(spark, d):
    return fx.raw(spark, d).select("listing_id", T.categorise_age("age_possession").alias("agePossession"))


@query("t14_furnishing_vocabulary", fx.with_views(r"""
SELECT DISTINCT item FROM (
  SELECT regexp_replace(regexp_replace(unnest(string_split(translate(furnish_details, '[]' || chr(39), ''), ', ')),
         'No |\d+', '', 'g'), '^\s+|\s+$', '', 'g') AS item FROM raw WHERE furnish_details IS NOT NULL)
WHERE item <> ''""", "raw"))
def t14a(spark, d):
    r = fx.raw(spark, d)
    return r.select(F.explode(T.furnishing_items("furnish_details")).alias("item")).distinct()


FURNISH_ITEMS = ["Fan", "AC", "Light", "Stove"]


def _item_sql(item: str) -> str:
    n = f"TRY_CAST(nullif(regexp_extract(furnish_details, '(\\d+) {item}', 1), '') AS INTEGER)"
    return (f"CASE WHEN furnish_details IS NULL THEN 0 WHEN contains(furnish_details, 'No {item}') THEN 0 "
            f"WHEN {n} IS NOT NULL THEN {n} WHEN contains(furnish_details, '{item}') THEN 1 ELSE 0 END")


@query("t14_item_counts", fx.with_views(
    "SELECT listing_id, " + ", ".join(f"{_item_sql(i)} AS {i}" for i in FURNISH_ITEMS) + " FROM raw", "raw"))
def t14b(spark, d):
    return fx.raw(spark, d).select("listing_id", *[T.item_count("furnish_details", i).alias(i) for i in FURNISH_ITEMS])


@query("t15_parse_list", fx.with_views("""
SELECT listing_id, CAST(pos AS INTEGER) AS pos, item FROM (
  SELECT listing_id, unnest(l) AS item, unnest(generate_series(0, len(l) - 1)) AS pos FROM (
    SELECT listing_id, regexp_extract_all(features, chr(39) || '(.*?)' || chr(39), 1) AS l FROM raw
    WHERE features IS NOT NULL))""", "raw"))
def t15(spark, d):
    r = fx.raw(spark, d).select("listing_id", T.parse_list("features").alias("l"))
    return r.select("listing_id", F.posexplode("l").alias("pos", "item"))


_PD_TYPE = "'\"MAP(VARCHAR, STRUCT(building_type VARCHAR, area VARCHAR, \\\"price-range\\\" VARCHAR))\"'"


def _area_num_sql(e: str) -> str:
    return "TRY_CAST(" + _strip(f"replace(replace({e}, ',', ''), ' sq.ft.', '')") + " AS DOUBLE)"


def _price_num_sql(e: str) -> str:
    v = "TRY_CAST(" + _strip(f"replace(replace(replace({e}, '₹', ''), ' Cr', ''), ' L', '')") + " AS DOUBLE)"
    return f"CASE WHEN contains({e}, 'L') THEN {v} / 100 ELSE {v} END"


_PD_LONG = f"""
, pdm AS (SELECT listing_id, CASE WHEN json_valid(replace(price_details, chr(39), '"'))
    THEN json_transform(replace(price_details, chr(39), '"'), {_PD_TYPE}) END AS m FROM raw),
pdk AS (SELECT listing_id, k AS config, m[k] AS v FROM (SELECT listing_id, m, unnest(map_keys(m)) AS k FROM pdm)),
pdp AS (SELECT listing_id, config, v.building_type AS building_type,
  string_split(coalesce(v.area, ''), '-') AS ap, string_split(coalesce(v."price-range", ''), '-') AS pp FROM pdk),
pdv AS (SELECT listing_id, config, building_type, len(ap) AS na, {_area_num_sql('ap[1]')} AS a0,
  {_area_num_sql('ap[2]')} AS a1, len(pp) AS np, {_price_num_sql('pp[1]')} AS p0, {_price_num_sql('pp[2]')} AS p1 FROM pdp),
pd AS (SELECT listing_id, config, building_type,
  CASE WHEN na = 1 THEN a0 WHEN na = 2 AND a0 IS NOT NULL AND a1 IS NOT NULL THEN a0 END AS area_low,
  CASE WHEN na = 1 THEN a0 WHEN na = 2 AND a0 IS NOT NULL AND a1 IS NOT NULL THEN a1 END AS area_high,
  CASE WHEN np = 2 AND p0 IS NOT NULL AND p1 IS NOT NULL THEN p0 END AS price_low,
  CASE WHEN np = 2 AND p0 IS NOT NULL AND p1 IS NOT NULL THEN p1 END AS price_high FROM pdv)"""


def price_details_long(spark, d):
    r = fx.raw(spark, d).select("listing_id", F.explode(T.price_details_map("price_details")).alias("config", "v"))
    return T.config_facts_df(r, "v", ["listing_id", "config"])


@query("t16_price_details", fx.with_views(_PD_LONG + """
SELECT listing_id, config, building_type, area_low, area_high, round(price_low, 6) AS price_low,
       round(price_high, 6) AS price_high FROM pd""", "raw"))
def t16(spark, d):
    out = price_details_long(spark, d)
    return out.withColumns({"price_low": F.round("price_low", 6), "price_high": F.round("price_high", 6)})


def _cfg(c: str) -> str:
    return "c_" + c.replace(" ", "_")


def fixed_config_columns(spark, d):
    """The facts of the named configurations as fixed wide columns
    (a staged projection of the parsed map, no pivot shuffle)."""
    r = fx.raw(spark, d).select("listing_id", T.price_details_map("price_details").alias("m"))
    structs = {f"{_cfg(cfg)}_": F.try_element_at(F.col("m"), F.lit(cfg)) for cfg in rules.CONFIGS}
    wide = T.config_facts_wide(r, structs, ["listing_id"])
    land = f"{_cfg('Land')}_building_type"
    wide = wide.withColumn(land, F.when(F.col(land) == "", F.lit("Land")).otherwise(F.col(land)))
    rounded = {f"{p}price_{s}": F.round(f"{p}price_{s}", 6) for p in structs for s in ("low", "high")}
    return wide.withColumns(rounded)


def _t17_sql():
    cols = []
    for cfg in rules.CONFIGS:
        c = _cfg(cfg)
        bt = f"max(building_type) FILTER (WHERE config = '{cfg}')"
        if cfg == "Land":
            bt = f"CASE WHEN {bt} = '' THEN 'Land' ELSE {bt} END"
        cols += [f"{bt} AS {c}_building_type",
                 f"max(area_low) FILTER (WHERE config = '{cfg}') AS {c}_area_low",
                 f"max(area_high) FILTER (WHERE config = '{cfg}') AS {c}_area_high",
                 f"round(max(price_low) FILTER (WHERE config = '{cfg}'), 6) AS {c}_price_low",
                 f"round(max(price_high) FILTER (WHERE config = '{cfg}'), 6) AS {c}_price_high"]
    return (_PD_LONG + "\nSELECT r.listing_id, " + ", ".join(cols) +
            " FROM raw r LEFT JOIN pd ON r.listing_id = pd.listing_id GROUP BY r.listing_id")


@query("t17_fixed_config_columns", fx.with_views(_t17_sql(), "raw"))
def t17(spark, d):
    return fixed_config_columns(spark, d)


@query("t18_distance_to_meters", fx.with_views(r"""
SELECT listing_id, CASE WHEN contains(distance_text, 'Km') OR contains(distance_text, 'KM')
    THEN TRY_CAST(string_split(regexp_replace(distance_text, '^\s+|\s+$', '', 'g'), ' ')[1] AS DOUBLE) * 1000
  WHEN contains(distance_text, 'Meter') OR contains(distance_text, 'meter')
    THEN TRY_CAST(string_split(regexp_replace(distance_text, '^\s+|\s+$', '', 'g'), ' ')[1] AS DOUBLE) END AS meters
FROM raw""", "raw"))
def t18(spark, d):
    return fx.raw(spark, d).select("listing_id", T.distance_to_meters("distance_text").alias("meters"))


@query("t19_parse_coordinates", fx.with_views(r"""
SELECT listing_id, TRY_CAST(nullif(regexp_extract(split_part(coordinates, ',', 1), '(\d+\.?\d*)', 1), '') AS DOUBLE) AS lat,
       TRY_CAST(nullif(regexp_extract(split_part(coordinates, ',', 2), '(\d+\.?\d*)', 1), '') AS DOUBLE) AS lon FROM raw""",
    "raw"))
def t19(spark, d):
    lat, lon = T.parse_coordinates("coordinates")
    return fx.raw(spark, d).select("listing_id", lat.alias("lat"), lon.alias("lon"))


@query("t20_locality_number", fx.with_views(r"""
SELECT DISTINCT sector, coalesce(TRY_CAST(nullif(regexp_extract(sector, '(\d+)', 1), '') AS DOUBLE),
       CAST('inf' AS DOUBLE)) AS sort_key FROM (SELECT sector FROM listing UNION ALL SELECT 'gwal pahari')""", "listing"))
def t20(spark, d):
    s = fx.listing(spark, d).select("sector").unionByName(spark.range(1).select(F.lit("gwal pahari").alias("sector")))
    return s.select("sector", T.locality_number("sector").alias("sort_key")).distinct()


@query("t21_join_list", fx.with_views("""
SELECT listing_id, array_to_string(regexp_extract_all(features, chr(39) || '(.*?)' || chr(39), 1), ' ') AS features_text
FROM raw WHERE features IS NOT NULL""", "raw"))
def t21(spark, d):
    r = Fl.not_null(fx.raw(spark, d), "features")
    return r.select("listing_id", T.join_list(T.parse_list("features")).alias("features_text"))


def _stop_sql(stops) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in stops) + "]"


def _term_frequency_sql():
    from plotwise.operators.similarity import default_stop_words
    stops = _stop_sql(default_stop_words())
    return ("SELECT term, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(text), "
            "'[\\p{L}\\p{N}_]{2,}')) AS term FROM documents) WHERE NOT list_contains(" + stops + ", term) "
            "GROUP BY term")


def term_frequency(spark, d):
    """Counts of the words of every document, stop words removed."""
    from plotwise.operators.similarity import terms
    docs = fx.table(spark, d, "documents")
    return terms(docs, "doc_id", "text", ngram_max=1).groupBy("term").agg(F.count(F.lit(1)).alias("count"))


# --- 2.6 recoding --------------------------------------------------------------
@query("b1_b2_recode", fx.with_views("""
SELECT listing_id, CASE CAST(listing_id % 4 AS INTEGER) WHEN 0 THEN 'unfurnished' WHEN 1 THEN 'semifurnished'
         WHEN 2 THEN 'furnished' ELSE CAST(CAST(listing_id % 4 AS INTEGER) AS VARCHAR) END AS furnishing_type,
       CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS status_code FROM listing""", "listing"))
def b1(spark, d):
    l = fx.listing(spark, d).select("listing_id", (F.col("listing_id") % 4).cast("int").cast("string").alias("f"),
                                    "status")
    names = {str(k): v for k, v in rules.FURNISHING_NAMES.items()}
    return l.select("listing_id", B.recode("f", names).alias("furnishing_type"),
                    B.map_values("status", {"F": 1, "O": 2}).alias("status_code"))


@query("b3_b4_categories", fx.with_views("""
SELECT unit_id, CASE WHEN s >= 0 AND s < 50 THEN 'Low' WHEN s >= 50 AND s < 150 THEN 'Medium'
  WHEN s >= 150 AND s <= 175 THEN 'High' END AS luxury_category,
  CASE WHEN f >= 0 AND f <= 2 THEN 'Low Floor' WHEN f >= 3 AND f <= 10 THEN 'Mid Floor'
  WHEN f >= 11 AND f <= 51 THEN 'High Floor' END AS floor_category FROM (
  SELECT unit_id, CAST(bedRoom * 4 AS DOUBLE) AS s, bedRoom + discount * 10 AS f FROM unit)""", "unit"))
def b3(spark, d):
    u = fx.unit(spark, d).select("unit_id", (F.col("bedRoom") * 4).cast("double").alias("s"),
                                 (F.col("bedRoom") + F.col("discount") * 10).alias("f"))
    return u.select("unit_id", B.categorise_luxury("s").alias("luxury_category"),
                    B.categorise_floor("f").alias("floor_category"))


# --- 2.7 joins and unions --------------------------------------------------------
_GEO = ("concat(CAST(n_nationkey + 20 AS STRING), '.', lpad(CAST(n_nationkey * 37 % 10000 AS STRING), 4, '0'), "
        "'° N, ', CAST(n_regionkey + 70 AS STRING), '.', lpad(CAST(n_nationkey * 53 % 10000 AS STRING), 4, '0'), '° E')")


@query("j1_geo_join", fx.with_views(f"""
, geo AS (SELECT n_name AS sector, {_GEO} AS coordinates FROM nation)
SELECT l.sector, round(avg(price), 6) AS mean_price,
  TRY_CAST(nullif(regexp_extract(split_part(coordinates, ',', 1), '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS lat,
  TRY_CAST(nullif(regexp_extract(split_part(coordinates, ',', 2), '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS lon
FROM listing l JOIN geo g ON l.sector = g.sector GROUP BY l.sector, coordinates""", "listing"))
def j1(spark, d):
    geo = fx.table(spark, d, "nation").selectExpr("n_name AS sector", f"{_GEO} AS coordinates")
    lat, lon = T.parse_coordinates("coordinates")
    geo = geo.select("sector", lat.alias("lat"), lon.alias("lon"))
    means = fx.listing(spark, d).groupBy("sector").agg(F.round(F.avg("price"), 6).alias("mean_price"))
    return J.lookup_join(means, geo, on="sector")


@query("j2_fill_from_lookup", fx.with_views("""
, apps AS (SELECT upper(regexp_replace(society, '\\d+(\\.\\d+)?\\s?★', '', 'g')) AS name, features FROM raw
           WHERE features IS NOT NULL AND society IS NOT NULL),
app1 AS (SELECT lower(name) AS k, min(features) AS f FROM apps GROUP BY lower(name))
SELECT r.listing_id, coalesce(r.features, a.f) AS features FROM raw r
LEFT JOIN app1 a ON lower(regexp_replace(r.society, '\\d+(\\.\\d+)?\\s?★', '', 'g')) = a.k""", "raw"))
def j2(spark, d):
    r = fx.raw(spark, d)
    key = F.regexp_replace("society", r"\d+(\.\d+)?\s?★", "")
    apps = r.filter(F.col("features").isNotNull() & F.col("society").isNotNull()).select(
        F.upper(key).alias("name"), "features")
    base = r.select("listing_id", key.alias("society_key"), "features")
    return J.fill_from(base, apps, "society_key", "name", "features", "features").select("listing_id", "features")


@query("j3_join_on_key", fx.with_views(f"""
SELECT l.listing_id, l.price AS price, {_PRICE} AS parsed_price FROM listing l JOIN raw r ON l.listing_id = r.listing_id""",
    "listing", "raw"))
def j3(spark, d):
    parsed = fx.raw(spark, d).select("listing_id", T.parse_price("price_text").alias("parsed_price"))
    return J.join_on_key(fx.listing(spark, d).select("listing_id", "price"), parsed, "listing_id")


_IMP = ["price", "area", "bedRoom", "discount"]


def _imp_tables(u):
    """Three small (feature, statistic) tables: mean, sample std and max of
    each numeric column, each from one aggregate unpivoted with ``stack``."""
    num = u.select(*[F.col(c).cast("double").alias(c) for c in _IMP])
    pairs = ", ".join(f"'{c}', {c}" for c in _IMP)

    def table(fn, name):
        return num.agg(*[fn(c).alias(c) for c in _IMP]).selectExpr(
            f"stack({len(_IMP)}, {pairs}) AS (feature, {name})")

    return table(F.avg, "mean_value"), table(F.stddev_samp, "std_value"), table(F.max, "max_value")


@query("j4_join_chain", fx.with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 5) AS mean_value, round(stddev_samp({c}), 5) AS std_value, "
    f"round(CAST(max({c}) AS DOUBLE), 6) AS max_value FROM unit" for c in _IMP), "unit"))
def j4(spark, d):
    out = J.join_all(list(_imp_tables(fx.unit(spark, d))), "feature")
    return out.select("feature", F.round("mean_value", 5).alias("mean_value"), F.round("std_value", 5).alias("std_value"),
                      F.round("max_value", 6).alias("max_value"))


@query("j5_semi_join", fx.with_views("""
SELECT listing_id FROM listing WHERE cust_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""", "listing"))
def j5(spark, d):
    keys = fx.table(spark, d, "customer").filter(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("cust_id"))
    return J.semi_join(fx.listing(spark, d).select("listing_id", "cust_id"), keys, "cust_id").select("listing_id")


@query("u1_union_by_name", """
SELECT o_orderkey AS listing_id, o_totalprice AS price, o_orderpriority AS age, NULL::VARCHAR AS status_note
FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT o_orderkey AS listing_id, o_totalprice AS price, NULL::VARCHAR AS age, o_orderstatus AS status_note
FROM orders WHERE o_orderstatus <> 'F'""")
def u1(spark, d):
    o = fx.table(spark, d, "orders")
    flats = o.filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("listing_id"), F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("age"))
    houses = o.filter(F.col("o_orderstatus") != "F").select(
        F.col("o_orderkey").alias("listing_id"), F.col("o_orderstatus").alias("status_note"),
        F.col("o_totalprice").alias("price"))
    return J.union_by_name(flats, houses)


query("t22_term_frequency", _term_frequency_sql())(term_frequency)
