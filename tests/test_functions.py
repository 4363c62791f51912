"""Golden rows for the parsing, recoding and numeric rules (FIXTURES.md §3)."""

import math

import pytest
from pyspark.sql import functions as F

from plotwise.functions import numeric as N
from plotwise.functions import recode as B
from plotwise.functions import rules
from plotwise.functions import text as T


def one_col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_parse_price(spark):
    assert one_col(spark, ["85 Lac", "1.25 Crore", None, "abc Crore"], T.parse_price) == [0.85, 1.25, None, None]


def test_parse_rate(spark):
    assert one_col(spark, ["₹ 8,500/sq.ft.", "₹ 12,34,000/sq.ft.", None], T.parse_rate) == [8500.0, 1234000.0, None]


def test_leading_int_and_balcony(spark):
    assert one_col(spark, ["3 Bedrooms", "x", None], T.leading_int) == [3, None, None]
    assert one_col(spark, ["No Balcony", "3+ Balconies", "2 Balconies"], T.balcony) == ["0", "3+", "2"]


def test_floor_number_quirk(spark):
    vals = ["Ground of 4", "Basement", "7 of 20", "Lower", None]
    assert one_col(spark, vals, T.floor_number) == [0.0, 1.0, 7.0, 0.0, None]
    assert one_col(spark, vals, lambda c: T.floor_number(c, signed=True)) == [0.0, -1.0, 7.0, 0.0, None]


def test_extract_locality(spark):
    vals = ["Flat in Sector 36 Gurgaon", "no match here", "3 BHK Flat in Sohna Road Gurgaon"]
    assert one_col(spark, vals, T.extract_locality) == ["sector 36", None, "sohna road"]


def test_locality_rules_order_matters(spark):
    out = one_col(spark, ["ashok vihar phase 2", "sohna road"], lambda c: T.apply_replacements(c, rules.LOCALITY_RULES_ROUND1))
    assert out == ["sector 3 phase 2", "sohna road road"]


def test_areas_and_sqft(spark):
    text = "Super Built up area 1800.0 (167.23 sq.m.)Built Up area: 1600 sq.ft.Carpet area: 1400 sq.ft."
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(T.super_built_up("t").alias("s"), T.built_up("t").alias("b"), T.carpet("t").alias("c")).first()
    assert (r.s, r.b, r.c) == (1800.0, 1600.0, 1400.0)
    sq = df.select(T.to_sqft("t", F.lit(1800.0)).alias("v"), T.to_sqft("t", F.lit(1600.0)).alias("w")).first()
    assert abs(sq.v - 167.23 * 10.7639) < 1e-9 and sq.w == 1600.0


def test_plot_scale(spark):
    df = spark.createDataFrame([(900.0, 100.0), (1100.0, 100.0), (500.0, 100.0), (None, 100.0)], "a double, p double")
    assert [r[0] for r in df.select(T.convert_plot_scale("a", "p")).collect()] == [900.0, 1070.0, 100.0, 100.0]


def test_categorise_age(spark):
    vals = ["By 2025", "May 2024", "soon", None, "0 to 1 Year Old", "10+ Year Old"]
    assert one_col(spark, vals, T.categorise_age) == [
        "Under Construction", "Under Construction", "Undefined", "Undefined", "New Property", "Old Property"]


def test_item_count(spark):
    vals = ["['3 Fan']", "['No Fan']", "['Fan']", None, "['2 Light']"]
    assert one_col(spark, vals, lambda c: T.item_count(c, "Fan")) == [3, 0, 1, 0, 0]


def test_price_details(spark):
    s = "{'3 BHK': {'building_type': 'Apartment', 'area': '1,605 - 2,170 sq.ft.', 'price-range': '₹ 95 L - 2.2 Cr'}}"
    df = spark.createDataFrame([(s,), ("broken",)], "x string")
    ex = df.select(F.explode(T.price_details_map("x")).alias("k", "v"))
    facts = T.config_facts(F.col("v"))
    r = ex.select("k", *[c.alias(n) for n, c in facts.items()]).collect()
    assert len(r) == 1
    assert r[0].k == "3 BHK" and r[0].area_low == 1605.0 and r[0].area_high == 2170.0
    assert abs(r[0].price_low - 0.95) < 1e-12 and r[0].price_high == 2.2


def test_distance_and_coordinates(spark):
    assert one_col(spark, ["1.5 Km", "800 Meter", "near", "2 KM"], T.distance_to_meters) == [1500.0, 800.0, None, 2000.0]
    df = spark.createDataFrame([("28.3663° N, 76.9456° E",)], "c string")
    lat, lon = T.parse_coordinates("c")
    assert tuple(df.select(lat, lon).first()) == (28.3663, 76.9456)


def test_locality_number(spark):
    assert one_col(spark, ["sector 36", "gwal pahari"], T.locality_number) == [36.0, math.inf]


def test_clean_society(spark):
    assert one_col(spark, ["DLF Park 4.2 ★", None], T.clean_society) == ["dlf park", None]
    assert one_col(spark, ["Anand Lok", None], lambda c: T.clean_society(c, "independent")) == ["anand lok", "independent"]


def test_bins(spark):
    assert one_col(spark, [49.0, 50.0, 150.0, 175.0, 176.0], B.categorise_luxury, "double") == [
        "Low", "Medium", "High", "High", None]
    assert one_col(spark, [2.0, 2.5, 10.0, 51.0, 52.0], B.categorise_floor, "double") == [
        "Low Floor", None, "Mid Floor", "High Floor", None]


def test_recode_and_map(spark):
    m = {"0": "unfurnished", "1": "semifurnished"}
    assert one_col(spark, ["0", "1", "5"], lambda c: B.recode(c, m)) == ["unfurnished", "semifurnished", "5"]
    assert one_col(spark, ["Low", "High", "x"], lambda c: B.map_values(c, {"Low": 1, "High": 3})) == [1, 3, None]


def test_half_even_and_safe_div(spark):
    df = spark.createDataFrame([(2.5, 0.0), (3.5, 2.0)], "a double, b double")
    r = df.select(N.half_even("a"), N.safe_div("a", "b")).collect()
    assert [tuple(x) for x in r] == [(2.0, None), (4.0, 1.75)]


def test_sample_moments_match_pandas_formula(spark):
    xs = [1.0, 2.0, 2.0, 3.0, 10.0, 4.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    r = df.agg(N.sample_skew("x").alias("s"), N.sample_kurt("x").alias("k")).first()
    n = len(xs)
    m = sum(xs) / n
    m2 = sum((x - m) ** 2 for x in xs) / n
    m3 = sum((x - m) ** 3 for x in xs) / n
    m4 = sum((x - m) ** 4 for x in xs) / n
    g1, g2 = m3 / m2 ** 1.5, m4 / m2 ** 2 - 3
    G1 = math.sqrt(n * (n - 1)) / (n - 2) * g1
    G2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    assert r.s == pytest.approx(G1) and r.k == pytest.approx(G2)


def test_score_band(spark):
    from plotwise.operators.evaluate import score
    df = spark.createDataFrame([(math.log1p(2.0), 2000.0)], "prediction double, built_up_area double")
    r = score(df).first()
    assert (r.estimated_price_cr, r.lower_bound_cr, r.upper_bound_cr, r.price_per_sqft) == (2.0, 1.74, 2.26, 10000.0)
