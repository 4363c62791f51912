"""Registered queries for aggregations, ranking and outliers (2.8-2.10)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from plotwise.functions import text as T
from plotwise.operators import aggregates as A
from plotwise.operators import outliers as Q
from plotwise.operators import ranking as W
from plotwise.plans import fixtures as fx
from plotwise.plans.registry import query


def r6(c):
    return F.round(c, 6)


def _round_cols(df, cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


# --- flagship: median price per sector, ranked, top 10 (A5 + W4 + W1) -----
def median_price_by_sector(spark, d, k: int = 10):
    med = A.group_median(fx.listing(spark, d), ["sector"], ["price"])
    top = W.top_k(med, [F.desc("median_price"), F.asc("sector")], k)
    w = Window.orderBy(F.desc("median_price"), F.asc("sector"))
    return top.select("sector", r6("median_price").alias("median_price"),
                      F.row_number().over(w).alias("rank"))


query("a5_median_price_by_sector", fx.with_views("""
SELECT sector, round(med, 6) AS median_price, CAST(rn AS INTEGER) AS rank FROM (
  SELECT sector, med, row_number() OVER (ORDER BY med DESC, sector) AS rn
  FROM (SELECT sector, median(price) AS med FROM listing GROUP BY sector)) WHERE rn <= 10""", "listing"))(
    median_price_by_sector)


@query("a1_value_counts", fx.with_views(
    "SELECT property_type, count(*) AS count FROM listing WHERE property_type IS NOT NULL GROUP BY 1", "listing"))
def a1(spark, d):
    return A.value_counts(fx.listing(spark, d), "property_type")


@query("a2_value_shares", fx.with_views("""
SELECT status, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM listing WHERE status IS NOT NULL GROUP BY 1""", "listing"))
def a2(spark, d):
    return _round_cols(A.value_counts(fx.listing(spark, d), "status", normalize=True), ["share"])


@query("a3_market_kpis", fx.with_views("""
SELECT count(*) AS total_properties, round(median(price), 2) AS median_price,
       count(DISTINCT society) AS n_sectors, median(area) AS median_area FROM unit""", "unit"))
def a3(spark, d):
    return A.kpis(fx.unit(spark, d), price="price", key="society", area="area")


@query("a3_distributions", fx.with_views("""
SELECT 'property_type' AS column_name, property_type AS value, count(*) AS count FROM model GROUP BY property_type
UNION ALL SELECT 'furnishing_type', furnishing_type, count(*) FROM model GROUP BY furnishing_type""", "model"))
def a3_distributions(spark, d):
    """The breakdowns that go with the KPIs (A3) and the dataset statistics."""
    return A.distributions(fx.model_table(spark, d), ["property_type", "furnishing_type"])


@query("a4_group_mean", fx.with_views("""
SELECT society, round(avg(price), 6) AS mean_price, round(avg(area), 6) AS mean_area
FROM unit GROUP BY society""", "unit"))
def a4(spark, d):
    return _round_cols(A.group_mean(fx.unit(spark, d), ["society"], ["price", "area"]), ["mean_price", "mean_area"])


@query("a5_group_median_two_keys", fx.with_views("""
SELECT sector, property_type, round(median(price), 6) AS median_price
FROM listing GROUP BY sector, property_type""", "listing"))
def a5b(spark, d):
    return _round_cols(A.group_median(fx.listing(spark, d), ["sector", "property_type"], ["price"]), ["median_price"])


@query("a6_crosstab", fx.with_views("""
SELECT sector, count(*) FILTER (WHERE status = 'F') AS "F", count(*) FILTER (WHERE status = 'O') AS "O",
       count(*) FILTER (WHERE status = 'P') AS "P" FROM listing GROUP BY sector""", "listing"))
def a6(spark, d):
    return A.crosstab(fx.listing(spark, d), "sector", "status", ["F", "O", "P"])


@query("a7_pivot_mean", fx.with_views("""
SELECT society, round(avg(price) FILTER (WHERE returnflag = 'A'), 6) AS "A",
       round(avg(price) FILTER (WHERE returnflag = 'N'), 6) AS "N",
       round(avg(price) FILTER (WHERE returnflag = 'R'), 6) AS "R" FROM unit GROUP BY society""", "unit"))
def a7(spark, d):
    return _round_cols(A.pivot_mean(fx.unit(spark, d), "society", "returnflag", "price", ["A", "N", "R"]),
                       ["A", "N", "R"])


_DESCRIBE_COLS = ["mean", "std", "min", "p25", "p50", "p75", "max"]


@query("a8_describe", fx.with_views("""
SELECT count(price) AS count, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS std,
       round(min(price), 6) AS min, round(quantile_cont(price, 0.25), 6) AS p25,
       round(quantile_cont(price, 0.5), 6) AS p50, round(quantile_cont(price, 0.75), 6) AS p75,
       round(max(price), 6) AS max FROM listing""", "listing"))
def a8(spark, d):
    return _round_cols(A.describe(fx.listing(spark, d), "price"), _DESCRIBE_COLS)


_QS = [0.02, 0.25, 0.5, 0.75, 0.98]


@query("a9_quantiles", fx.with_views("""
SELECT unnest([0.02, 0.25, 0.5, 0.75, 0.98]::DOUBLE[]) AS q,
       round(unnest(quantile_cont(price_per_sqft, [0.02, 0.25, 0.5, 0.75, 0.98])), 6) AS value FROM unit""", "unit"))
def a9(spark, d):
    return _round_cols(A.quantiles(fx.unit(spark, d), "price_per_sqft", _QS), ["value"])


@query("a10_skew_kurt", fx.with_views("""
SELECT round(skewness(price), 6) AS skew, round(kurtosis(price), 6) AS kurt,
       round(skewness(ln(1 + price)), 6) AS log_skew, round(kurtosis(ln(1 + price)), 6) AS log_kurt
FROM listing""", "listing"))
def a10(spark, d):
    l = fx.listing(spark, d)
    raw = A.moments(l, "price")
    logm = A.moments(l, "price", log=True).select(F.col("skew").alias("log_skew"), F.col("kurt").alias("log_kurt"))
    out = raw.select(r6("skew").alias("skew"), r6("kurt").alias("kurt"),
                     logm.select(r6("log_skew")).scalar().alias("log_skew"),
                     logm.select(r6("log_kurt")).scalar().alias("log_kurt"))
    return out


_CORR_COLS = ["price", "area", "price_per_sqft", "bedRoom", "discount"]


@query("a11_corr_matrix", fx.with_views("\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM unit"
    for a in _CORR_COLS for b in _CORR_COLS), "unit"))
def a11(spark, d):
    return _round_cols(A.corr_matrix(fx.unit(spark, d), _CORR_COLS), ["corr"])


@query("a11_corr_with_target", fx.with_views("\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature, round(corr({a}, price), 6) AS corr FROM unit"
    for a in ["area", "bedRoom", "discount", "retail"]), "unit"))
def a11b(spark, d):
    return _round_cols(A.corr_with(fx.unit(spark, d), ["area", "bedRoom", "discount", "retail"], "price"), ["corr"])


@query("a12_histogram", fx.with_views("""
, s AS (SELECT min(price) AS lo, max(price) AS hi FROM listing),
b AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30)),
c AS (SELECT CAST(least(floor((price - lo) / ((hi - lo) / CAST(30 AS DOUBLE))), 29) AS INTEGER) AS bin,
             count(*) AS cnt FROM listing, s WHERE price IS NOT NULL GROUP BY 1)
SELECT b.bin, round(lo + b.bin * ((hi - lo) / CAST(30 AS DOUBLE)), 6) AS "left",
       round(lo + (b.bin + 1) * ((hi - lo) / CAST(30 AS DOUBLE)), 6) AS "right",
       coalesce(cnt, 0) AS count FROM b LEFT JOIN c ON b.bin = c.bin, s""".replace("\n, s AS", ", s AS", 1),
    "listing").replace("\n, s AS", ", s AS"))
def a12(spark, d):
    return _round_cols(A.histogram(fx.listing(spark, d), "price", 30), ["left", "right"])


@query("a13_box_stats", fx.with_views("""
, q AS (SELECT property_type, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS med,
               quantile_cont(price, 0.75) AS q3 FROM listing GROUP BY property_type)
SELECT l.property_type, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(min(price) FILTER (WHERE price >= q1 - 1.5 * (q3 - q1) AND price <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(price) FILTER (WHERE price >= q1 - 1.5 * (q3 - q1) AND price <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (WHERE price IS NOT NULL AND NOT (price >= q1 - 1.5 * (q3 - q1) AND price <= q3 + 1.5 * (q3 - q1))) AS n_outliers
FROM listing l JOIN q ON l.property_type = q.property_type GROUP BY l.property_type, q1, med, q3""", "listing"))
def a13(spark, d):
    return _round_cols(A.box_stats(fx.listing(spark, d), "price", by=["property_type"]),
                       ["q1", "median", "q3", "whisker_low", "whisker_high"])


@query("a14_rollup", fx.with_views("""
SELECT region_key, sector, round(sum(price), 6) AS total, CAST(grouping(region_key, sector) AS INTEGER) AS level
FROM listing GROUP BY ROLLUP (region_key, sector)""", "listing"))
def a14(spark, d):
    out = A.rollup_sum(fx.listing(spark, d), "region_key", "sector", "price")
    return out.select("region_key", "sector", r6("total").alias("total"), F.col("level").cast("int").alias("level"))


def _profile_sql():
    names = ["mean", "std", "min", "max", "p25", "p50", "p75"]
    parts = []
    for c in ["society", "bedRoom", "price"]:
        if c == "society":
            top = f"(SELECT {c} FROM unit WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
            nums = ["CAST(NULL AS DOUBLE)"] * 7
        else:
            top = "CAST(NULL AS VARCHAR)"
            nums = [f"round(avg({c}), 6)", f"round(stddev_samp({c}), 6)", f"round(CAST(min({c}) AS DOUBLE), 6)",
                    f"round(CAST(max({c}) AS DOUBLE), 6)", f"round(quantile_cont({c}, 0.25), 6)",
                    f"round(quantile_cont({c}, 0.5), 6)", f"round(quantile_cont({c}, 0.75), 6)"]
        parts.append(f"SELECT '{c}' AS column_name, count({c}) AS n, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
                     f"count(DISTINCT {c}) AS n_distinct, {top} AS top, "
                     + ", ".join(f"{v} AS {n}" for v, n in zip(nums, names)) + " FROM unit")
    return "\nUNION ALL\n".join(parts)


@query("a15_profile", fx.with_views(_profile_sql(), "unit"))
def a15(spark, d):
    u = fx.unit(spark, d).select("society", "bedRoom", "price")
    out = A.profile(u)
    out = out.withColumn("top", F.when(F.col("column_name") == "society", F.col("top")))
    return _round_cols(out, ["mean", "std", "min", "max", "p25", "p50", "p75"])


_TOPS = {"society": "NULL", "bedRoom": "CAST(bedRoom AS DOUBLE)", "price": "CAST(price AS DOUBLE)"}


@query("a15_top_values", fx.with_views("\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, CAST(rk AS INTEGER) AS rank, {"value" if c == "society" else "CAST(CAST(number AS BIGINT) AS VARCHAR)"
if c == "bedRoom" else "CAST(NULL AS VARCHAR)"} AS value, n AS count, round(n / total, 6) AS share FROM (
  SELECT CAST({c} AS VARCHAR) AS value, {order} AS number, count(*) AS n, sum(count(*)) OVER () AS total,
    row_number() OVER (ORDER BY count(*) DESC, {"CAST(" + c + " AS VARCHAR)" if c == "society" else order}) AS rk
  FROM unit WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rk <= 4""" for c, order in _TOPS.items()), "unit"))
def a15_tops(spark, d):
    u = fx.unit(spark, d).select("society", "bedRoom", "price")
    out = A.top_values(u, ["society", "bedRoom", "price"], 4)
    # the text of a double is each engine's own
    return out.select("column_name", "rank", F.when(F.col("column_name") != "price", F.col("value")).alias("value"), "count",
                      F.round("share", 6).alias("share"))


@query("a15_overview", """
WITH t AS (SELECT l_partkey, l_quantity, l_discount, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS flag FROM lineitem)
SELECT count(*) AS n_rows, 4 AS n_columns, CAST(count(*) FILTER (WHERE flag IS NULL) AS BIGINT) AS n_missing,
  round(count(*) FILTER (WHERE flag IS NULL) / (count(*) * 4), 6) AS missing_share,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS n_duplicates,
  round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t))) / count(*), 6) AS duplicate_share FROM t""")
def a15_overview(spark, d):
    t = fx.table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_discount", F.when(
        F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("flag"))
    return _round_cols(A.profile_overview(t), ["missing_share", "duplicate_share"])


@query("a15_merged_sketches", fx.with_views("\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS nulls,
  {f"CAST(min({c}) AS DOUBLE)" if c != "society" else "CAST(NULL AS DOUBLE)"} AS min,
  {f"CAST(max({c}) AS DOUBLE)" if c != "society" else "CAST(NULL AS DOUBLE)"} AS max, true AS distinct_ok, true AS median_ok,
  {f"(SELECT {c} FROM unit GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" if c == "society" else "CAST(NULL AS VARCHAR)"} AS top
FROM unit""" for c in ["society", "bedRoom", "price"]), "unit"))
def a15_sketches(spark, d):
    """Sketches by return flag, merged; the estimates are held against the exact profile."""
    from plotwise.operators import sketches as K
    u = fx.unit(spark, d).select("returnflag", "society", "bedRoom", "price")
    made = K.estimates(K.merge_profiles(K.sketch_profile(u, by=["returnflag"])), qs=(0.45, 0.55), k=1)
    exact = A.profile(u.drop("returnflag")).select("column_name", F.col("n_distinct").alias("d"), "p50")
    near = F.abs(F.col("n_distinct") - F.col("d")) <= 0.03 * F.col("d") + 1
    between = F.col("p50").isNull() | (F.col("p50").between(F.get("quantiles", F.lit(0)), F.get("quantiles", F.lit(1))))
    return made.join(F.broadcast(exact), "column_name").select(
        "column_name", "n", "nulls", "min", "max", near.alias("distinct_ok"), between.alias("median_ok"),
        F.when(F.col("column_name") == "society", F.get("top", F.lit(0))["item"]).alias("top"))


@query("a16_nunique", fx.with_views("SELECT count(DISTINCT sector) AS n_unique FROM listing", "listing"))
def a16(spark, d):
    return A.nunique(fx.listing(spark, d), "sector")


@query("a16_unique_sorted", fx.with_views(
    "SELECT DISTINCT sector FROM listing WHERE sector IS NOT NULL ORDER BY sector", "listing"))
def a16b(spark, d):
    return A.unique_sorted(fx.listing(spark, d), "sector")


@query("a17_ols_trend", fx.with_views("""
SELECT round(regr_slope(price, area), 6) AS slope, round(regr_intercept(price, area), 6) AS intercept,
       round(regr_r2(price, area), 6) AS r2, CAST(regr_count(price, area) AS BIGINT) AS n FROM unit""", "unit"))
def a17(spark, d):
    return _round_cols(A.ols_trend(fx.unit(spark, d), "area", "price"), ["slope", "intercept", "r2"])


@query("a18_group_mode", fx.with_views("""
SELECT sector, age_text AS mode FROM (
  SELECT sector, age_text, row_number() OVER (PARTITION BY sector ORDER BY count(*) DESC, age_text) AS rn
  FROM listing WHERE age_text IS NOT NULL GROUP BY sector, age_text) WHERE rn = 1""", "listing"))
def a18(spark, d):
    return A.group_mode(fx.listing(spark, d), ["sector"], "age_text")


_EDGES = [0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 6.0]


@query("b5_binned_counts", fx.with_views(
    ", bins AS (SELECT * FROM (VALUES " +
    ", ".join(f"({i}, '[{_EDGES[i]}, {_EDGES[i + 1]})', CAST({_EDGES[i]} AS DOUBLE), CAST({_EDGES[i + 1]} AS DOUBLE))"
              for i in range(len(_EDGES) - 1)) +
    ") AS t(bin_order, bin, lo, hi))\n"
    "SELECT CAST(bin_order AS INTEGER) AS bin_order, bin, "
    "count(l.price) AS count FROM bins LEFT JOIN listing l ON l.price >= lo AND l.price < hi "
    "GROUP BY bin_order, bin", "listing").replace("\n, bins AS", ", bins AS"))
def b5(spark, d):
    return A.binned_counts(fx.listing(spark, d), "price", _EDGES)


_BANDS = [("n_gt_100", 101, None), ("n_50_100", 50, 100), ("n_10_49", 10, 49), ("n_2_9", 2, 9), ("n_1", 1, 1)]


@query("b6_frequency_bins", fx.with_views("""
, c AS (SELECT cust_id, count(*) AS n FROM listing WHERE cust_id IS NOT NULL GROUP BY cust_id)
SELECT count(*) FILTER (WHERE n >= 101) AS n_gt_100, count(*) FILTER (WHERE n BETWEEN 50 AND 100) AS n_50_100,
       count(*) FILTER (WHERE n BETWEEN 10 AND 49) AS n_10_49, count(*) FILTER (WHERE n BETWEEN 2 AND 9) AS n_2_9,
       count(*) FILTER (WHERE n = 1) AS n_1 FROM c""", "listing").replace("\n, c AS", ", c AS"))
def b6(spark, d):
    return A.frequency_bins(fx.listing(spark, d), "cust_id", _BANDS)


@query("w1_top_k", fx.with_views(
    "SELECT listing_id, price FROM listing ORDER BY price DESC, listing_id LIMIT 10", "listing"))
def w1(spark, d):
    return W.top_k(fx.listing(spark, d).select("listing_id", "price"), [F.desc("price"), F.asc("listing_id")], 10)


@query("w2_nearest_k", fx.with_views("""
SELECT unit_id, area, abs(area - 2500) AS distance FROM unit
WHERE society = 'Brand#3' AND bedRoom BETWEEN 9 AND 11 ORDER BY distance, unit_id LIMIT 5""", "unit"))
def w2(spark, d):
    return W.nearest_k(fx.unit(spark, d), 2500.0, "area", 5, equals={"society": "Brand#3"},
                       range_col="bedRoom", low=9, high=11, tie="unit_id").select("unit_id", "area", "distance")


@query("w2_nearest_k_batch", fx.with_views("""
, req AS (SELECT society AS request_id, society, avg(area) AS target, 25 AS bed FROM unit GROUP BY society)
SELECT request_id, unit_id, area, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT r.request_id, u.unit_id, u.area, abs(u.area - r.target) AS distance,
         row_number() OVER (PARTITION BY r.request_id ORDER BY abs(u.area - r.target), u.unit_id) AS rank
  FROM unit u JOIN req r ON u.society = r.society AND u.bedRoom BETWEEN r.bed - 1 AND r.bed + 1)
WHERE rank <= 5""", "unit").replace("\n, req AS", ", req AS"))
def w2b(spark, d):
    u = fx.unit(spark, d)
    req = u.groupBy("society").agg(F.avg("area").alias("target")).select(
        F.col("society").alias("request_id"), "society", "target", F.lit(25).alias("bed"))
    out = W.nearest_k_batch(u, req, ["society"], "area", "target", 5, tie="unit_id",
                            range_col="bedRoom", range_target="bed", spread=1)
    return out.withColumn("distance", r6("distance"))


@query("w3_nearest_budget", fx.with_views("""
SELECT listing_id, price, round(abs(price - 3.0), 6) AS distance FROM listing WHERE sector = 'NATION_7'
ORDER BY abs(price - 3.0), listing_id LIMIT 5""", "listing"))
def w3(spark, d):
    out = W.nearest_k(fx.listing(spark, d), 3.0, "price", 5, equals={"sector": "NATION_7"})
    return out.select("listing_id", "price", r6("distance").alias("distance"))


@query("w4_rank_of_key", fx.with_views("""
SELECT sector, round(m, 6) AS mean_value, CAST(row_number() OVER (ORDER BY m DESC, sector) AS INTEGER) AS rank,
       count(*) OVER () AS n_keys FROM (SELECT sector, avg(price) AS m FROM listing GROUP BY sector)""", "listing"))
def w4(spark, d):
    return _round_cols(W.rank_of_key(fx.listing(spark, d), "sector", "price"), ["mean_value"])


@query("w5_cumulative_share", fx.with_views("""
SELECT society, cnt AS count, round(sum(cnt) OVER (ORDER BY cnt DESC, society ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       / sum(cnt) OVER (), 6) AS cum_share FROM (
  SELECT society, count(*) AS cnt FROM unit WHERE society IS NOT NULL GROUP BY society)
ORDER BY cnt DESC, society LIMIT 10""", "unit"))
def w5(spark, d):
    return _round_cols(W.cumulative_share(fx.unit(spark, d), "society", 10), ["cum_share"])


@query("w4_rank_of_every_part", """
SELECT p_name AS name, round(m, 6) AS mean_value, CAST(row_number() OVER (ORDER BY m DESC, p_name) AS INTEGER) AS rank,
       count(*) OVER () AS n_keys FROM (SELECT p_name, avg(p_retailprice) AS m FROM part GROUP BY p_name)""")
def w4_parts(spark, d):
    """Many keys, texts: ranked over range partitions."""
    p = fx.table(spark, d, "part").select(F.col("p_name").alias("name"), "p_retailprice")
    return _round_cols(W.rank_of_key(p, "name", "p_retailprice"), ["mean_value"])


@query("w5_cumulative_share_all", """
SELECT p_name AS name, cnt AS count, round(sum(cnt) OVER (ORDER BY cnt DESC, p_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       / sum(cnt) OVER (), 9) AS cum_share FROM (SELECT p_name, count(*) AS cnt FROM part GROUP BY p_name)""")
def w5_all(spark, d):
    out = W.cumulative_share(fx.table(spark, d, "part").select(F.col("p_name").alias("name")), "name")
    return out.withColumn("cum_share", F.round("cum_share", 9))


@query("w6_ecdf", fx.with_views("""
SELECT bedRoom, cnt AS count, round(sum(cnt) OVER (ORDER BY bedRoom ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       / (SELECT count(*) FROM unit), 6) AS ecdf FROM (
  SELECT bedRoom, count(*) AS cnt FROM unit WHERE bedRoom IS NOT NULL GROUP BY bedRoom)""", "unit"))
def w6(spark, d):
    return _round_cols(W.ecdf(fx.unit(spark, d), "bedRoom"), ["ecdf"])


@query("w7_sort_index", fx.with_views(
    "SELECT bedRoom, count(*) AS count FROM unit GROUP BY bedRoom ORDER BY bedRoom", "unit"))
def w7(spark, d):
    return W.sort_index(fx.unit(spark, d).groupBy("bedRoom").agg(F.count(F.lit(1)).alias("count")), "bedRoom")


# --- 2.10 outliers and imputation ------------------------------------------
@query("q1_iqr_bounds", fx.with_views("""
SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(q1 - 1.5 * (q3 - q1), 6) AS lower,
       round(q3 + 1.5 * (q3 - q1), 6) AS upper FROM (
  SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM listing)""", "listing"))
def q1(spark, d):
    return _round_cols(Q.iqr_bounds(fx.listing(spark, d), "price"), ["q1", "q3", "iqr", "lower", "upper"])


@query("q1_iqr_outliers", fx.with_views("""
, b AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM listing),
o AS (SELECT price FROM listing, b WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1))
SELECT count(price) AS count, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS std,
       round(min(price), 6) AS min, round(quantile_cont(price, 0.25), 6) AS p25,
       round(quantile_cont(price, 0.5), 6) AS p50, round(quantile_cont(price, 0.75), 6) AS p75,
       round(max(price), 6) AS max FROM o""", "listing").replace("\n, b AS", ", b AS"))
def q1b(spark, d):
    return _round_cols(A.describe(Q.iqr_outliers(fx.listing(spark, d), "price"), "price"), _DESCRIBE_COLS)


@query("q2_rescale_outliers", fx.with_views("""
, b AS (SELECT quantile_cont(price_per_sqft, 0.25) AS q1, quantile_cont(price_per_sqft, 0.75) AS q3 FROM unit),
f AS (SELECT u.*, (price_per_sqft < q1 - 1.5 * (q3 - q1) OR price_per_sqft > q3 + 1.5 * (q3 - q1)) AS o FROM unit u, b),
g AS (SELECT unit_id, price, o, price_per_sqft, CASE WHEN o AND area < 1000 THEN area * 9 ELSE area END AS area FROM f)
SELECT unit_id, area, CASE WHEN o THEN coalesce(round_even(price * CAST(10000000 AS DOUBLE) / nullif(area, 0), 0),
       price_per_sqft) ELSE price_per_sqft END AS price_per_sqft FROM g""", "unit").replace("\n, b AS", ", b AS"))
def q2(spark, d):
    out = Q.rescale_outliers(fx.unit(spark, d).select("unit_id", "price", "area", "price_per_sqft"))
    return out.select("unit_id", "area", "price_per_sqft")


def parsed_areas(spark, d):
    """Areas parsed from the text column (T9), the input of Q3-Q5."""
    r = fx.raw(spark, d)
    return r.select("listing_id", T.parse_price("price_text").alias("price"),
                    T.super_built_up("area_text").alias("super_built_up_area"),
                    T.built_up("area_text").alias("built_up_area"),
                    T.carpet("area_text").alias("carpet_area"),
                    (F.col("listing_id") % 4000 + 300).cast("double").alias("area"))


_AREA_SQL = """
, pa AS (SELECT listing_id,
  round_even(CASE WHEN split_part(price_text, ' ', 2) = 'Lac' THEN TRY_CAST(split_part(price_text, ' ', 1) AS DOUBLE) / 100
       ELSE TRY_CAST(split_part(price_text, ' ', 1) AS DOUBLE) END, 2) AS price,
  TRY_CAST(nullif(regexp_extract(area_text, 'Super Built up area (\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS super_built_up_area,
  TRY_CAST(nullif(regexp_extract(area_text, 'Built Up area\\s*:\\s*(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS built_up_area,
  TRY_CAST(nullif(regexp_extract(area_text, 'Carpet area\\s*:\\s*(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS carpet_area,
  CAST(listing_id % 4000 + 300 AS DOUBLE) AS area FROM raw)"""


@query("q3_ratio_medians", fx.with_views(_AREA_SQL + """
SELECT round(median(super_built_up_area / nullif(built_up_area, 0)), 6) AS super_to_built,
       round(median(carpet_area / nullif(built_up_area, 0)), 6) AS carpet_to_built FROM pa
WHERE super_built_up_area IS NOT NULL AND built_up_area IS NOT NULL AND carpet_area IS NOT NULL""", "raw").replace(
    "\n, pa AS", ", pa AS"))
def q3(spark, d):
    return _round_cols(Q.ratio_medians(parsed_areas(spark, d)), ["super_to_built", "carpet_to_built"])


@query("q4_impute_built_up", fx.with_views(_AREA_SQL + """
SELECT listing_id, CASE WHEN built_up_area IS NOT NULL THEN built_up_area
  WHEN super_built_up_area IS NOT NULL AND carpet_area IS NOT NULL
    THEN round_even(((super_built_up_area / 1.105) + (carpet_area / 0.9)) / 2, 0)
  WHEN super_built_up_area IS NOT NULL THEN round_even(super_built_up_area / 1.105, 0)
  WHEN carpet_area IS NOT NULL THEN round_even(carpet_area / 0.9, 0) END AS built_up_area FROM pa""", "raw").replace(
    "\n, pa AS", ", pa AS").replace("1.105", "CAST(1.105 AS DOUBLE)").replace("0.9)", "CAST(0.9 AS DOUBLE))"))
def q4(spark, d):
    return Q.impute_built_up(parsed_areas(spark, d)).select("listing_id", "built_up_area")


@query("q5_repair_anomaly", fx.with_views(_AREA_SQL + """
SELECT listing_id, CASE WHEN built_up_area < 2000 AND price > 2.5 THEN coalesce(area, built_up_area)
  ELSE built_up_area END AS built_up_area FROM pa""", "raw").replace("\n, pa AS", ", pa AS"))
def q5(spark, d):
    return Q.repair_anomaly(parsed_areas(spark, d)).select("listing_id", "built_up_area")


@query("q6_impute_constant", fx.with_views("""
SELECT listing_id, coalesce(TRY_CAST(nullif(regexp_extract(
  replace(replace(CASE WHEN split_part(floor_text, ' ', 1) = 'Ground' THEN '0' ELSE split_part(floor_text, ' ', 1) END,
  'Basement', '-1'), 'Lower', '0'), '(\\d+)', 1), '') AS DOUBLE), 2.0) AS floor_num FROM raw""", "raw"))
def q6(spark, d):
    r = fx.raw(spark, d).select("listing_id", T.floor_number("floor_text").alias("floor_num"))
    return Q.impute_constant(r, "floor_num", 2.0)


def _age_sql(col: str) -> str:
    return f"""CASE WHEN {col} IS NULL THEN 'Undefined'
  WHEN contains({col}, '0 to 1 Year Old') OR contains({col}, 'Within 6 months') OR contains({col}, 'Within 3 months') THEN 'New Property'
  WHEN contains({col}, '1 to 5 Year Old') THEN 'Relatively New'
  WHEN contains({col}, '5 to 10 Year Old') THEN 'Moderately Old'
  WHEN contains({col}, '10+ Year Old') THEN 'Old Property'
  WHEN contains({col}, 'Under Construction') OR contains({col}, 'By') THEN 'Under Construction'
  WHEN TRY_CAST(string_split({col}, ' ')[-1] AS INTEGER) IS NOT NULL THEN 'Under Construction'
  ELSE 'Undefined' END"""


def _mode_pass_sql(src: str, keys, dst: str) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"s.{c} = m.{c}" for c in keys)
    return f"""{dst}_m AS (SELECT {k}, age FROM (
  SELECT {k}, age, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, age) AS rn
  FROM {src} WHERE age IS NOT NULL GROUP BY {k}, age) WHERE rn = 1),
{dst} AS (SELECT s.listing_id, s.sector, s.property_type,
  CASE WHEN s.age = 'Undefined' THEN m.age ELSE s.age END AS age FROM {src} s LEFT JOIN {dst}_m m ON {on})"""


@query("q7_mode_impute", fx.with_views(f"""
, p0 AS (SELECT listing_id, CASE WHEN listing_id % 17 = 0 THEN NULL ELSE sector_name END AS sector,
  property_type, {_age_sql('age_possession')} AS age FROM raw),
{_mode_pass_sql('p0', ['sector', 'property_type'], 'p1')},
{_mode_pass_sql('p1', ['sector'], 'p2')},
{_mode_pass_sql('p2', ['property_type'], 'p3')}
SELECT listing_id, age AS agePossession FROM p3""", "raw").replace("\n, p0 AS", ", p0 AS"))
def q7(spark, d):
    r = fx.raw(spark, d)
    base = r.select("listing_id",
                    F.when(F.col("listing_id") % 17 == 0, None).otherwise(F.col("sector_name")).alias("sector"),
                    "property_type", T.categorise_age("age_possession").alias("agePossession"))
    out = Q.mode_impute(base, "agePossession", [("sector", "property_type"), ("sector",), ("property_type",)])
    return out.select("listing_id", "agePossession")


@query("q8_low_quantile_rows", fx.with_views("""
, qv AS (SELECT quantile_cont(area / nullif(bedRoom, 0), 0.02) AS q FROM unit WHERE price_per_sqft <= 1500)
SELECT unit_id, round(area / nullif(bedRoom, 0), 6) AS ratio, round(q, 6) AS ratio_q FROM unit, qv
WHERE area / nullif(bedRoom, 0) < q""", "unit").replace("\n, qv AS", ", qv AS"))
def q8(spark, d):
    out = Q.low_quantile_rows(fx.unit(spark, d), "area", "bedRoom", 0.02, "price_per_sqft", 1500)
    return out.select("unit_id", r6("ratio").alias("ratio"), r6("ratio_q").alias("ratio_q"))
