"""The apartment recommender over the part table: each part's columns are written as the scraped texts of an apartment,
and the oracle starts from the columns, so that parsing is checked too."""

from __future__ import annotations

from plotwise.functions import rules
from plotwise.plans import fixtures as fx
from plotwise.plans import recommender
from plotwise.plans.q_similar import TOP_N, _stored, _with, cosine_dense, tfidf_sql
from plotwise.plans.registry import query

NAME = "apt 1"
#: The texts, one expression each. Every seventh apartment has no readable price details.
APARTMENT_COLS = [
    ("PropertyName", "concat('apt ', CAST(p_partkey AS STRING))"),
    ("TopFacilities", fx._cat(fx._s("['"), "p_type", fx._s(" Hall', '"), "p_brand", fx._s(" Pool', 'Gym "),
                              "CAST(p_size % 5 + 10 AS STRING)", fx._s("']"))),
    ("PriceDetails", "CASE WHEN p_partkey % 7 = 0 THEN 'on request' ELSE " + fx._cat(
        fx._s("{'"), "CAST(p_size % 4 + 1 AS STRING)", fx._s(" BHK': {'building_type': '"),
        "CASE p_size % 3 WHEN 0 THEN 'Apartment' WHEN 1 THEN 'Villa' ELSE 'Floor' END", fx._s("', 'area': '1,"),
        "CAST(p_size + 100 AS STRING)", fx._s(" sq.ft. - 2,"), "CAST(p_size + 200 AS STRING)",
        fx._s(" sq.ft.', 'price-range': '₹ "), "CAST(p_partkey % 90 + 10 AS STRING)", fx._s(" L - "),
        "CAST(p_size % 5 + 1 AS STRING)", fx._s(".5 Cr'}"),
        "CASE WHEN p_partkey % 3 = 0 THEN " + fx._cat(
            fx._s(", 'Land': {'building_type': '"), "CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'Plot' END", fx._s("', 'area': '"),
            "CAST(p_partkey % 700 + 100 AS STRING)", fx._s(" sq.ft.', 'price-range': '₹ 1 Cr'}")) + " ELSE '' END",
        fx._s("}")) + " END"),
    ("LocationAdvantages", fx._cat(
        fx._s("{'Metro "), "CAST(p_partkey % 5 AS STRING)", fx._s("': '"), "CAST(p_size % 9 + 1 AS STRING)", fx._s(".5 Km', 'School "),
        "CAST(p_size % 4 AS STRING)", fx._s("': '"), "CAST(p_partkey % 800 + 50 AS STRING)", fx._s(" Meter', 'Mall': 'near'}"))),
]


def apartments(spark, d):
    return fx.table(spark, d, "part").selectExpr(*[f"{e} AS {a}" for a, e in APARTMENT_COLS])


def stored(spark, d) -> str:
    return _stored(spark, d, "apartments", lambda path: recommender.build(apartments(spark, d), path))


_NAME = "'apt ' || CAST(p_partkey AS VARCHAR)"
_FACILITIES = f"""ap AS (SELECT {_NAME} AS id, p_type || ' Hall ' || p_brand || ' Pool Gym ' || CAST(p_size % 5 + 10 AS VARCHAR) AS txt FROM part)"""
_BHK = "CAST(p_size % 4 + 1 AS VARCHAR) || ' BHK'"
_PRICE = f"""
readable AS (SELECT * FROM part WHERE p_partkey % 7 <> 0),
kinds AS (SELECT {_NAME} AS id, {_BHK} AS cfg, CASE p_size % 3 WHEN 0 THEN 'Apartment' WHEN 1 THEN 'Villa' ELSE 'Floor' END AS kind FROM readable
  UNION ALL SELECT {_NAME}, 'Land', CASE WHEN p_partkey % 2 = 0 THEN 'Land' ELSE 'Plot' END FROM readable WHERE p_partkey % 3 = 0),
pl AS (SELECT {_NAME} AS id, {_BHK} || ' area_low' AS feature, CAST(1000 + p_size + 100 AS DOUBLE) AS value FROM readable
  UNION ALL SELECT {_NAME}, {_BHK} || ' area_high', CAST(2000 + p_size + 200 AS DOUBLE) FROM readable
  UNION ALL SELECT {_NAME}, {_BHK} || ' price_low', (p_partkey % 90 + 10) / CAST(100 AS DOUBLE) FROM readable
  UNION ALL SELECT {_NAME}, {_BHK} || ' price_high', CAST(p_size % 5 + 1 AS DOUBLE) + 0.5 FROM readable
  UNION ALL SELECT {_NAME}, 'Land area_low', CAST(p_partkey % 700 + 100 AS DOUBLE) FROM readable WHERE p_partkey % 3 = 0
  UNION ALL SELECT {_NAME}, 'Land area_high', CAST(p_partkey % 700 + 100 AS DOUBLE) FROM readable WHERE p_partkey % 3 = 0
  UNION ALL SELECT id, k.cfg || ' ' || kind, 1.0 FROM kinds k JOIN (SELECT cfg, min(kind) AS f FROM kinds GROUP BY cfg) m
    ON k.cfg = m.cfg WHERE kind <> f),
pfeats AS (SELECT DISTINCT feature FROM pl),
pdense AS (SELECT {_NAME} AS id, f.feature AS k, coalesce(pl.value, 0.0) AS x FROM part CROSS JOIN pfeats f
  LEFT JOIN pl ON pl.id = {_NAME} AND pl.feature = f.feature)"""
_LOCATION = f"""
lm AS (SELECT {_NAME} AS id, 'Metro ' || CAST(p_partkey % 5 AS VARCHAR) AS k, (p_size % 9 + 1.5) * 1000 AS m FROM part
  UNION ALL SELECT {_NAME}, 'School ' || CAST(p_size % 4 AS VARCHAR), CAST(p_partkey % 800 + 50 AS DOUBLE) FROM part),
lks AS (SELECT DISTINCT k FROM lm),
ldense AS (SELECT {_NAME} AS id, l.k, CAST(coalesce(lm.m, 54000.0) AS DOUBLE) AS x FROM part CROSS JOIN lks l
  LEFT JOIN lm ON lm.id = {_NAME} AND lm.k = l.k)"""
_W = rules.HYBRID_WEIGHTS


def _sql(total: str) -> str:
    return _with(_FACILITIES, tfidf_sql("ap", "id", "txt", "tfa"),
                 f"fac AS (SELECT a.id, sum(a.weight * q.weight) AS score FROM tfa a JOIN (SELECT term, weight FROM tfa WHERE id = '{NAME}') q "
                 "ON a.term = q.term GROUP BY a.id)",
                 _PRICE, cosine_dense("p", "pdense", f"'{NAME}'"), _LOCATION, cosine_dense("l", "ldense", f"'{NAME}'")) + f"""
SELECT '{NAME}' AS query_id, CAST(rk - 1 AS INTEGER) AS rank, id, round(score, 4) AS score FROM (
  SELECT id, score, row_number() OVER (ORDER BY round(score, 10) DESC, id) AS rk FROM (
    SELECT ap.id, {total} AS score FROM ap LEFT JOIN fac f ON ap.id = f.id LEFT JOIN pcos p ON ap.id = p.p_partkey
    LEFT JOIN lcos l ON ap.id = l.p_partkey)) WHERE rk BETWEEN 2 AND {TOP_N + 1}"""


@query("x2_apartment_hybrid", _sql(f"{_W['facilities']} * coalesce(f.score, 0) + {_W['price']} * coalesce(p.score, 0)"
                                   f" + {_W['location']} * coalesce(l.score, 0)"))
def x2_hybrid(spark, d):
    return recommender.recommend(spark, stored(spark, d), [NAME], TOP_N)


@query("x2_apartment_by_price", _sql("coalesce(p.score, 0)"))
def x2_price(spark, d):
    return recommender.recommend(spark, stored(spark, d), [NAME], TOP_N, weights={"price": 1.0})


@query("x2_apartment_by_facilities", _sql("coalesce(f.score, 0)"))
def x2_facilities(spark, d):
    return recommender.recommend(spark, stored(spark, d), [NAME], TOP_N, weights={"facilities": 1.0})
