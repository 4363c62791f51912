"""String parsing as Column expressions (survey 2.5). No Python UDFs.

Under ANSI mode ``arr[i]`` out of range and ``cast('x' as double)`` throw,
so every lookup is ``get``/``element_at`` with ``try_`` casts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from plotwise.functions import rules
from plotwise.functions.numeric import col_, half_even, safe_div

# Python's str.strip() removes any whitespace, Spark's trim() only spaces.
# The characters Java's \s matches; trimming them equals the regex strip.
_WS_CHARS = " \t\n\r\x0b\x0c"


def strip_ws(c) -> Column:
    """Python ``str.strip()`` for ASCII whitespace, without a regex."""
    return F.trim(col_(c), F.lit(_WS_CHARS))


def first_token(c, sep: str = " ") -> Column:
    return F.get(F.split(col_(c), sep), 0)


def clean_society(c, null_as: str | None = None) -> Column:
    """Drop a trailing rating like ``4.2 ★``, strip, lower-case.

    A null stays null unless ``null_as`` is given (whole-value replacement;
    the reference's substring replacement of ``nan`` corrupts names).
    """
    out = F.lower(strip_ws(F.regexp_replace(col_(c), r"\d+(\.\d+)?\s?★", "")))
    return F.coalesce(out, F.lit(null_as)) if null_as is not None else out


def parse_price(c, lac_unit: str = "Lac", lac_per_crore: int = rules.LAC_PER_CRORE) -> Column:
    """``85 Lac`` -> 0.85, ``1.25 Crore`` -> 1.25 (crore, half-even 2 dp)."""
    parts = F.split(col_(c), " ")
    value = F.get(parts, 0).try_cast("double")
    unit = F.get(parts, 1)
    return half_even(F.when(unit == lac_unit, value / float(lac_per_crore)).otherwise(value), 2)


def parse_rate(c) -> Column:
    """``₹ 8,500/sq.ft.`` -> 8500.0."""
    head = F.split_part(col_(c), F.lit("/"), F.lit(1))
    return strip_ws(F.translate(head, "₹,", "")).try_cast("double")


def leading_int(c) -> Column:
    """T4: ``3 Bedrooms`` -> 3."""
    return first_token(c).try_cast("int")


def balcony(c) -> Column:
    """T5: first token, ``No`` -> ``0``; stays a string because of ``3+``."""
    return F.replace(first_token(c), F.lit("No"), F.lit("0"))


def floor_number(c, signed: bool = False, kind: str = "flat") -> Column:
    """First token; Ground/Lower -> 0, Basement -> -1, then the first
    run of digits. The digit extract drops the sign, so Basement reads 1
    unless ``signed`` is set. Houses keep the first token as a number."""
    tok = first_token(c)
    if kind == "house":
        return tok.try_cast("double")
    tok = F.when(tok == "Ground", F.lit("0")).otherwise(tok)
    tok = F.replace(F.replace(tok, F.lit("Basement"), F.lit("-1")), F.lit("Lower"), F.lit("0"))
    pattern = r"(-?\d+)" if signed else r"(\d+)"
    return F.nullif(F.regexp_extract(tok, pattern, 1), F.lit("")).try_cast("double")


def extract_locality(c, city: str = rules.CITY_NAME, sep: str = "in") -> Column:
    """Text after the first literal ``in``, city removed, stripped, lower."""
    piece = F.get(F.split(col_(c), sep), 1)
    return F.lower(strip_ws(F.replace(piece, F.lit(city), F.lit(""))))


def apply_replacements(c, rule_list) -> Column:
    """Ordered literal substring replacements, folded left to right."""
    return reduce(lambda acc, r: F.replace(acc, F.lit(r[0]), F.lit(r[1])), rule_list, col_(c))


def _num_pattern(label: str) -> str:
    return label + r"\s*:\s*(\d+\.?\d*)"


def extract_number(c, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(col_(c), pattern, 1), F.lit("")).try_cast("double")


def super_built_up(c) -> Column:
    """``Super Built up area 1800`` -> 1800."""
    return extract_number(c, r"Super Built up area (\d+\.?\d*)")


def built_up(c) -> Column:
    """``Built Up area: 1600`` -> 1600."""
    return extract_number(c, _num_pattern("Built Up area"))


def carpet(c) -> Column:
    """``Carpet area: 1400`` -> 1400."""
    return extract_number(c, _num_pattern("Carpet area"))


def plot_area(c) -> Column:
    """``Plot area 240`` -> 240."""
    return extract_number(c, r"Plot area (\d+\.?\d*)")


def to_sqft(text, value, factor: float = rules.SQFT_PER_SQM) -> Column:
    """If the text reads ``<value> (<x> sq.m.)`` return x * factor.

    The value is printed as a float (``1800.0``), so an integer in the text
    rarely matches. One constant pattern finds all pairs; the first whose value
    is the given one counts.
    """
    v = col_(value)
    found = [F.regexp_extract_all(col_(text), F.lit(rules.SQM_PATTERN), F.lit(i)) for i in (1, 2)]
    sqm = F.get(found[1], (F.array_position(found[0], v.cast("string")) - 1).cast("int"))
    return F.when(v.isNull(), None).when(sqm.isNotNull(), sqm.try_cast("double") * factor).otherwise(v)


def convert_plot_scale(area, plot, scale: dict = rules.PLOT_SCALE) -> Column:
    """Ratio area/plot rounded half-even; 9 -> x9, 11 -> x10.7."""
    ratio = half_even(safe_div(area, plot), 0)
    out = F.when(F.lit(False), None)
    for k, mult in scale.items():
        out = out.when(ratio == float(k), col_(plot) * mult)
    return out.otherwise(col_(plot))


def contains_flags(c, labels) -> dict:
    """One 0/1 column per label (substring test, null -> 0)."""
    return {lab: F.coalesce(col_(c).contains(lab).cast("int"), F.lit(0)) for lab in labels}


def categorise_age(c, rule_list=rules.AGE_RULES, undefined: str = rules.AGE_UNDEFINED,
                   dated: str = rules.AGE_DATED) -> Column:
    """Ordered substring rules; a trailing integer (``May 2024``) is a
    future date; anything else and null are ``Undefined``."""
    x = col_(c)
    out = F.when(x.isNull(), F.lit(undefined))
    for needles, label in rule_list:
        cond = reduce(lambda a, b: a | b, [x.contains(n) for n in needles])
        out = out.when(cond, F.lit(label))
    last = F.element_at(F.split(x, " "), -1)
    return out.when(last.try_cast("int").isNotNull(), F.lit(dated)).otherwise(F.lit(undefined))


def furnishing_items(c) -> Column:
    """T14 vocabulary step: the item names of one furnish list (``No``/digits removed)."""
    raw = F.split(F.translate(col_(c), "[]'", ""), ", ")
    return F.filter(F.transform(raw, lambda t: strip_ws(F.regexp_replace(t, r"No |\d+", ""))),
                    lambda t: t != "")


def item_count(c, item: str) -> Column:
    """``No X`` -> 0, ``<n> X`` -> n, mentioned -> 1, else 0 (null -> 0)."""
    x = col_(c)
    n = F.nullif(F.regexp_extract(x, r"(\d+) " + item, 1), F.lit("")).try_cast("int")
    return (F.when(x.isNull(), 0).when(x.contains("No " + item), 0)
            .when(n.isNotNull(), n).when(x.contains(item), 1).otherwise(0))


def parse_list(c) -> Column:
    """``['a', 'b']`` -> array('a', 'b'); null -> empty array."""
    return F.coalesce(F.regexp_extract_all(col_(c), F.lit(r"'(.*?)'"), F.lit(1)), F.array())


PRICE_DETAIL_SCHEMA = "map<string, struct<building_type: string, area: string, `price-range`: string>>"


def price_details_map(c) -> Column:
    """The nested single-quoted dict as a map; bad input -> empty map."""
    m = F.from_json(col_(c), PRICE_DETAIL_SCHEMA, {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    return F.coalesce(m, F.create_map().cast("map<string, struct<building_type: string, area: string, `price-range`: string>>"))


def _area_num(part: Column) -> Column:
    return strip_ws(F.replace(F.replace(part, F.lit(","), F.lit("")), F.lit(" sq.ft."), F.lit(""))).try_cast("double")


def _price_num(part: Column) -> Column:
    cleaned = F.replace(F.replace(F.replace(part, F.lit("₹"), F.lit("")), F.lit(" Cr"), F.lit("")), F.lit(" L"), F.lit(""))
    v = strip_ws(cleaned).try_cast("double")
    return F.when(part.contains("L"), v / 100.0).otherwise(v)


def config_facts(detail: Column) -> dict:
    """T16 per configuration: building type, area low/high, price low/high
    (single-expression form; ``config_facts_df`` stages the same rules)."""
    area = F.coalesce(detail.getField("area"), F.lit(""))
    ap = F.split(area, "-")
    a0, a1 = _area_num(F.get(ap, 0)), _area_num(F.get(ap, 1))
    return _facts(detail.getField("building_type"), F.size(ap), a0, a1,
                  F.split(F.coalesce(detail.getField("price-range"), F.lit("")), "-"))


def _facts(building_type, n_area, a0, a1, pp) -> dict:
    one = n_area == 1
    two_ok = (n_area == 2) & a0.isNotNull() & a1.isNotNull()
    p0, p1 = _price_num(F.get(pp, 0)), _price_num(F.get(pp, 1))
    p_ok = (F.size(pp) == 2) & p0.isNotNull() & p1.isNotNull()
    return {
        "building_type": building_type,
        "area_low": F.when(one, a0).when(two_ok, a0), "area_high": F.when(one, a0).when(two_ok, a1),
        "price_low": F.when(p_ok, p0), "price_high": F.when(p_ok, p1),
    }


def config_facts_df(df, struct_col: str, keep) -> "DataFrame":
    """T16 on a DataFrame: parse each part once in its own projection, then
    apply the rules, so no string function is evaluated twice per row."""
    out = config_facts_wide(df, {"": F.col(struct_col)}, keep)
    return out


def config_facts_wide(df, structs: dict, keep) -> "DataFrame":
    """T16/T17 for several structs at once (``{prefix: struct Column}``):
    three staged projections (split, numbers, rules); outputs
    ``{prefix}building_type``, ``{prefix}area_low`` ... per prefix."""
    s1 = df.select(*keep, *[c for p, v in structs.items() for c in (
        v.getField("building_type").alias(f"{p}building_type"),
        F.split(F.coalesce(v.getField("area"), F.lit("")), "-").alias(f"__{p}ap"),
        F.split(F.coalesce(v.getField("price-range"), F.lit("")), "-").alias(f"__{p}pp"))])
    s2 = s1.select(*keep, *[c for p in structs for c in (
        F.col(f"{p}building_type"), F.size(f"__{p}ap").alias(f"__{p}na"),
        _area_num(F.get(F.col(f"__{p}ap"), 0)).alias(f"__{p}a0"),
        _area_num(F.get(F.col(f"__{p}ap"), 1)).alias(f"__{p}a1"),
        F.size(f"__{p}pp").alias(f"__{p}np"), F.get(F.col(f"__{p}pp"), 0).alias(f"__{p}pp0"),
        F.get(F.col(f"__{p}pp"), 1).alias(f"__{p}pp1"))])
    s3 = s2.select(*keep, *[c for p in structs for c in (
        F.col(f"{p}building_type"), F.col(f"__{p}na"), F.col(f"__{p}a0"), F.col(f"__{p}a1"),
        F.col(f"__{p}np"), _price_num(F.col(f"__{p}pp0")).alias(f"__{p}p0"),
        _price_num(F.col(f"__{p}pp1")).alias(f"__{p}p1"))])
    cols = []
    for p in structs:
        one = F.col(f"__{p}na") == 1
        two_ok = (F.col(f"__{p}na") == 2) & F.col(f"__{p}a0").isNotNull() & F.col(f"__{p}a1").isNotNull()
        p_ok = (F.col(f"__{p}np") == 2) & F.col(f"__{p}p0").isNotNull() & F.col(f"__{p}p1").isNotNull()
        cols += [F.col(f"{p}building_type"),
                 F.when(one, F.col(f"__{p}a0")).when(two_ok, F.col(f"__{p}a0")).alias(f"{p}area_low"),
                 F.when(one, F.col(f"__{p}a0")).when(two_ok, F.col(f"__{p}a1")).alias(f"{p}area_high"),
                 F.when(p_ok, F.col(f"__{p}p0")).alias(f"{p}price_low"),
                 F.when(p_ok, F.col(f"__{p}p1")).alias(f"{p}price_high")]
    return s3.select(*keep, *cols)


def distance_to_meters(c) -> Column:
    """``1.5 Km`` -> 1500, ``800 Meter`` -> 800, else null."""
    x = col_(c)
    v = F.get(F.split(strip_ws(x), r"\s+"), 0).try_cast("double")
    km = reduce(lambda a, b: a | b, [x.contains(w) for w in rules.KM_WORDS])
    m = reduce(lambda a, b: a | b, [x.contains(w) for w in rules.METER_WORDS])
    return F.when(km, v * 1000.0).when(m, v)


def parse_coordinates(c) -> tuple[Column, Column]:
    """``28.3663° N, 76.9456° E`` -> (28.3663, 76.9456)."""
    x = col_(c)
    lat = extract_number(F.split_part(x, F.lit(","), F.lit(1)), r"(\d+\.?\d*)")
    lon = extract_number(F.split_part(x, F.lit(","), F.lit(2)), r"(\d+\.?\d*)")
    return lat, lon


def locality_number(c) -> Column:
    """First integer in the name, +inf when none (a sort key)."""
    n = F.nullif(F.regexp_extract(col_(c), r"(\d+)", 1), F.lit("")).try_cast("double")
    return F.coalesce(n, F.lit(float("inf")))


def join_list(c, sep: str = " ") -> Column:
    """Array -> text."""
    return F.array_join(col_(c), sep)


# Word tokens: runs of two or more letters/digits/underscore (Unicode-aware,
# the same class in Java regex and RE2).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(c, pattern: str = TOKEN_PATTERN) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(col_(c)), F.lit(pattern), F.lit(0)), F.array())


def bigrams(arr: Column) -> Column:
    """Adjacent pairs of an array, joined by a space."""
    tail = F.slice(arr, 2, F.greatest(F.size(arr) - 1, F.lit(0)))
    return F.transform(tail, lambda x, i: F.concat(F.get(arr, i), F.lit(" "), x))
