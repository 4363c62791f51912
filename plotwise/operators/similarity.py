"""Similarity and recommendation (survey 2.11) as sparse joins.

No n x n matrix and no cross join. Vectors are long tables
``(id, key, value)``; a recommendation scores *one* query item against
every candidate by joining on the query's keys (a bounded set: one item's
terms or landmarks), so the work is linear in the candidates. AQE turns
that join into a broadcast at run time once it has measured the query side.

Standardised views (R4-R6) stay sparse too: an entity that lacks a key
takes a default ``x0`` (54 000 m, or 0 for a one-hot column), so its
z-score is ``z0 = (x0 - mean)/std`` plus a sparse delta. Then
``dot(a, b) = sum z0^2 + sum_a d*z0 + sum_b d*z0 + sum_{a and b} d_a*d_b``
exactly, with only per-entity and per-key aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plotwise.functions import rules
from plotwise.functions.text import TOKEN_PATTERN, bigrams, tokens
from plotwise.operators.joins import grouped_side
from plotwise.session import cut_lineage


def default_stop_words() -> list[str]:
    """The English stop-word list of ``StopWordsRemover`` (a parameter of ``tfidf``)."""
    return list(rules.ENGLISH_STOP_WORDS)


def terms(df: DataFrame, id_col: str, text_col: str, stop_words=None, ngram_max: int = 2,
          pattern: str = TOKEN_PATTERN) -> DataFrame:
    """Long ``(id, term)`` rows: lower-cased tokens, stop words removed
    *before* forming bigrams (as the reference's vectoriser does)."""
    stops = list(stop_words if stop_words is not None else default_stop_words())
    # ``isin`` over literals is planned as InSet (a hash set): O(1) per token,
    # where array_contains on a literal array scans the whole list per token
    toks = F.filter(tokens(text_col, pattern), lambda t: ~t.isin(stops)) if stops else tokens(text_col, pattern)
    # the explicit null filter keeps every consumer of this subtree identical,
    # so the planner reuses one tokenisation/aggregation exchange for all of them
    t = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col), toks.alias("__t"))
    grams = F.col("__t")
    if ngram_max >= 2:
        grams = F.concat(F.col("__t"), bigrams(F.col("__t")))
    return t.select(id_col, F.explode(grams).alias("term"))


def tfidf(df: DataFrame, id_col: str, text_col: str, stop_words=None, ngram_max: int = 2,
          pattern: str = TOKEN_PATTERN, materialize: bool = True) -> DataFrame:
    """Smoothed tf-idf with an L2 row norm, long form ``(id, term, weight)``.

    tf = raw count; idf = ln((1+n)/(1+df)) + 1; weight = tf*idf / ||row||.
    Shuffles: the texts by id (the (id, term) counts then need none), term
    document frequencies (partial aggregate), and the row norms (a grouped
    sum joined back on the id).
    """
    n_docs = df.select(F.count(F.lit(1))).scalar()
    # Shuffle the raw texts by id once: hash partitioning on the id already
    # satisfies the (id, term) aggregate, so the exploded grams (several times
    # the text volume) are counted in place and never cross the network.
    by_doc = df.select(id_col, text_col).repartition(id_col)
    tf = terms(by_doc, id_col, text_col, stop_words, ngram_max, pattern).groupBy(id_col, "term").agg(
        F.count(F.lit(1)).alias("tf"))
    if materialize:
        # tf feeds three consumers (document frequency, weights, norms) whose
        # pruned plans differ, so the planner cannot share one exchange: write
        # it once to the shared checkpoint folder instead of tokenising 3x
        tf = cut_lineage(tf)
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = tf.join(dfreq, on="term").select(
        id_col, "term", (F.col("tf") * (F.log((1 + n_docs) / (1 + F.col("df"))) + 1)).alias("raw"))
    # row norms: one grouped sum per document joined back (AQE broadcasts the
    # norms while they are small and falls back to a sort-merge join beyond)
    norms = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("__norm"))
    return w.join(norms, on=id_col).select(id_col, "term", (F.col("raw") / F.col("__norm")).alias("weight"))


def term_counts(df: DataFrame, id_col: str, text_col: str, stop_words=None, ngram_max: int = 2,
                pattern: str = TOKEN_PATTERN) -> DataFrame:
    """(id, term, tf) for every text, written once to the checkpoint folder
    (texts shuffled by id first, so the counts need no further shuffle)."""
    by_doc = df.select(id_col, text_col).repartition(id_col)
    tf = terms(by_doc, id_col, text_col, stop_words, ngram_max, pattern).groupBy(id_col, "term").agg(
        F.count(F.lit(1)).alias("tf"))
    return cut_lineage(tf)


def tfidf_query_scores(df: DataFrame, id_col: str, text_col: str, query_id, stop_words=None,
                       ngram_max: int = 2, pattern: str = TOKEN_PATTERN) -> DataFrame:
    """R1+R2 for one query text: the cosine of every text with the query,
    without materialising all weights. Needs the document frequencies and
    the row norms (one pass over the term counts) and the dot products over
    the query's terms only (a semi-join with one text's term list)."""
    n_docs = df.select(F.count(F.lit(1))).scalar()
    tf = term_counts(df, id_col, text_col, stop_words, ngram_max, pattern)
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((1 + n_docs) / (1 + F.col("df"))) + 1
    raw = tf.join(dfreq, on="term").select(id_col, "term", (F.col("tf") * idf).alias("raw"))
    norms = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("__norm"))
    q = raw.filter(F.col(id_col) == query_id).select("term", F.col("raw").alias("__q"))
    qnorm = norms.filter(F.col(id_col) == query_id).select(F.max("__norm")).scalar()
    shared = tf.join(q.select("term"), on="term", how="left_semi").join(dfreq, on="term").select(
        id_col, "term", (F.col("tf") * idf).alias("raw"))
    dots = shared.join(q, on="term").groupBy(id_col).agg(F.sum(F.col("raw") * F.col("__q")).alias("__dot"))
    return dots.join(norms, on=id_col).select(id_col, (F.col("__dot") / (F.col("__norm") * qnorm)).alias("score"))


def sparse_scores(vectors: DataFrame, id_col: str, query_id, key: str = "term",
                  value: str = "weight") -> DataFrame:
    """R2: dot product of every row with the query row (normalised rows ->
    cosine). Rows sharing no key are absent (score 0)."""
    q = vectors.filter(F.col(id_col) == query_id).select(key, F.col(value).alias("__q"))
    return vectors.join(q, on=key).groupBy(id_col).agg(F.sum(F.col(value) * F.col("__q")).alias("score"))


def sparse_pairs(vectors: DataFrame, id_col: str, queries: DataFrame, key: str = "term",
                 value: str = "weight") -> DataFrame:
    """R2 for a set of query ids: ``(query_id, id, score)`` for every pair that
    shares a key. Use for bounded query sets (the work is |queries| x df)."""
    q = vectors.join(queries.select(F.col(id_col)), on=id_col, how="left_semi").select(
        F.col(id_col).alias("query_id"), key, F.col(value).alias("__q"))
    return vectors.join(q, on=key).groupBy("query_id", id_col).agg(
        F.sum(F.col(value) * F.col("__q")).alias("score"))


def standardise_long(long_df: DataFrame, entities: DataFrame, id_col: str, key: str, value: str,
                     default: float) -> tuple[DataFrame, DataFrame]:
    """R4 on a sparse table: per key mean and population std over *all*
    entities (missing entries = ``default``); returns per-key ``z0`` and the
    per-entry deltas ``d = (x - default)/std`` (zero variance -> 0)."""
    n = entities.select(F.count(F.lit(1))).scalar()
    dd = long_df.select(id_col, key, (F.col(value) - default).alias("__d"))
    # the present values' mean and variance, combined with the n - c defaults (whose d is 0)
    stats = dd.groupBy(key).agg(F.count("__d").alias("c"), F.avg("__d").alias("m"), F.var_pop("__d").alias("v"))
    part = F.col("c") / n
    mean_d = F.col("m") * part
    var = F.col("v") * part + F.col("m") * F.col("m") * part * (1 - part)
    std = F.sqrt(var)
    # a row for each key, computed once and broadcast: the entries are not shuffled by their few keys
    stats = grouped_side(stats.select(key, std.alias("std"), F.when(std > 0, (-mean_d) / std).otherwise(0.0).alias("z0")))
    deltas = dd.join(stats, on=key).select(
        id_col, key, F.when(F.col("std") > 0, F.col("__d") / F.col("std")).otherwise(0.0).alias("d"), "z0")
    return stats, deltas


def standardised_cosine(long_df: DataFrame, entities: DataFrame, id_col: str, key: str, value: str,
                        default: float, query_id) -> DataFrame:
    """Cosine of the query entity against all entities on standardised
    features, exact, without materialising the dense matrix."""
    stats, deltas = standardise_long(long_df, entities, id_col, key, value, default)
    # the deltas feed four consumers (norms, query row, overlap, z0 sum):
    # written once to the checkpoint folder rather than rebuilt per consumer
    deltas = cut_lineage(deltas)
    s0 = deltas.select(key, "z0").dropDuplicates([key]).select(F.sum(F.col("z0") * F.col("z0"))).scalar()
    per = deltas.groupBy(id_col).agg(F.sum(F.col("d") * F.col("z0")).alias("p"),
                                     F.sum(F.col("d") * F.col("d")).alias("qq"))
    qd = deltas.filter(F.col(id_col) == query_id).select(key, F.col("d").alias("__dq"))
    cross = deltas.join(qd, on=key).groupBy(id_col).agg(F.sum(F.col("d") * F.col("__dq")).alias("c"))
    qrow = per.filter(F.col(id_col) == query_id)
    pq = F.coalesce(qrow.select(F.sum("p")).scalar(), F.lit(0.0))
    qq = F.coalesce(qrow.select(F.sum("qq")).scalar(), F.lit(0.0))
    base = (entities.select(id_col).join(per, on=id_col, how="left").join(cross, on=id_col, how="left")
            .fillna(0.0, subset=["p", "qq", "c"]))
    dot = s0 + pq + F.col("p") + F.col("c")
    norm_b = F.sqrt(F.greatest(s0 + 2 * F.col("p") + F.col("qq"), F.lit(0.0)))
    norm_q = F.sqrt(F.greatest(s0 + 2 * pq + qq, F.lit(0.0)))
    score = F.when((norm_b > 0) & (norm_q > 0), dot / (norm_b * norm_q)).otherwise(0.0)
    return base.select(id_col, score.alias("score"))


def one_hot_long(df: DataFrame, id_col: str, cat_cols, num_cols) -> DataFrame:
    """Long ``(id, feature, value)`` of numeric columns plus drop-first
    one-hot columns (first = smallest category; null -> all zeros)."""
    parts = []
    for c in num_cols:
        parts.append(df.select(id_col, F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                     .filter(F.col("value").isNotNull()))
    for c in cat_cols:
        first = df.agg(F.min(c)).scalar()
        parts.append(df.filter(F.col(c).isNotNull() & (F.col(c) != first)).select(
            id_col, F.concat(F.lit(c + "_"), F.col(c)).alias("feature"), F.lit(1.0).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numeric_long(df: DataFrame, id_col: str, num_cols, fill: float = 0.0) -> DataFrame:
    """Numeric columns with ``fillna(fill)`` semantics; missing -> default."""
    return one_hot_long(df, id_col, [], num_cols)


def dense_standardised_cosine(df: DataFrame, id_col: str, vec_col: str, query_id) -> DataFrame:
    """R4+R6 on an array column: per-dimension mean/population std from one
    aggregate over (position, value) pairs, z-scores, cosine with the query
    vector (a scalar subquery). No join with the candidates."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    base = df.select(id_col, v.alias("__v"))
    stats = (base.select(F.posexplode("__v").alias("pos", "x")).groupBy("pos")
             .agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", "m", "s"))).alias("st")))
    # scalar subqueries cannot sit inside higher-order functions: project
    # them as columns first (each is evaluated once and broadcast as a value)
    base = base.withColumn("__st", stats.select("st").scalar())
    z = F.zip_with(F.col("__v"), F.col("__st"), lambda x, s: F.when(s["s"] > 0, (x - s["m"]) / s["s"]).otherwise(0.0))
    zdf = base.select(id_col, z.alias("z"))
    zdf = zdf.withColumn("__qz", zdf.filter(F.col(id_col) == query_id).select("z").scalar())
    qz = F.col("__qz")

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    na, nq = F.sqrt(dot(F.col("z"), F.col("z"))), F.sqrt(dot(qz, qz))
    score = F.when((na > 0) & (nq > 0), dot(F.col("z"), qz) / (na * nq)).otherwise(0.0)
    return zdf.select(id_col, score.alias("score"))


def recommend(scores: DataFrame, items: DataFrame, id_col: str, n: int = 5, query_id=None,
              exclude_self: bool = False, digits: int | None = 4, rank_digits: int = 10) -> DataFrame:
    """Rank every item by score (desc, ties by id, missing score 0), skip
    rank 1 (assumed to be the item itself) and return the next ``n``.

    Scores are compared at ``rank_digits`` decimals, so two items with the
    same vector tie exactly whatever the summation order, and the id breaks
    the tie (the reference's stable sort keeps index order). ``exclude_self``
    removes the query id exactly instead. The ranking is a per-partition
    top-(n+1) (TakeOrdered), no full sort.
    """
    allv = items.select(id_col).join(scores, on=id_col, how="left").fillna(0.0, subset=["score"])
    allv = allv.withColumn("__key", F.round("score", rank_digits))
    order = [F.desc("__key"), F.asc(id_col)]
    if exclude_self:
        top = allv.filter(F.col(id_col) != query_id).orderBy(*order).limit(n)
        first = 1
    else:
        top = allv.orderBy(*order).limit(n + 1)
        first = 2
    out = top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).filter(F.col("rank") >= first)
    out = out.withColumn("rank", F.col("rank") - (first - 1))
    if digits is not None:
        out = out.withColumn("score", F.round("score", digits))
    return out.select("rank", id_col, "score")


VIEWS = ("facilities", "price", "location")


def recommend_by(view: str, views: dict, items: DataFrame, id_col: str, query_id, n: int = 5) -> DataFrame:
    """Dispatch on the view name; unknown view is an error, n in 1..20,
    unknown query id -> empty result."""
    if view not in views:
        raise ValueError(f"unknown view {view!r}; expected one of {sorted(views)}")
    if not 1 <= n <= 20:
        raise ValueError("n must be within 1..20")
    known = items.filter(F.col(id_col) == query_id).select(F.count(F.lit(1))).scalar()
    return recommend(views[view], items, id_col, n).filter(known > 0)


def hybrid_scores(views: dict, weights: dict = rules.HYBRID_WEIGHTS, id_col: str = "id") -> DataFrame:
    """Weighted sum of the view scores (full outer join, missing -> 0)."""
    out = None
    for name, df in views.items():
        s = df.select(id_col, F.col("score").alias(f"s_{name}"))
        out = s if out is None else out.join(s, on=id_col, how="full_outer")
    total = sum(F.coalesce(F.col(f"s_{k}"), F.lit(0.0)) * float(weights[k]) for k in views)
    return out.select(id_col, total.alias("score"))


def weighted_label_score(labels_col, weights: dict = rules.LUXURY_WEIGHTS):
    """Sum of the weights of the distinct listed labels; unknown labels
    count 0, empty or null list -> 0. A literal map inside the expression:
    no join, no shuffle."""
    from plotwise.functions.recode import map_literal
    wmap = map_literal({k: float(v) for k, v in weights.items()})
    arr = F.coalesce(F.array_distinct(labels_col), F.array())
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.coalesce(F.try_element_at(wmap, x), F.lit(0.0)))
