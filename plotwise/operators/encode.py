"""Feature encoding (survey 2.12, E1-E9).

What is fitted, saved and applied to other rows is in ``stages.py`` (E6). Here
are the one-step forms. Only ``get_dummies`` (E3), whose result has a column
for each category, brings a category list to the driver, checked against
``max_categories``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, CountVectorizer, StandardScaler, VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.operators.joins import grouped_side
from plotwise.operators.stages import CategoryEncoder
from plotwise.session import cut_lineage

MAX_CATEGORIES = 10_000


def categories(df: DataFrame, col: str, max_categories: int = MAX_CATEGORIES) -> list:
    """Sorted distinct non-null values of a categorical column (size-checked)."""
    vals = df.select(col).filter(F.col(col).isNotNull()).distinct().limit(max_categories + 1).collect()
    if len(vals) > max_categories:
        raise ValueError(f"{col} has more than {max_categories} categories; not a categorical column")
    return sorted(r[0] for r in vals)


def ordinal_encode(df: DataFrame, cols, fit_df: DataFrame | None = None, suffix: str = "_idx") -> DataFrame:
    """Categories sorted ascending -> 0..n-1; unknown (or null) -> -1 (one fitted ``CategoryEncoder``)."""
    cols = list(cols)
    out = CategoryEncoder(ordinalCols=cols).fit(fit_df if fit_df is not None else df).transform(df)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"{c}__ord").cast("int").alias(c + suffix) for c in cols])


def dummy_columns(col: str, cats, prefix: str | None = None) -> dict[str, Column]:
    """Drop-first one-hot columns for a known category list; unknown
    or null -> all zeros."""
    prefix = prefix or col
    return {f"{prefix}_{v}": F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)) for v in cats[1:]}


def one_hot_drop_first(df: DataFrame, cols, fit_df: DataFrame | None = None) -> DataFrame:
    """E2/E3 (``get_dummies(drop_first=True)``): category lists from ``fit_df``."""
    fit_df = fit_df if fit_df is not None else df
    exprs = {}
    for c in cols:
        exprs.update(dummy_columns(c, categories(fit_df, c)))
    return df.withColumns(exprs)


def target_encode(df: DataFrame, col: str, target: str, fit_df: DataFrame | None = None,
                  min_samples_leaf: int = 20, smoothing: float = 10.0, out: str | None = None) -> DataFrame:
    """Empirical-Bayes target encoding (Micci-Barreca 2001).

    s = 1/(1 + exp(-(n - k)/f)); enc = s*mean_c + (1 - s)*prior; unknown
    categories get the prior. One grouped aggregate joined back on the key.
    """
    fit_df = fit_df if fit_df is not None else df
    prior = fit_df.agg(F.avg(target)).scalar()
    stats = fit_df.groupBy(col).agg(F.avg(target).alias("__m"), F.count(F.lit(1)).alias("__n"))
    s = 1.0 / (1.0 + F.exp(-(F.col("__n") - min_samples_leaf) / smoothing))
    stats = stats.select(col, (s * F.col("__m") + (1 - s) * prior).alias("__enc"))
    res = df.join(grouped_side(stats), on=col, how="left")
    return res.withColumn(out or f"{col}_te", F.coalesce(F.col("__enc"), prior)).drop("__enc")


def standard_scale(df: DataFrame, cols, fit_df: DataFrame | None = None, ddof: int = 0,
                   suffix: str = "_z") -> DataFrame:
    """E5: (x - mean)/std per column (population std by default, zero
    variance -> 0); statistics from one aggregate used as scalar subqueries."""
    fit_df = fit_df if fit_df is not None else df
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = fit_df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                       *[std(c).alias(f"s_{i}") for i, c in enumerate(cols)])
    exprs = {}
    for i, c in enumerate(cols):
        m, s = stats.select(f"m_{i}").scalar(), stats.select(f"s_{i}").scalar()
        exprs[c + suffix] = F.when(s > 0, (F.col(c) - m) / s).otherwise(F.lit(0.0))
    return df.withColumns(exprs)


def pca_components(df: DataFrame, features_col: str = "features", explained: float = 0.95) -> tuple[PipelineModel, int]:
    """Smallest k whose cumulative explained variance reaches ``explained``
    (one full PCA fit, then the k-component model)."""
    dim = len(df.select(features_col).first()[0])
    full = PCA(k=dim, inputCol=features_col, outputCol="pca").fit(df)
    cum, k = 0.0, dim
    for i, v in enumerate(full.explainedVariance.toArray()):
        cum += float(v)
        if cum >= explained:
            k = i + 1
            break
    model = Pipeline(stages=[PCA(k=k, inputCol=features_col, outputCol="pca")]).fit(df)
    return model, k


def kmeans_labels(df: DataFrame, cols, k: int = 3, seed: int = 42, out: str = "cluster",
                  fit_df: DataFrame | None = None) -> DataFrame:
    """Standardise + k-means; clusters relabelled by ascending mean of the
    summed inputs, so 0 < 1 < 2 is deterministic (e.g. furnishing level).

    The first centres depend on how rows lie in partitions: where ``df`` was
    written on the way, ``fit_df`` names the same rows as they were before."""
    assembler = VectorAssembler(inputCols=list(cols), outputCol="__v")
    vec = assembler.transform(df)
    scaler = StandardScaler(inputCol="__v", outputCol="__z", withMean=True, withStd=True).fit(vec)
    z = scaler.transform(vec)
    start = z if fit_df is None else scaler.transform(assembler.transform(fit_df))
    model = KMeans(k=k, seed=seed, featuresCol="__z", predictionCol="__c").fit(start)
    pred = model.transform(z)
    total = sum(F.col(c) for c in cols)
    order = pred.groupBy("__c").agg(F.avg(total).alias("__m"))
    ranks = order.select("__c", F.row_number().over(Window.orderBy("__m", "__c")).alias("__r"))
    return pred.join(F.broadcast(ranks), on="__c").withColumn(out, F.col("__r") - 1).drop("__v", "__z", "__c", "__r")


def elbow(df: DataFrame, cols, k_max: int = 10, seed: int = 42) -> DataFrame:
    """Within-cluster sum of squares for k = 1..k_max on standardised columns."""
    vec = VectorAssembler(inputCols=list(cols), outputCol="__v").transform(df)
    z = StandardScaler(inputCol="__v", outputCol="__z", withMean=True, withStd=True).fit(vec).transform(vec)
    return elbow_vectors(z, "__z", k_max, seed)


def label_matrix(df: DataFrame, list_col: str, out: str = "labels", max_labels: int = 1 << 18) -> tuple[DataFrame, list[str]]:
    """The sparse 0/1 matrix of a column of label lists, over the labels that the data hold (most frequent first),
    and their names. Null and empty lists are empty rows."""
    lists = df.withColumn("__l", F.coalesce(F.array_distinct(list_col), F.array().cast("array<string>")))
    model = CountVectorizer(inputCol="__l", outputCol=out, binary=True, vocabSize=max_labels).fit(lists)
    return model.transform(lists).drop("__l"), list(model.vocabulary)


def elbow_vectors(df: DataFrame, features_col: str, k_max: int = 10, seed: int = 42) -> DataFrame:
    """E9 on vectors (k = 1 is the total sum of squares, which MLlib's KMeans rejects)."""
    # written, not persisted: of a persisted table each step of each fit decodes all vectors again, while of others a
    # fit reads them once and keeps them as it needs them
    z = cut_lineage(df.select(F.col(features_col).alias("__z")))
    var = z.select(Summarizer.variance(F.col("__z")).alias("v"), F.count(F.lit(1)).alias("n")).first()
    rows = [(1, float(sum(var["v"].toArray()) * (var["n"] - 1)))]
    for k in range(2, k_max + 1):
        m = KMeans(k=k, seed=seed, featuresCol="__z").fit(z)
        rows.append((k, float(m.summary.trainingCost)))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")
