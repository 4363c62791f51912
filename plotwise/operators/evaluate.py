"""Model evaluation, importance and scoring (survey 2.13, V1-V10)."""

from __future__ import annotations

import math
import random

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoderModel, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, functions as F

from plotwise.functions import rules
from plotwise.operators import aggregates as A
from plotwise.operators import nulls as D
from plotwise.operators.quantiles import exact_quantile
from plotwise.operators.prefix import global_rank
from plotwise.operators.stages import CategoryEncoderModel, ColumnScalerModel, DropColumns
from plotwise.session import cut_lineage


def regression_metrics(df: DataFrame, label: str = "label", pred: str = "prediction", n_features: int | None = None,
                       log_target: bool = True) -> DataFrame:
    """V1: one aggregate over (y, y_hat): R² on the model (log) scale, adjusted
    R², and MAE/MSE/RMSE/MAPE/median-AE on the original scale (expm1)."""
    y, p = F.col(label), F.col(pred)
    yo, po = (F.expm1(y), F.expm1(p)) if log_target else (y, p)
    n = F.count(F.lit(1))
    ss_res = F.sum((y - p) * (y - p))
    # total sum of squares as n * population variance: one stable aggregate
    ss_tot = F.var_pop(y) * n
    ae = F.abs(yo - po)
    out = df.agg(
        n.alias("n"),
        (1 - ss_res / ss_tot).alias("r2"),
        F.avg(ae).alias("mae"),
        F.avg((yo - po) * (yo - po)).alias("mse"),
        (F.avg(F.abs(F.try_divide(yo - po, yo))) * 100).alias("mape"),
    ).withColumn("median_ae", exact_quantile(df, ae)).withColumn("rmse", F.sqrt("mse"))
    if n_features is not None:
        out = out.withColumn("adj_r2", 1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - n_features - 1))
    return out


def residuals(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """V2: residual and absolute percentage error per row."""
    return df.withColumn("residual", F.col(label) - F.col(pred)).withColumn(
        "ape", F.abs(F.try_divide(F.col(label) - F.col(pred), F.col(label))) * 100)


def residual_histogram(df: DataFrame, nbins: int = 50) -> DataFrame:
    """V2: histogram of the residuals."""
    return A.histogram(df, "residual", nbins)


def tree_importance(model, names) -> list[tuple]:
    """V3: (feature, importance, share %) sorted descending."""
    imp = model.featureImportances.toArray()
    total = float(sum(imp)) or 1.0
    rows = [(n, float(v), 100.0 * float(v) / total) for n, v in zip(names, imp)]
    return sorted(rows, key=lambda r: (-r[1], r[0]))


class _CodedTrees(NamedTuple):
    """A fitted pipeline of encoders and trees: the inputs of its vector as one code each (a one-hot block is the place of
    its one), the raw column that each comes from, and the trees over the codes."""

    encoders: list
    inputs: list[str]
    sources: list[str]
    trees: list


def _coded_trees(model) -> _CodedTrees | None:
    """``model`` in this form, or None if it is anything else."""
    if not isinstance(model, PipelineModel) or not model.stages:
        return None
    *before, last = model.stages
    encoders = [x for x in before if isinstance(x, (ColumnScalerModel, CategoryEncoderModel))]
    assemblers = [x for x in before if isinstance(x, VectorAssembler)]
    known = (ColumnScalerModel, CategoryEncoderModel, OneHotEncoderModel, VectorAssembler, DropColumns)
    if (not all(isinstance(x, known) for x in before) or len(assemblers) != 1
            or not isinstance(last, (DecisionTreeRegressionModel, RandomForestRegressionModel))):
        return None
    source, width = {}, {}
    for x in encoders:
        if isinstance(x, ColumnScalerModel):
            source |= {c + x.getOrDefault("suffix"): c for c in x.getOrDefault("inputCols")}
            continue
        for c in x.category_columns():
            source |= {c + "__ord": c, c + "__te": c, c + "__hot": c}
            width[c + "__hot"] = max(x.sizes[c][0], 2) - 1
    names, places = assemblers[0].getInputCols(), []
    for j, c in enumerate(names):
        places += [(j, at) for at in range(width[c])] if c in width else [(j, -1)]

    def read(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return float(node.prediction())
        split = node.split()
        if split.getClass().getSimpleName() == "ContinuousSplit":
            how = (float(split.threshold()), None)
        else:
            how = (0.0, tuple(float(v) for v in split.leftCategories()))
        return (*places[split.featureIndex()], *how, read(node.leftChild()), read(node.rightChild()))

    trees = last.trees if isinstance(last, RandomForestRegressionModel) else [last]
    inputs = [c.removesuffix("__hot") + "__slot" if c in width else c for c in names]
    return _CodedTrees(encoders, inputs, [source.get(c, c) for c in names], [read(t._java_obj.rootNode()) for t in trees])


def _tree_errors(trees: list, m: int, takes: list | None):
    """For each task: (k, r, summed squared error) of rows of r, y, ``m`` codes and ``m`` codes of the donor, with the codes
    in ``takes[k]`` from the donor, for every k; without ``takes``, of rows without a donor, as k = -1."""
    def score(tree, cols, at, out):
        if isinstance(tree, float):
            out[at] += tree
            return
        j, place, threshold, left, yes, no = tree
        x = cols[j][at]
        if place >= 0:
            x = (x == place).astype(float)
        goes = x <= threshold if left is None else np.isin(x, left)
        score(yes, cols, at[goes], out)
        score(no, cols, at[~goes], out)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], float] = {}
        for batch in batches:
            r, *cols = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            y, own, donor = cols[0], cols[1:m + 1], cols[m + 1:]
            r, labelled = r.astype(int), ~np.asarray(batch.column(1).is_null())
            for k, taken in enumerate(takes) if takes is not None else [(-1, [])]:
                p = np.zeros(len(y))
                for tree in trees:
                    score(tree, [donor[j] if j in taken else own[j] for j in range(m)], np.arange(len(y)), p)
                e = (y - p / len(trees)) ** 2
                for repeat in np.unique(r).tolist():
                    at = (r == repeat) & labelled
                    total[k, repeat] = total.get((k, repeat), 0.0) + float(e[at].sum())
        if total:
            yield pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in total], pa.int32()),
                                              "r": pa.array([r for _, r in total], pa.int32()), "e": pa.array([*total.values()])})

    return errors


def permutation_importance(model, df: DataFrame, feature_cols, key: str, label: str = "label",
                           n_repeats: int = 30, seed: int = 42, assemble=None) -> DataFrame:
    """V4: mean drop in R² when one input column is permuted, for all columns and repeats together.

    Rows are numbered once, in the order of their keys. Repeat r gives row i the
    donor (a_r i + b_r) mod n, a seeded bijection; one join on the number brings
    the donors of all repeats. Each pair is then spread over the columns, of
    which one at a time takes the donor's value, so that one projection scores
    all of it and one aggregate has the errors. ``model`` is anything with
    ``transform`` from the raw columns (a fitted pipeline), ``assemble`` what is
    to be done before it.

    In a pipeline of ``feature_pipeline``'s encoders and a tree or a forest, the encoders are applied to each row once,
    as a donor's value has the donor's code, and each pair is scored for all columns in the task that joins it
    (``_tree_errors``): no copy of a row for each column is made.
    """
    spark, cols = df.sparkSession, list(feature_cols)
    coded = _coded_trees(model) if assemble is None else None
    rows = df.select(key, label, *[c for c in df.columns if c not in (key, label)])
    if coded:
        rows = reduce(lambda out, stage: stage.transform(out), coded.encoders, rows).select(
            key, label, *[F.col(f"`{c}`").cast("double").alias(f"__x{j}") for j, c in enumerate(coded.inputs)])
    numbered = cut_lineage(global_rank(rows, [key], "__rank"))
    n = numbered.count()
    if n == 0 or not cols:
        return spark.createDataFrame([], "feature string, importance_mean double, importance_std double")
    rng, shifts = random.Random(seed), []
    for r in range(n_repeats):
        a = next(x for x in iter(lambda: rng.randrange(1, n + 1), None) if math.gcd(x, n) == 1)
        shifts.append(F.struct(F.lit(r).alias("r"), F.lit(a).cast("bigint").alias("a"), F.lit(rng.randrange(n)).cast("bigint").alias("b")))
    own = numbered.withColumn("__i", F.col("__rank") - 1).drop("__rank")
    # a * i stays below n squared: decimals, as n may be beyond 2^31
    to = F.pmod(F.col("__i").cast("decimal(38,0)") * F.col("__s.a") + F.col("__s.b"), F.lit(n)).cast("bigint")
    asked = own.withColumn("__s", F.explode(F.array(*shifts))).withColumn("__donor", to)
    if coded:
        codes = [f"__x{j}" for j in range(len(coded.inputs))]
        donors = own.select(F.col("__i").alias("__donor"), *[F.col(c).alias(c.replace("x", "d")) for c in codes])
        pairs = asked.join(donors, "__donor").select(F.col("__s.r").alias("r"), F.col(label).cast("double").alias("y"), *codes,
                                                     *[c.replace("x", "d") for c in codes])
        takes = [[j for j, c in enumerate(coded.sources) if c == col] for col in cols]
        base = own.select(F.lit(0).alias("r"), F.col(label).cast("double").alias("y"), *codes)
        schema = "k int, r int, e double"
        errors = pairs.mapInArrow(_tree_errors(coded.trees, len(codes), takes), schema).unionByName(
            base.mapInArrow(_tree_errors(coded.trees, len(codes), None), schema))
        spread = own.agg((F.var_pop(label) * F.count(F.lit(1))).alias("s")).first()["s"]
        found = {(x["k"], x["r"]): 1 - x["e"] / spread for x in errors.groupBy("k", "r").agg(F.sum("e").alias("e")).collect()}
    else:
        donors = own.select(F.col("__i").alias("__donor"), *[F.col(f"`{c}`").alias(f"__d{k}") for k, c in enumerate(cols)])
        spread = asked.join(donors, "__donor").withColumn("__k", F.explode(F.array(*[F.lit(k) for k in range(len(cols))])))
        changed = {c: F.when(F.col("__k") == k, F.col(f"__d{k}")).otherwise(F.col(f"`{c}`")) for k, c in enumerate(cols)}
        plain = [c for c in df.columns if c not in changed]
        rows = spread.select(F.col("__k"), F.col("__s.r").alias("__r"), *[F.col(f"`{c}`") for c in plain],
                             *[v.alias(c) for c, v in changed.items()])
        base = own.select(F.lit(-1).alias("__k"), F.lit(0).alias("__r"), *[F.col(f"`{c}`") for c in plain],
                          *[F.col(f"`{c}`") for c in cols])
        every = base.unionByName(rows)
        scored = model.transform(assemble(every) if assemble else every)
        y, p = F.col(label), F.col("prediction")
        r2 = 1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(F.lit(1)))
        found = {(r["__k"], r["__r"]): r["r2"] for r in scored.groupBy("__k", "__r").agg(r2.alias("r2")).collect()}
    result = []
    for k, c in enumerate(cols):
        drops = [found[-1, 0] - found[k, r] for r in range(n_repeats)]
        mean = sum(drops) / len(drops)
        result.append((c, float(mean), float((sum((x - mean) ** 2 for x in drops) / len(drops)) ** 0.5)))
    return spark.createDataFrame(result, "feature string, importance_mean double, importance_std double").orderBy(
        F.desc("importance_mean"), "feature")


def rfe(fit_fn, df: DataFrame, features, n_keep: int, step: int = 1):
    """V5: recursive elimination: fit, drop the ``step`` least important, repeat.
    Kept features rank 1, those dropped last rank 2, and so on.
    ``fit_fn(df, features) -> importances`` (list aligned with features)."""
    current = list(features)
    rounds = []
    while len(current) > n_keep:
        imp = fit_fn(df, current)
        order = sorted(zip(current, imp), key=lambda t: (t[1], t[0]))
        k = min(step, len(current) - n_keep)
        rounds.append([name for name, _ in order[:k]])
        current = [name for name in current if name not in rounds[-1]]
    ranking = dict.fromkeys(current, 1)
    for rank, names in enumerate(reversed(rounds), start=2):
        ranking |= dict.fromkeys(names, rank)
    return current, ranking


def rfe_report(fit_fn, df: DataFrame, features, n_keep: int, step: int = 1) -> list[tuple]:
    """V5: (feature, rank, importance in the fit on the kept features; null for a dropped one), by rank and importance."""
    kept, ranking = rfe(fit_fn, df, features, n_keep, step)
    final = dict(zip(kept, map(float, fit_fn(df, kept))))
    return sorted(((f, r, final.get(f)) for f, r in ranking.items()), key=lambda t: (t[1], -(t[2] or 0.0), t[0]))


def importance_consensus(tables, on: str = "feature", cols=None) -> DataFrame:
    """V6: join importance tables, divide each column by its sum, average the
    chosen columns, sort descending. The column sums are scalar subqueries."""
    joined = reduce(lambda a, b: a.join(b, on=on), tables)
    cols = cols or [c for c in joined.columns if c != on]
    normed = joined.select(on, *[(F.col(c) / joined.agg(F.sum(c)).scalar()).alias(c) for c in cols])
    return normed.withColumn("consensus", sum(F.col(c) for c in cols) / len(cols)).orderBy(F.desc("consensus"), on)


def ablation(cv_fn, df: DataFrame, features, drop) -> DataFrame:
    """V7: CV score with all features and without the ``drop`` columns."""
    with_all = cv_fn(df, list(features))
    without = cv_fn(df, [f for f in features if f not in set(drop)])
    return df.sparkSession.createDataFrame([("all", float(with_all)), ("without", float(without))],
                                           "variant string, cv_r2 double")


def score(df: DataFrame, pred_log: str = "prediction", area: str = "built_up_area",
          low: float = rules.BAND_LOW, high: float = rules.BAND_HIGH, crore: float = rules.CRORE) -> DataFrame:
    """V8: back-transform a log prediction; fixed +-13 % band; rate per sq.ft.;
    rounded 4/4/4/2 (batch form of the reference's single request)."""
    p = F.expm1(F.col(pred_log))
    return df.withColumns({
        "estimated_price_cr": F.round(p, 4),
        "lower_bound_cr": F.round(p * low, 4),
        "upper_bound_cr": F.round(p * high, 4),
        "price_per_sqft": F.round(F.try_divide(p * float(crore), F.col(area)), 2),
    })


def validate_requests(df: DataFrame, ranges: dict = rules.REQUEST_RANGES, required=rules.MODEL_FEATURES) -> DataFrame:
    """V9: one boolean per check plus ``valid``; split with ``filter('valid')``."""
    checks = {}
    for c in required:
        if c in df.columns:
            checks[f"has_{c.replace(' ', '_')}"] = F.col(f"`{c}`").isNotNull()
        else:
            checks[f"has_{c.replace(' ', '_')}"] = F.lit(False)
    for c, (lo, hi) in ranges.items():
        if c in df.columns:
            checks[f"ok_{c}"] = F.coalesce(F.col(c).between(lo, hi), F.lit(False))
    out = df.withColumns(checks)
    return out.withColumn("valid", reduce(lambda a, b: a & b, [F.col(k) for k in checks]))


def dataset_stats(df: DataFrame, price: str = "price", key: str = "sector") -> DataFrame:
    """Rows, columns, nulls, duplicates, distinct keys and price summary."""
    nulls = D.null_counts(df, total_col="total").select("total").scalar()
    dups = D.duplicate_count(df).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.countDistinct(key).alias("n_keys"),
        F.avg(price).alias("avg_price"), exact_quantile(df, price).alias("median_price"),
        F.min(price).alias("min_price"), F.max(price).alias("max_price"),
    ).withColumn("n_nulls", nulls).withColumn("n_duplicates", dups)
