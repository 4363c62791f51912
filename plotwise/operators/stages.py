"""Feature stages that are fitted, saved and loaded like any Spark ML stage (survey E1, E2, E4-E6, S3, M11).

``feature_pipeline`` strings them together with MLlib's ``OneHotEncoder`` and
``VectorAssembler`` and, if wanted, a regressor. The fitted ``PipelineModel``
is one directory: ``load_model`` gives back encoder and model together, and
``transform`` takes raw rows.

Categories are a table (column, value, index, n, encoded), in the model as in
its directory: no list of them passes through the driver, and there is no
limit to their number. They are found by one grouped count over all columns
and numbered by a distributed rank. To apply them, each column joins its part
of the table, by a broadcast hash join where the sizes kept with the model
prove that it is small.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, functions as F, types as T

from plotwise.operators.joins import BROADCAST_BYTE_LIMIT, BROADCAST_ROW_LIMIT
from plotwise.operators.prefix import global_rank
from plotwise.session import cut_lineage

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class _Scaled(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to scale", TypeConverters.toListString)
    suffix = Param(Params._dummy(), "suffix", "added to the names of the scaled columns", TypeConverters.toString)
    sample = Param(Params._dummy(), "sample", "sample instead of population deviation", TypeConverters.toBoolean)
    means = Param(Params._dummy(), "means", "fitted means", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "fitted standard deviations", TypeConverters.toListFloat)


class ColumnScaler(Estimator, _Scaled, DefaultParamsReadable, DefaultParamsWritable):
    """E5 as a stage: (x - mean) / deviation of each column, 0 where nothing varies; a null stays null."""

    @keyword_only
    def __init__(self, *, inputCols=None, suffix="_z", sample=False):
        super().__init__()
        self._setDefault(inputCols=[], suffix="_z", sample=False)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> ColumnScalerModel:
        cols = self.getOrDefault("inputCols")
        std = F.stddev_samp if self.getOrDefault("sample") else F.stddev_pop
        row = dataset.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                          *[std(F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first() if cols else {}
        model = ColumnScalerModel()
        self._copyValues(model)
        return model._set(means=[float(row[f"m{i}"] or 0.0) for i in range(len(cols))],
                          deviations=[float(row[f"s{i}"] or 0.0) for i in range(len(cols))])


class ColumnScalerModel(Model, _Scaled, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()
        self._setDefault(inputCols=[], suffix="_z", sample=False, means=[], deviations=[])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        suffix = self.getOrDefault("suffix")
        return dataset.withColumns({
            c + suffix: (F.col(c) - m) / s if s > 0 else F.when(F.col(c).isNotNull(), 0.0)
            for c, m, s in zip(self.getOrDefault("inputCols"), self.getOrDefault("means"), self.getOrDefault("deviations"))})


class _Encoded(Params):
    ordinalCols = Param(Params._dummy(), "ordinalCols", "columns to number", TypeConverters.toListString)
    oneHotCols = Param(Params._dummy(), "oneHotCols", "columns to spread, without the first category", TypeConverters.toListString)
    targetCols = Param(Params._dummy(), "targetCols", "columns to encode by the label's smoothed mean", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "label, for targetCols", TypeConverters.toString)
    minSamplesLeaf = Param(Params._dummy(), "minSamplesLeaf", "rows at which a category counts half", TypeConverters.toFloat)
    smoothing = Param(Params._dummy(), "smoothing", "how slowly a category's own mean takes over", TypeConverters.toFloat)

    def _defaults(self):
        self._setDefault(ordinalCols=[], oneHotCols=[], targetCols=[], labelCol="label", minSamplesLeaf=20.0, smoothing=10.0)

    def category_columns(self) -> list[str]:
        return sorted({*self.getOrDefault("ordinalCols"), *self.getOrDefault("oneHotCols"), *self.getOrDefault("targetCols")})


class CategoryEncoder(Estimator, _Encoded, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the categories of columns in ascending order (numbers as numbers, texts by code point; null is none).

    The model adds, for each column c, as asked: ``c__ord``, the category's number from 0, -1 for an unknown one or null
    (E1); ``c__slot``, a nominal column that a ``OneHotEncoder`` spreads so that the first category, unknown ones and
    null are all zeros (E2); ``c__te``, the smoothed mean of the label, the mean of all rows for the unknown (E4).
    """

    @keyword_only
    def __init__(self, *, ordinalCols=None, oneHotCols=None, targetCols=None, labelCol=None, minSamplesLeaf=None, smoothing=None):
        super().__init__()
        self._defaults()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> CategoryEncoderModel:
        cols, target = self.category_columns(), bool(self.getOrDefault("targetCols"))
        kinds = {f.name: f.dataType for f in dataset.schema.fields}
        label = F.col(self.getOrDefault("labelCol")) if target else F.lit(None)
        parts = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"),
                          (F.col(f"`{c}`") if isinstance(kinds[c], _NUMBERS) else F.lit(None)).cast("double").alias("number"))
                 for c in cols]
        prior = None
        if target:
            prior = dataset.agg(F.avg(label)).first()[0]
        found = dataset.sparkSession.createDataFrame([], "column string, value string, number double, n bigint, m double")
        if parts:
            # copies of a category combine before the shuffle: a hot one is a row a task
            found = dataset.select(F.explode(F.array(*parts)).alias("c"), label.cast("double").alias("y")).filter(
                "c.value is not null").groupBy("c.column", "c.value", "c.number").agg(
                F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"))
        ranked = cut_lineage(global_rank(found, ["column", F.col("number").asc_nulls_first(), "value"], "rank"))
        size = {r["column"]: r for r in ranked.groupBy("column").agg(
            F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 24).alias("bytes")).collect()}
        first = dataset.sparkSession.createDataFrame([(c, r["first"]) for c, r in size.items()], "column string, first bigint")
        k, f = self.getOrDefault("minSamplesLeaf"), self.getOrDefault("smoothing")
        share = 1.0 / (1.0 + F.exp(-(F.col("n") - k) / f))
        table = ranked.join(F.broadcast(first), "column").select(
            "column", "value", (F.col("rank") - F.col("first")).alias("index"), "n",
            (share * F.col("m") + (1 - share) * F.lit(prior)).cast("double").alias("encoded"))
        model = CategoryEncoderModel()
        self._copyValues(model)
        model.table, model.prior = table, prior
        model.sizes = {c: [size[c]["n"], size[c]["bytes"]] if c in size else [0, 0] for c in cols}
        return model


class _TableWriter(MLWriter):
    def __init__(self, model: CategoryEncoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        extra = {"sizes": self.model.sizes, "prior": self.model.prior}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=extra)
        self.model.table.repartition("column").write.partitionBy("column").parquet(f"{path}/categories")


class _TableReader(MLReader):
    def load(self, path: str) -> CategoryEncoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = CategoryEncoderModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.sizes, model.prior = metadata["sizes"], metadata["prior"]
        schema = "value string, index bigint, n bigint, encoded double, column string"
        # a model without categories has no files, and so no schema of its own
        model.table = (self.sparkSession.read.schema(schema).parquet(f"{path}/categories")
                       if any(n for n, _ in model.sizes.values()) else self.sparkSession.createDataFrame([], schema))
        return model


class CategoryEncoderModel(Model, _Encoded, MLReadable, MLWritable):
    """The categories as a table; see ``CategoryEncoder``."""

    def __init__(self):
        super().__init__()
        self._defaults()
        self.table: DataFrame | None = None
        self.sizes: dict[str, list[int]] = {}
        self.prior: float | None = None

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader()

    def copy(self, extra=None):
        that = super().copy(extra)
        that.table, that.sizes, that.prior = self.table, self.sizes, self.prior
        return that

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, added = dataset, {}
        ordinal, hot, target = (set(self.getOrDefault(p)) for p in ("ordinalCols", "oneHotCols", "targetCols"))
        for i, c in enumerate(self.category_columns()):
            n, size = self.sizes[c]
            part = self.table.filter(F.col("column") == c).select(
                F.col("value").alias(f"__value{i}"), F.col("index").alias(f"__index{i}"), F.col("encoded").alias(f"__encoded{i}"))
            if n <= BROADCAST_ROW_LIMIT and size <= BROADCAST_BYTE_LIMIT:
                part = F.broadcast(part)
            out = out.join(part, F.col(f"`{c}`").cast("string") == F.col(f"__value{i}"), "left")
            index = F.col(f"__index{i}")
            if c in ordinal:
                added[f"{c}__ord"] = F.coalesce(index, F.lit(-1)).cast("double")
            if c in hot:
                # the encoder leaves out its last value, to which all go that have no column
                kinds = max(n, 2)
                slot = F.when(index >= 1, index - 1).otherwise(kinds - 1).cast("double")
                added[f"{c}__slot"] = slot.alias(f"{c}__slot", metadata={
                    "ml_attr": {"type": "nominal", "name": f"{c}__slot", "num_vals": kinds}})
            if c in target:
                added[f"{c}__te"] = F.coalesce(F.col(f"__encoded{i}"), F.lit(self.prior).cast("double"))
        return out.select(*[F.col(f"`{c}`") for c in dataset.columns],
                          *[v if n.endswith("__slot") else v.alias(n) for n, v in added.items()])


class DropColumns(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Drops helper columns, so that what is kept or cached after it is narrow."""

    inputCols = Param(Params._dummy(), "inputCols", "columns to drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._setDefault(inputCols=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*self.getOrDefault("inputCols"))


def feature_pipeline(num_cols=(), ordinal_cols=(), onehot_cols=(), target_cols=(), passthrough=(), scale: bool = False,
                     label_col: str = "label", features_col: str = "features", then=(), min_samples_leaf: float = 20.0,
                     smoothing: float = 10.0) -> Pipeline:
    """An unfitted pipeline from raw columns to one (sparse) vector, followed by the stages of ``then``.

    The vector holds the numeric columns (scaled if asked; null as NaN), ordinal numbers, one-hot columns, target
    encodings and ``passthrough``, in this order.
    """
    num, ordinal, hot, target = (list(c) for c in (num_cols, ordinal_cols, onehot_cols, target_cols))
    stages: list = [ColumnScaler(inputCols=num)] if scale and num else []
    numbers = [c + "_z" for c in num] if scale else num
    helpers = [*(numbers if scale else []), *(c + "__ord" for c in ordinal), *(c + "__te" for c in target)]
    stages.append(CategoryEncoder(ordinalCols=ordinal, oneHotCols=hot, targetCols=target, labelCol=label_col,
                                  minSamplesLeaf=min_samples_leaf, smoothing=smoothing))
    if hot:
        stages.append(OneHotEncoder(inputCols=[c + "__slot" for c in hot], outputCols=[c + "__hot" for c in hot]))
        helpers += [c + "__slot" for c in hot] + [c + "__hot" for c in hot]
    stages.append(VectorAssembler(inputCols=[*numbers, *(c + "__ord" for c in ordinal), *(c + "__hot" for c in hot),
                                             *(c + "__te" for c in target), *passthrough],
                                  outputCol=features_col, handleInvalid="keep"))
    return Pipeline(stages=[*stages, DropColumns(inputCols=helpers), *then])


def encoder_of(model: PipelineModel) -> CategoryEncoderModel:
    return next(s for s in model.stages if isinstance(s, CategoryEncoderModel))


def feature_names(model: PipelineModel) -> list[str]:
    """The names of the vector's places, for reports: one for each category of a one-hot column."""
    encoder = encoder_of(model)
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    names = {}
    for c in encoder.getOrDefault("oneHotCols"):
        rows = encoder.table.filter((F.col("column") == c) & (F.col("index") >= 1)).orderBy("index").select("value").collect()
        names[c + "__hot"] = [f"{c}_{r.value}" for r in rows] or [f"{c}_"]
    return [n for c in assembler.getInputCols() for n in names.get(c, [c.removesuffix("__ord").removesuffix("__te")
                                                                       if not c.endswith("__hot") else c])]
