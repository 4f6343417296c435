"""Classifiers that predict the label from a released table, and how well they generalise."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.draws import Draws
from veilframe.operators.boosting import SecondOrderBoosting
from veilframe.operators.features import (
    add_fold,
    add_split,
    class_weights,
    design_model,
    feature_names,
    mutual_information,
    worth_grouping,
)
from veilframe.operators.forest import GroupedForest
from veilframe.operators.masks import wide
from veilframe.operators.project import add_category_code
from veilframe.operators.scoring import evaluation_rows
from veilframe.session import settle
from veilframe.spec import MaskSpec

# Report names, tuning grids and training settings of the model families.
LOGISTIC, FOREST, SVM, BOOSTED = "Logistic Regression", "Random Forest", "SVM", "XGBoost"
FAST_MODELS = (LOGISTIC, FOREST)
ALL_MODELS = (LOGISTIC, FOREST, SVM, BOOSTED)
KEPT_FEATURES = 8
LOGISTIC_C = (0.1, 1.0, 3.0)
FOREST_DEPTH, FOREST_LEAF = (6, 10), (5, 15)
SVM_C = (0.5, 1.5)
BOOSTED_DEPTH, BOOSTED_RATE = (2, 4), (0.05, 0.1)
FOLDS, MINIMUM_ROWS = 5, 20

MODEL_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        *[
            T.StructField(name, T.DoubleType())
            for name in (
                "accuracy", "precision", "recall", "f1", "rmse", "roc_auc", "train_accuracy", "validation_accuracy",
                "train_validation_gap", "validation_log_loss", "test_log_loss", "cv_accuracy_mean", "cv_accuracy_std",
            )
        ],
        T.StructField("feature_count", T.IntegerType()),
        T.StructField("overfitting_flag", T.BooleanType()),
        T.StructField("underfitting_flag", T.BooleanType()),
        T.StructField("sensitive_signal_correlation", T.DoubleType()),
        T.StructField("memorization_risk_flag", T.BooleanType()),
        T.StructField("best_params", T.StringType()),
    ]
)


@dataclass(frozen=True)
class ModelOptions:
    """How much to train. The defaults are the full tuned evaluation."""

    models: Sequence[str] = ALL_MODELS
    tune: bool = True
    cross_validate: bool = True
    folds: int = FOLDS
    trees: int = 160
    forest_depth: int = 10
    rounds: int = 120
    fourier_features: int = 128
    logistic_iterations: int = 1500
    svm_iterations: int = 100
    parallelism: int = 2
    seed: int = 42
    draws: Draws = field(default_factory=Draws)


FAST = ModelOptions(models=FAST_MODELS, tune=False, cross_validate=False)


def guard_rows(spark: SparkSession) -> DataFrame:
    """Result when there is nothing to learn: one class only, or too few rows."""
    zero = {f.name: 0.0 for f in MODEL_SCHEMA if isinstance(f.dataType, T.DoubleType)}
    zero |= {"rmse": 1.0, "validation_log_loss": 1.0, "test_log_loss": 1.0}
    zero |= {"feature_count": 0, "overfitting_flag": False, "underfitting_flag": True}
    zero |= {"memorization_risk_flag": False, "best_params": "{}"}
    rows = [{**zero, "model": name} for name in ALL_MODELS]
    return spark.createDataFrame([tuple(r[f.name] for f in MODEL_SCHEMA) for r in rows], MODEL_SCHEMA)


def unmasked(df: DataFrame, spec: MaskSpec) -> DataFrame:
    """Wide frame whose masked side is the original: the baseline for the models."""
    frame = wide(df, spec)
    return frame.select(
        F.lit(-1).alias("config_id"),
        "*",
        F.col(f"o_{spec.numeric}").alias(f"m_{spec.numeric}"),
        F.lit(None).cast("string").alias(f"m_{spec.numeric}_label"),
        F.col(f"o_{spec.category}").alias(f"m_{spec.category}"),
        F.col(f"o_{spec.flag}").alias(f"m_{spec.flag}"),
        F.lit(None).cast("string").alias(f"m_{spec.flag}_label"),
    )


# --- training frame ------------------------------------------------------------------------


@dataclass
class TrainingData:
    frame: DataFrame
    names: list[str]
    ranked: list[int]
    train_rows: int
    weights: dict[int, float]


def training_inputs(frame: DataFrame, spec: MaskSpec, binned: bool) -> tuple[DataFrame, list[str], list[str]]:
    """Model inputs under the role names: a binned number is a text, the flag is left out."""
    number = F.col(f"m_{spec.numeric}_label") if binned else F.coalesce(F.col(f"m_{spec.numeric}"), F.lit(0.0))
    inputs = frame.select(
        "row_id",
        "label",
        number.alias(spec.numeric),
        F.coalesce(F.col(f"m_{spec.numeric}"), F.lit(0.0)).alias("__number"),
        F.col(f"m_{spec.category}").alias(spec.category),
        *spec.carried,
    )
    numbers = [] if binned else [spec.numeric]
    texts = [*([spec.numeric] if binned else []), *spec.texts]
    return inputs, numbers, texts


def prepare(frame: DataFrame, spec: MaskSpec, binned: bool, options: ModelOptions) -> TrainingData | None:
    """Split, design matrix and feature ranking; the caller unpersists ``frame``."""
    inputs, numbers, texts = training_inputs(frame, spec, binned)
    parted, folds = add_split(inputs, options.draws), []
    if options.tune or options.cross_validate:  # a draw for each row, so only where it is read
        parted, folds = add_fold(parted, options.draws, options.folds), ["fold"]
    coded = add_category_code(parted, spec.category, "__code").persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {(r["part"], r["label"]): r["count"] for r in coded.groupBy("part", "label").count().collect()}
    labels = {label for _, label in sizes}
    train = {label: n for (part, label), n in sizes.items() if part == "train"}
    if len(labels) < 2 or sum(sizes.values()) < MINIMUM_ROWS or len(train) < 2:
        coded.unpersist()
        return None
    design = design_model(coded, numbers, texts)
    names = feature_names(design, numbers, texts)
    scores = mutual_information(
        coded.where(F.col("part") == "train"), texts, {c: (spec.lower, spec.upper) for c in numbers}
    )
    order = [r["feature"] for r in scores.orderBy(F.desc("mutual_information"), "feature").collect()]
    ranked = [names.index(name) for name in order if name in names]
    weights = {r["label"]: r["weight"] for r in class_weights(coded.where(F.col("part") == "train")).collect()}
    weight = F.when(F.col("label") == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    ready = design.transform(coded).withColumn("weight", weight)
    columns = ["row_id", "label", "part", *folds, "weight", "features", "__number", "__code"]
    kept = ready.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    coded.unpersist()
    return TrainingData(kept, names, ranked, sum(train.values()), weights)


# --- random Fourier features ---------------------------------------------------------------


class FourierFeatures(Transformer, HasInputCol, HasOutputCol):
    """RBF kernel features (Rahimi and Recht, 2007), computed in Arrow batches.

    A linear machine on these columns approximates the kernel machine and trains in
    parallel. ``gamma`` is one over the number of input columns, which is the usual "scale"
    choice for unit-variance inputs.
    """

    def __init__(self, inputCol: str, outputCol: str, features: int, seed: int) -> None:
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.features, self.seed = features, seed

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features, seed = self.features, self.seed

        @F.pandas_udf("array<double>")
        def apply(batch: pd.Series) -> pd.Series:
            if batch.empty:
                return pd.Series([], dtype=object)
            values = np.stack(batch.to_numpy())
            rng = np.random.default_rng([seed, values.shape[1]])
            weights = rng.normal(0.0, np.sqrt(2.0 / values.shape[1]), (values.shape[1], features))
            shift = rng.uniform(0.0, 2.0 * np.pi, features)
            return pd.Series(list(np.sqrt(2.0 / features) * np.cos(values @ weights + shift)))

        mapped = apply(vector_to_array(self.getInputCol()))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(mapped))


class FourierSVC(LinearSVC):
    """A linear machine on Fourier features; training rows with the same input are one row with all their weight.

    The machine's loss is a sum over rows, so it is the same for both, and each iteration passes the
    different rows only.
    """

    fourier: FourierFeatures

    def _fit(self, dataset: DataFrame):
        inputs, label, weight = self.fourier.getInputCol(), self.getLabelCol(), self.getWeightCol()
        rows = dataset.select(vector_to_array(inputs).alias("__input"), label, weight)
        if not worth_grouping(rows, "__input", label):
            return super()._fit(dataset)
        grouped = rows.groupBy("__input", label).agg(F.sum(weight).alias(weight))
        return super()._fit(self.fourier.transform(settle(grouped.withColumn(inputs, array_to_vector("__input")))))


# --- model families --------------------------------------------------------------------------


def _slicer(data: TrainingData, options: ModelOptions) -> tuple[VectorSlicer, list[list[int]]]:
    everything = list(range(len(data.names)))
    choices = [sorted(data.ranked[:KEPT_FEATURES]), everything] if len(everything) >= KEPT_FEATURES else [everything]
    if not options.tune:
        choices = [everything]
    return VectorSlicer(inputCol="features", outputCol="kept", indices=choices[-1]), choices


def _penalty(c: float, rows: int) -> float:
    return 1.0 / (c * max(rows, 1))


def _search(data: TrainingData, pipeline: Pipeline, grid: list[dict], options: ModelOptions) -> Pipeline:
    """Pipeline with the best grid point by cross-validated ROC-AUC."""
    if len(grid) == 1:
        return pipeline.copy(grid[0])
    train = data.frame.where(F.col("part") == "train")
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC", numBins=0),
        numFolds=options.folds,
        foldCol="fold",
        parallelism=options.parallelism,
    ).fit(train)
    return pipeline.copy(grid[int(np.argmax(search.avgMetrics))])


def _fold_accuracy(data: TrainingData, pipeline: Pipeline, options: ModelOptions) -> tuple[float, float]:
    train = data.frame.where(F.col("part") == "train")
    folds = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=[{}],
        evaluator=MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy"),
        numFolds=options.folds,
        foldCol="fold",
        parallelism=options.parallelism,
    ).fit(train)
    return float(folds.avgMetrics[0]), float(folds.stdMetrics[0])


def _logistic(data: TrainingData, options: ModelOptions) -> tuple[Pipeline, list[dict], dict]:
    # standardization=True penalises coefficients of unit-variance features, which is what
    # scaling first would do, without turning sparse one-hot rows dense.
    model = LogisticRegression(
        featuresCol="kept", labelCol="label", weightCol="weight", maxIter=options.logistic_iterations,
        regParam=_penalty(1.0, data.train_rows), standardization=True,
    )
    slicer, choices = _slicer(data, options)
    builder = ParamGridBuilder().addGrid(slicer.indices, choices)
    if options.tune:
        builder = builder.addGrid(model.regParam, [_penalty(c, data.train_rows) for c in LOGISTIC_C])
    names = {model.regParam: ("model__C", lambda v: round(1.0 / (v * max(data.train_rows, 1)), 6))}
    return Pipeline(stages=[slicer, model]), builder.build(), names


def _forest(data: TrainingData, options: ModelOptions) -> tuple[Pipeline, list[dict], dict]:
    model = GroupedForest(
        featuresCol="kept", labelCol="label", weightCol="weight", numTrees=options.trees,
        maxDepth=options.forest_depth, featureSubsetStrategy="sqrt", seed=options.seed,
    )
    slicer, choices = _slicer(data, options)
    builder = ParamGridBuilder().addGrid(slicer.indices, choices)
    if options.tune:
        builder = builder.addGrid(model.maxDepth, list(FOREST_DEPTH)).addGrid(
            model.minInstancesPerNode, list(FOREST_LEAF)
        )
    names = {model.maxDepth: ("model__max_depth", int), model.minInstancesPerNode: ("model__min_samples_leaf", int)}
    return Pipeline(stages=[slicer, model]), builder.build(), names


def _svm(data: TrainingData, options: ModelOptions) -> tuple[Pipeline, list[dict], dict]:
    scaler = StandardScaler(inputCol="kept", outputCol="scaled", withMean=True, withStd=True)
    fourier = FourierFeatures("scaled", "fourier", options.fourier_features, options.seed)
    model = FourierSVC(
        featuresCol="fourier", labelCol="label", weightCol="weight", maxIter=options.svm_iterations,
        regParam=_penalty(1.0, data.train_rows), standardization=False,
    )
    model.fourier = fourier
    slicer, choices = _slicer(data, options)
    builder = ParamGridBuilder().addGrid(slicer.indices, choices)
    if options.tune:
        builder = builder.addGrid(model.regParam, [_penalty(c, data.train_rows) for c in SVM_C])
    names = {model.regParam: ("model__C", lambda v: round(1.0 / (v * max(data.train_rows, 1)), 6))}
    return Pipeline(stages=[slicer, scaler, fourier, model]), builder.build(), names


def _boosted(data: TrainingData, options: ModelOptions) -> tuple[Pipeline, list[dict], dict]:
    model = SecondOrderBoosting(featuresCol="kept", maxIter=options.rounds, maxDepth=3, stepSize=0.08, seed=options.seed)
    slicer, choices = _slicer(data, options)
    builder = ParamGridBuilder().addGrid(slicer.indices, choices)
    if options.tune:
        builder = builder.addGrid(model.maxDepth, list(BOOSTED_DEPTH)).addGrid(model.stepSize, list(BOOSTED_RATE))
    names = {model.maxDepth: ("model__max_depth", int), model.stepSize: ("model__learning_rate", float)}
    return Pipeline(stages=[slicer, model]), builder.build(), names


BUILDERS = {LOGISTIC: _logistic, FOREST: _forest, SVM: _svm, BOOSTED: _boosted}


def _probabilities(name: str, fitted, data: TrainingData) -> DataFrame:
    """Label, predicted class and positive probability for every row of every part."""
    scored = fitted.transform(data.frame)
    if name != SVM:
        return scored.withColumn("p", vector_to_array("probability")[1]).withColumnRenamed("prediction", "predicted")
    # Platt scaling: a logistic curve over the margin, fitted on the training part.
    margin = scored.withColumn("margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability")
    margin = margin.withColumnRenamed("prediction", "predicted")
    curve = Pipeline(
        stages=[
            VectorAssembler(inputCols=["margin"], outputCol="margin_vector"),
            LogisticRegression(featuresCol="margin_vector", labelCol="label", predictionCol="platt"),
        ]
    ).fit(margin.where(F.col("part") == "train"))
    return curve.transform(margin).withColumn("p", vector_to_array("probability")[1])


def fit_one(name: str, data: TrainingData, options: ModelOptions) -> tuple[DataFrame, tuple]:
    """Train one family; its scored rows, and what only training knows about it."""
    pipeline, grid, names = BUILDERS[name](data, options)
    chosen = _search(data, pipeline, grid, options)
    fitted = chosen.fit(data.frame.where(F.col("part") == "train"))
    mean, std = _fold_accuracy(data, chosen, options) if options.cross_validate else (None, 0.0)
    kept = next(stage.getIndices() for stage in chosen.getStages() if isinstance(stage, VectorSlicer))
    model = chosen.getStages()[-1]
    best = {label: read(model.getOrDefault(param)) for param, (label, read) in names.items()}
    best["select__k"] = len(kept) if len(kept) < len(data.names) else "all"
    scored = _probabilities(name, fitted, data).select(
        F.lit(name).alias("model"), "part", F.col("label").alias("y"), "p", "predicted", "__number", "__code"
    )
    return scored, (name, mean, std, len(kept), json.dumps(best, sort_keys=True))


TRAINING_SCHEMA = "model string, cv_mean double, cv_accuracy_std double, feature_count int, best_params string"


def evaluate_models(
    frame: DataFrame, spec: MaskSpec, options: ModelOptions | None = None, binned: bool = False
) -> DataFrame:
    """Train the chosen families on one masked frame; one report row per family.

    ``frame`` is a wide frame with a single setting, or ``unmasked`` for the baseline. The
    label always comes from the original flag, whatever the mask did to it. Without
    cross-validation the validation accuracy stands in for the fold mean.
    """
    options = options or ModelOptions()
    spark = frame.sparkSession
    data = prepare(frame, spec, binned, options)
    if data is None:
        return guard_rows(spark)
    with ThreadPoolExecutor(max_workers=max(1, options.parallelism)) as pool:
        work = inheritable_thread_target(spark)(lambda name: fit_one(name, data, options))
        fitted = list(pool.map(work, options.models))
    scored = reduce(DataFrame.unionByName, [rows for rows, _ in fitted]).persist(StorageLevel.MEMORY_AND_DISK)
    measured = evaluation_rows(scored, ["model"], ["__number", "__code"])
    training = spark.createDataFrame([facts for _, facts in fitted], TRAINING_SCHEMA)
    report = measured.join(F.broadcast(training), "model").withColumn(  # one row per family
        "cv_accuracy_mean", F.coalesce(F.col("cv_mean"), F.col("validation_accuracy"))
    )
    rows = settle(report.select(*[F.col(f.name).cast(f.dataType) for f in MODEL_SCHEMA]))
    scored.unpersist()
    data.frame.unpersist()
    return rows
