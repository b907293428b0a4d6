"""Random hyper-parameter search over the classifier types.

Trees, perceptrons and support vectors are those of :mod:`strideline.models.trees`,
:mod:`strideline.models.perceptron` and :mod:`strideline.models.svm`, which train all settings and folds in the
same passes.  Forests are Spark's: no minimum split size, depth up to 30.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.models import perceptron, svm, trees
from strideline.models.metrics import accuracy
from strideline.operators.splits import stratified_folds

# Search space of each classifier type.
SEARCH_SPACE = {
    "svc": {"kernel": ["rbf", "linear", "poly"], "degree": (2, 29), "gamma_exponent": 9, "C": (2, 5000), "max_iter": (2, 5000)},
    "cart_tree": {"max_depth": (1, 127), "criterion": ["gini", "entropy"], "splitter": ["best", "random"], "min_samples_split": (2, 19)},
    "random_forrest": {"n_estimators": (1, 127), "max_depth": (1, 30), "criterion": ["gini", "entropy"], "bootstrap": [True, False]},
    "mlp_classifier": {
        "architectures": [[32, 16], [16, 8], [8, 4]], "solver": ["adam", "lbfgs", "sgd"], "activation": ["logistic", "relu", "tanh"],
        "max_iter": (1, 249), "alpha_exponent": 9, "learning_rate_exponent": 9, "schedule": ["constant", "invscaling", "adaptive"],
        "batch_size": (1, 9), "shuffle": [True, False], "early_stopping": [True, False],
    },
}


def draw_parameters(
    model_type: str, draws: int, features: int, seed: int = 0, space: dict | None = None
) -> list[dict]:
    """``draws`` random settings of one classifier type; ``space`` narrows the usual ranges."""
    if model_type not in SEARCH_SPACE:
        raise ValueError(f"unknown model type {model_type!r}")
    rng = np.random.default_rng(seed)
    space = {**SEARCH_SPACE[model_type], **(space or {})}

    def whole(low: int, high: int) -> int:
        return int(rng.integers(low, high + 1))

    def pick(options: list):
        return options[whole(0, len(options) - 1)]

    drawn = []
    for _ in range(draws):
        if model_type == "svc":
            params = {
                "kernel": pick(space["kernel"]), "degree": whole(*space["degree"]),
                "gamma": float(10.0 ** whole(-space["gamma_exponent"], space["gamma_exponent"])),
                "C": whole(*space["C"]), "max_iter": whole(*space["max_iter"]),
            }
        elif model_type == "cart_tree":
            params = {
                "max_depth": whole(*space["max_depth"]), "criterion": pick(space["criterion"]), "splitter": pick(space["splitter"]),
                "min_samples_split": whole(*space["min_samples_split"]), "min_samples_leaf": whole(1, max(1, features - 1)),
                "max_features": whole(1, max(1, features - 1)),
            }
        elif model_type == "random_forrest":
            params = {
                "n_estimators": whole(*space["n_estimators"]), "max_depth": whole(*space["max_depth"]),
                "criterion": pick(space["criterion"]), "bootstrap": pick(space["bootstrap"]),
            }
        else:
            params = {
                "hidden": pick(space["architectures"]), "solver": pick(space["solver"]), "activation": pick(space["activation"]),
                "max_iter": whole(*space["max_iter"]), "alpha": float(10.0 ** whole(-space["alpha_exponent"], space["alpha_exponent"])),
                "learning_rate": float(10.0 ** whole(-space["learning_rate_exponent"], space["learning_rate_exponent"])),
                "schedule": pick(space["schedule"]), "batch_size": whole(*space["batch_size"]), "shuffle": pick(space["shuffle"]),
                "early_stopping": pick(space["early_stopping"]),
            }
        params["seed"] = whole(1, 9)
        drawn.append(params)
    return drawn


def build_stages(model_type: str, params: dict, features: int, classes: int, rows: int, label: str) -> list:
    """Pipeline stages behind the assembled ``features`` vector."""
    if model_type == "random_forrest":
        return [RandomForestClassifier(
            labelCol=label, numTrees=params["n_estimators"], maxDepth=params["max_depth"], impurity=params["criterion"],
            bootstrap=params["bootstrap"], seed=params["seed"])]
    raise ValueError(f"unknown model type {model_type!r}")


#: Types whose settings and folds are trained together, and what a setting of theirs is.
TOGETHER = {
    "cart_tree": (trees, trees.TreeSettings), "mlp_classifier": (perceptron, perceptron.NetSettings), "svc": (svm, svm.SvmSettings),
}


def setting_of(model_type: str, params: dict):
    return TOGETHER[model_type][1](**{k: tuple(v) if isinstance(v, list) else v for k, v in params.items()})


@dataclass
class SearchResult:
    model_type: str
    model: PipelineModel
    params: dict
    cv_score: float
    columns: list[str] = field(default_factory=list)


def random_search(
    train: DataFrame, columns: list[str], label: str, row_key: str, model_type: str, draws: int = 50, folds: int = 5,
    classes: int = 2, seed: int = 0, parallelism: int = 4, save_to: str | None = None,
    space: dict | None = None,
) -> SearchResult:
    """Best of ``draws`` random settings by stratified cross-validation, refitted on all rows.

    ``label`` holds 0..classes-1 and ``row_key`` is an integer that identifies a row.
    """
    safe = [f"f{i}" for i in range(len(columns))]
    named = train.select(
        F.col(row_key).cast("bigint").alias("_row"), F.col(label).cast("double").alias("_label"),
        *[F.col(f"`{c}`").cast("double").alias(s) for c, s in zip(columns, safe)],
    )
    prepared = stratified_folds(named, "_label", "_row", folds, seed).persist()
    try:
        rows = prepared.count()
        settings = draw_parameters(model_type, draws, len(columns), seed, space)
        assembler = VectorAssembler(inputCols=safe, outputCol="features")
        if model_type in TOGETHER:
            arrays = prepared.select(F.array(*safe).alias("x"), F.col("_label").alias("label"), "fold", F.col("_row").alias("row"))
            best, mean, stage = TOGETHER[model_type][0].search(arrays, [setting_of(model_type, p) for p in settings], folds, len(columns), classes)
            return _kept(SearchResult(model_type, PipelineModel([assembler, stage]), settings[best], mean, list(columns)), save_to)
        pipeline = Pipeline(stages=[assembler])
        grid = [
            {pipeline.stages: [assembler, *build_stages(model_type, s, len(columns), classes, rows, "_label")]}
            for s in settings
        ]
        evaluator = MulticlassClassificationEvaluator(labelCol="_label", metricName="accuracy")
        search = CrossValidator(
            estimator=pipeline, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, foldCol="fold",
            parallelism=parallelism, seed=seed,
        )
        fitted = search.fit(prepared)
    finally:
        prepared.unpersist()
    best = int(np.argmax(fitted.avgMetrics))
    return _kept(SearchResult(model_type, fitted.bestModel, settings[best], float(fitted.avgMetrics[best]), list(columns)), save_to)


def _kept(result: SearchResult, save_to: str | None) -> SearchResult:
    if save_to:
        result.model.write().overwrite().save(save_to)
    return result


def predict(model: PipelineModel, df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns and the prediction of every row."""
    named = df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(columns)])
    return model.transform(named).select(*keep, "prediction")


def score(result: SearchResult, df: DataFrame, label: str) -> float:
    said = predict(result.model, df, result.columns, [label])
    value = accuracy(said.withColumn(label, F.col(label).cast("double")), label, "prediction").first()[0]
    return float(value or 0.0)
