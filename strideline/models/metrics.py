"""Scores, gates and model choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.functions.scalar import count_if, ratio
from strideline.ordering import attach_stats

# Order in which model types are tried; the first wins a tie.
MODEL_ORDER = ["svc", "cart_tree", "random_forrest", "mlp_classifier"]


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows per (actual, predicted) for every pair of labels seen on either side."""
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    # As many labels as there are classes.
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("actual")).distinct()
    packed = labels.agg(F.sort_array(F.collect_set("actual")).alias("l")).select("l").scalar()
    grid = labels.select("actual", F.explode(packed).alias("predicted"))
    return grid.join(counts, on=["actual", "predicted"], how="left").select(
        "actual", "predicted", F.coalesce("_n", F.lit(0)).alias("rows")
    )


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the two averages."""
    matrix = confusion_matrix(df, actual, predicted)
    sides = matrix.select(
        F.explode(F.array(
            F.struct(F.col("actual").alias("label"), F.col("rows").alias("real"), F.lit(0).cast("bigint").alias("said")),
            F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("real"), F.col("rows").alias("said")),
        )).alias("s"),
        F.when(F.col("actual") == F.col("predicted"), F.col("rows")).otherwise(0).alias("hit"),
    )
    per_class = sides.groupBy("s.label").agg(
        F.sum("s.real").alias("support"), F.sum("s.said").alias("said"), (F.sum("hit") / 2).alias("hits")
    )
    zero = F.lit(0.0)
    per_class = per_class.select(
        F.col("label").cast("string").alias("entry"),
        F.coalesce(ratio(F.col("hits"), F.col("said")), zero).alias("precision"),
        F.coalesce(ratio(F.col("hits"), F.col("support")), zero).alias("recall"),
        F.coalesce(ratio(2 * F.col("hits"), F.col("said") + F.col("support")), zero).alias("f1"),
        "support", "hits",
    )
    total = F.sum("support")
    none = F.lit(None).cast("double")
    totals = per_class.agg(F.array(
        F.struct(F.lit("accuracy").alias("entry"), none.alias("precision"), none.alias("recall"),
                 ratio(F.sum("hits"), total).alias("f1"), total.alias("support")),
        F.struct(F.lit("macro avg").alias("entry"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                 F.avg("f1").alias("f1"), total.alias("support")),
        F.struct(F.lit("weighted avg").alias("entry"), *[
            ratio(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in ("precision", "recall", "f1")],
            total.alias("support")),
    ).alias("_t")).select(F.explode("_t").alias("_r")).select("_r.*")
    return per_class.drop("hits").unionByName(totals)


def representative(df: DataFrame, combo: list[str], part: str, label: str, positive, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Per combination: is the share of ``positive`` strictly inside (low, high) in train and test?"""
    share = ratio(count_if(F.col(label) == positive), F.count(F.lit(1)))
    shares = df.groupBy(*combo, part).agg(share.alias("share"))
    inside = (F.col("share") > low) & (F.col("share") < high)
    return shares.groupBy(*combo).agg(
        F.max(F.when(F.col(part) == "train", F.col("share"))).alias("train_share"),
        F.max(F.when(F.col(part) == "test", F.col("share"))).alias("test_share"),
        (count_if(inside & F.col(part).isin("train", "test")) == 2).alias("distribution_ok"),
    )


def enough_rows(df: DataFrame, combo: list[str], part: str, folds: int) -> DataFrame:
    """Combinations that have at least ``folds`` rows in train and in test."""
    sizes = df.groupBy(*combo).agg(
        count_if(F.col(part) == "train").alias("train_rows"), count_if(F.col(part) == "test").alias("test_rows")
    )
    return sizes.where((F.col("train_rows") >= folds) & (F.col("test_rows") >= folds))


def best_model(scores: DataFrame) -> DataFrame:
    """Row with the highest score above zero; earlier combinations and model types win ties."""
    place = F.lit(len(MODEL_ORDER))
    for i, name in enumerate(MODEL_ORDER):
        place = F.when(F.col("model") == name, i).otherwise(place)
    ranked = scores.where(F.col("score") > 0).withColumn("_place", place)
    key = F.struct(F.col("score"), -F.col("combo"), -F.col("_place"))
    packed = F.max_by(F.struct(*scores.columns), key).alias("_b")
    return ranked.agg(packed).where(F.col("_b").isNotNull()).select("_b.*")


def run_summary(shares: DataFrame, scores: DataFrame, combo: list[str]) -> DataFrame:
    """One row per combination and model; combinations that were skipped have no model."""
    return shares.join(scores, on=combo, how="left")
