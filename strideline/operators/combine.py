"""Joins, unions and first/last rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.ordering import SLICE_ROWS, attach_stats, dense_index


def label_readings(
    labels: DataFrame, readings: DataFrame, on: list[str] = ("series_id", "pos"), check: bool = True
) -> DataFrame:
    """Put labels next to readings by series and position.

    The two inputs must cover the same positions; with ``check`` a row without a partner
    fails the query (both sides are needed for that, hence the full join).
    """
    on = list(on)
    if not check:
        return labels.join(readings, on=on, how="inner")
    left = labels.withColumn("_l", F.lit(True))
    right = readings.withColumn("_r", F.lit(True))
    joined = left.join(right, on=on, how="full_outer")
    complete = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    message = F.lit("labels and readings differ in length")
    return joined.where(F.when(complete, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("_l", "_r")


def join_complete(features: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join on the row key, then drop rows with anything missing."""
    return features.join(target, on=on, how="full_outer").na.drop("any")


def parameter_grid(radii: DataFrame, lengths: DataFrame) -> DataFrame:
    """Every (radius, length) pair; both inputs are short parameter lists of one column.

    Built by exploding the lengths next to each radius rather than by joining.
    """
    packed = lengths.agg(F.sort_array(F.collect_set("length")).alias("l")).select("l").scalar()
    return radii.select("radius", F.explode(packed).alias("length"))


def match_results(train: DataFrame, test: DataFrame, on: list[str] = ("radius", "length")) -> DataFrame:
    """Pair training and test results of the same parameters; unmatched ones are dropped."""
    return train.join(test, on=list(on), how="inner")


def keep_flagged(df: DataFrame, inliers: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in ``inliers``; apply it to features and target alike."""
    return df.join(inliers.select(*on), on=on, how="left_semi")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def head_rows(df: DataFrame, keys: list[str], pos: str, rows: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """First ``rows`` rows of each series by position rank."""
    ranked = dense_index(df, keys, pos, "_rank", slice_rows)
    return ranked.where(F.col("_rank") < rows).select(*df.columns)


def tail_rows(df: DataFrame, keys: list[str], pos: str, rows: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Last ``rows`` rows of each series by position rank."""
    ranked = dense_index(df, keys, pos, "_rank", slice_rows)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    return attach_stats(ranked, size, list(keys)).where(F.col("_rank") >= F.col("_size") - rows).select(*df.columns)
