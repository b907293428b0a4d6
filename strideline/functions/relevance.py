"""Feature tables: long and wide form, imputation, relevance tests and selection.

The long form ``(keys, feature, value)`` has as many features as the catalogue names, at
most a few thousand, so statistics per feature are small enough to broadcast.  The rows of
one feature are not: ranks are taken from value counts sorted into ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.features import parse_feature_names
from strideline.functions.scalar import known, ratio, two_sided_normal
from strideline.materialise import cut
from strideline.operators.signal import exact_quantiles


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def melt_features(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Wide to long; keeps ``keys`` (put the label among them to carry it along)."""
    names = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), [quoted(n) for n in names], "feature", "value")


def pivot_features(long: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Long to wide, one column per listed feature."""
    return long.where(F.col("feature").isin(features)).groupBy(*keys).pivot("feature", features).agg(F.first("value"))


def replay_catalogue(selected: list[str]) -> dict[str, dict[str, list[dict]]]:
    """What has to be computed to get exactly the selected features."""
    return parse_feature_names(selected)


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def imputation_values(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Median, maximum and minimum of the finite values of each feature: one row per feature."""
    finite = long.where(_finite(F.col(value)))
    ends = finite.groupBy(feature).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    middle = exact_quantiles(finite, value, [0.5], [feature]).select(feature, F.col("q0").alias("middle"))
    return ends.join(middle, on=feature, how="left")


def _imputed(v: Column, middle: Column, low: Column, high: Column) -> Column:
    filled = (
        F.when(v.isNull() | F.isnan(v), middle)
        .when(v == float("inf"), high)
        .when(v == float("-inf"), low)
        .otherwise(v)
    )
    return F.coalesce(filled, F.lit(0.0))


def impute(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Missing to the median, +inf to the maximum and -inf to the minimum of the feature.

    A feature without a finite value becomes zero.
    """
    # One row per feature of the catalogue.
    joined = long.join(F.broadcast(imputation_values(long, feature, value)), on=feature, how="left")
    filled = _imputed(F.col(value), F.col("middle"), F.col("low"), F.col("high"))
    return joined.withColumn(value, filled).select(*long.columns)


def impute_wide(wide: DataFrame, values: dict[str, dict[str, float]]) -> DataFrame:
    """The same for a wide table, with values found before, for example in the training part."""
    def column(name: str) -> Column:
        known = values.get(name, {})
        return _imputed(quoted(name).cast("double"), *(F.lit(known.get(k)).cast("double") for k in ("middle", "low", "high"))).alias(name)

    return wide.select(*[column(c) if c in values else quoted(c) for c in wide.columns])


def class_counts(long: DataFrame, label: str) -> DataFrame:
    """Rows of class 0 and 1 per distinct value of each feature."""
    hit = F.when(F.col(label) == 1, 1).otherwise(0)
    return (
        long.select("feature", known("value").alias("value"), hit.alias("_hit"))
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.sum("_hit").cast("bigint").alias("n1"), F.count(F.lit(1)).alias("rows"))
        .withColumn("n0", F.col("rows") - F.col("n1"))
    )


def _rank_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts sorted by (feature, value) -> one row per feature: rows, rows of class 1, their rank sum within the piece, ties.

    Batches stream through; a feature's sums are carried over the border of two batches.
    """
    part = TaskContext.get().partitionId()
    held: list | None = None

    def row(sums: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (sums[0], part, *sums[1:])], ["feature", "part", "rows", "n1", "r1", "ties"])

    for batch in batches:
        features = batch.column("feature").to_numpy(zero_copy_only=False)
        rows, n1 = (batch.column(c).to_numpy().astype(np.float64) for c in ("rows", "n1"))
        cuts = np.flatnonzero(np.concatenate(([True], features[1:] != features[:-1], [True]))) if len(features) else np.zeros(1, int)
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if held is not None and held[0] != features[i]:
                yield row(held)
                held = None
            name, before, ones, ranks, ties = held or [features[i], 0.0, 0.0, 0.0, 0.0]
            t = rows[i:j]
            rank = before + np.cumsum(t) - t + (t + 1) / 2
            held = [name, before + t.sum(), ones + n1[i:j].sum(), ranks + (n1[i:j] * rank).sum(), ties + (t * t * t - t).sum()]
    if held is not None:
        yield row(held)


def value_ranks(counts: DataFrame, keys: list[str], value: str, weight: str, out: str = "below") -> DataFrame:
    """Number of rows with a smaller value, for every distinct value of each group.

    Values are sorted into ranges, so no window holds more of a group than one range does; a later range starts
    behind all rows of the ranges before it.
    """
    keys = list(keys)
    # Written down, so that both uses see the same ranges.
    ranged = cut(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each group and range.
    before = ranged.groupBy(*keys, "_part").agg(F.sum(weight).alias("_rows")).select(*keys, "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    placed = ranged.withColumn("_before", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return placed.join(before, on=[*keys, "_part"], how="inner").withColumn(out, F.col("_offset") + F.col("_before")).select(*counts.columns, out)


def rank_sums(counts: DataFrame) -> DataFrame:
    """``(feature, _r1, _n1, _n0, _ties)`` from rows per distinct value and class.

    Counts are sorted into ranges once.  A range gives one row per feature, and the ranks of a later range
    grow by all rows of the ranges before it: rank sum plus rows of class 1 times that offset.
    """
    ranged = counts.select("feature", "value", "rows", "n1").repartitionByRange("feature", "value").sortWithinPartitions("feature", "value")
    pieces = ranged.mapInArrow(_rank_pieces, "feature string, part long, rows double, n1 double, r1 double, ties double")
    # One row for each feature and range.
    before = F.sum("rows").over(Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = pieces.withColumn("_before", F.coalesce(before, F.lit(0.0)))
    return placed.groupBy("feature").agg(
        F.sum(F.col("r1") + F.col("n1") * F.col("_before")).alias("_r1"), F.sum("n1").alias("_n1"),
        F.sum(F.col("rows") - F.col("n1")).alias("_n0"), F.sum("ties").alias("_ties"))


def real_feature_pvalues(counts: DataFrame) -> DataFrame:
    """Mann-Whitney test of each feature between the two classes.

    Average ranks for ties, tie-corrected deviation, continuity correction, two sided.
    """
    sums = rank_sums(counts)
    n1, n0 = F.col("_n1"), F.col("_n0")
    n = n1 + n0
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    deviation = F.sqrt(n1 * n0 / 12 * (n + 1 - ratio(F.col("_ties"), n * (n - 1))))
    z = F.greatest(F.lit(0.0), ratio(F.abs(u - n1 * n0 / 2) - 0.5, deviation))
    p = F.least(F.lit(1.0), two_sided_normal(z))
    return sums.select("feature", u.alias("statistic"), p.alias("p_value"))


#: Tables whose weights are multiplied up at once.
WALK = 1 << 14


def _weights(x: int, step: int, r: int, c: int, n: int) -> Iterator[np.ndarray]:
    """Weights of the tables next to ``x``, outwards, relative to that of ``x``, until they are zero.

    The weight of a table is that of its neighbour times a ratio of the four counts.
    """
    weight, last = 1.0, min(r, c) if step > 0 else max(0, r + c - n)
    while x != last and weight > 0:
        size = min(WALK, abs(last - x))
        at = x + step * np.arange(size, dtype=np.float64)
        up = (r - at) * (c - at) / ((at + 1) * (n - r - c + at + 1)) if step > 0 else at * (n - r - c + at) / ((r - at + 1) * (c - at + 1))
        chunk = weight * np.cumprod(up)
        yield chunk
        weight, x = float(chunk[-1]), x + step * size


def fisher_two_sided(k: int, r: int, c: int, n: int) -> float:
    """Share of the tables with these margins that are not more likely than the one with ``k``."""
    low, high = max(0, r + c - n), min(r, c)
    mode = min(high, max(low, (r + 1) * (c + 1) // (n + 2)))
    step = 1 if k >= mode else -1
    observed, left = 1.0, abs(k - mode)
    for chunk in _weights(mode, step, r, c, n) if left else ():
        observed = float(chunk[min(left, len(chunk)) - 1])
        left -= len(chunk)
        if left <= 0:
            break
    else:
        observed = 0.0 if left > 0 else observed
    limit, tail, total = observed * (1 + 1e-7), float(1.0 <= observed * (1 + 1e-7)), 1.0
    for way in (1, -1):
        for chunk in _weights(mode, way, r, c, n):
            total += float(chunk.sum())
            tail += float(chunk[chunk <= limit].sum())
    return min(1.0, tail / total)


def _fisher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = [fisher_two_sided(*t) for t in zip(*(batch.column(c).to_pylist() for c in ("k", "r", "c", "n")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("feature"), pa.array(p, pa.float64())], ["feature", "p_value"])


def binary_feature_pvalues(counts: DataFrame) -> DataFrame:
    """Fisher's exact test of features with two values, two sided.

    Sums the tables that are not more likely than the observed one, walking outwards from the likeliest table
    until a table has no weight in double precision.  One row per feature; time grows with the
    square root of the rows, memory doesn't grow.
    """
    tables = counts.groupBy("feature").agg(
        F.max_by("n1", "value").cast("bigint").alias("k"), F.max_by("rows", "value").cast("bigint").alias("r"),
        F.sum("n1").cast("bigint").alias("c"), F.sum("rows").cast("bigint").alias("n"))
    return tables.mapInArrow(_fisher, "feature string, p_value double")


def relevance_table(long: DataFrame, label: str, fdr_level: float = 0.01) -> DataFrame:
    """p-value and selection of every feature against a 0/1 label.

    Constant features are irrelevant and do not take part in the selection.
    """
    counts = cut(class_counts(long, label))
    kinds = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("_values"))
    kind = F.when(F.col("_values") == 1, "constant").when(F.col("_values") == 2, "binary").otherwise("real")
    kinds = kinds.select("feature", kind.alias("kind"))
    # One row per feature of the catalogue.
    typed = counts.join(F.broadcast(kinds), on="feature", how="inner")
    real = real_feature_pvalues(typed.where("kind = 'real'").select(*counts.columns)).select("feature", "p_value")
    binary = binary_feature_pvalues(typed.where("kind = 'binary'").select(*counts.columns))
    tested = kinds.join(real.unionByName(binary), on="feature", how="left")
    return select_fdr(tested, fdr_level)


def select_fdr(pvalues: DataFrame, fdr_level: float) -> DataFrame:
    """Benjamini-Yekutieli step-up over the features with a p-value; adds ``relevant``.

    The table has one row per feature of the catalogue, so one window over it is small.
    """
    tested = pvalues.where(F.col("p_value").isNotNull())
    order = Window.partitionBy().orderBy("p_value", "feature")
    everything = Window.partitionBy()
    ranked = tested.withColumns({
        "_rank": F.row_number().over(order),
        "_m": F.count(F.lit(1)).over(everything),
    })
    ranked = ranked.withColumn("_harmonic", F.sum(F.lit(1.0) / F.col("_rank")).over(everything))
    limit = F.col("_rank") * F.lit(fdr_level) / (F.col("_m") * F.col("_harmonic"))
    passed = ranked.withColumn("_last", F.max(F.when(F.col("p_value") <= limit, F.col("_rank"))).over(everything))
    chosen = F.coalesce(F.col("_rank") <= F.col("_last"), F.lit(False))
    selected = passed.select("feature", chosen.alias("relevant"))
    return pvalues.join(selected, on="feature", how="left").withColumn(
        "relevant", F.coalesce("relevant", F.lit(False))
    )
