"""Positional, stratified and balanced splits, folds and class shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.scalar import count_if, ratio
from strideline.operators.cleaning import portable_hash
from strideline.ordering import SLICE_FANOUT, attach_stats, dense_index, hierarchical_offsets, int_div

HASH_SLICE = 1 << 11


def global_index(df: DataFrame, series: str, index: str, out: str = "row") -> DataFrame:
    """Position over all series laid end to end in key order.

    ``index`` is dense inside a series and ``series`` an integer, so this is the offset
    of the series plus the index; no window over all rows.
    """
    sizes = (
        df.groupBy(series).agg(F.count(F.lit(1)).alias("_n")).withColumn("_super", int_div(series, SLICE_FANOUT))
    )
    offsets = hierarchical_offsets(sizes, [["_super"], [series]], "_n", "_offset").select(series, "_offset")
    return df.join(offsets, on=series, how="inner").withColumn(out, F.col("_offset") + F.col(index)).drop("_offset")


def split_three(df: DataFrame, row: str, train: float = 0.5, test: float = 0.25, valid: float = 0.25) -> DataFrame:
    """Adds ``part``: the first rows train, the last ones test then valid.

    Sizes are truncated, so a few rows after the training part may belong to none.
    """
    sizes = df.agg(F.count(F.lit(1)).alias("_n")).select(
        "_n",
        F.floor(F.col("_n") * train).alias("_train"),
        F.floor(F.col("_n") * test).alias("_test"),
        F.floor(F.col("_n") * valid).alias("_valid"),
    )
    r = F.col(row)
    part = (
        F.when(r >= F.col("_n") - F.col("_valid"), "valid")
        .when(r >= F.col("_n") - F.col("_valid") - F.col("_test"), "test")
        .when(r < F.col("_train"), "train")
    )
    return attach_stats(df, sizes, []).withColumn("part", part).where(F.col("part").isNotNull()).select(*df.columns, "part")


def split_two(df: DataFrame, row: str, share: float, last: bool, names: tuple[str, str]) -> DataFrame:
    """Cut off the first or the last ``share`` of rows; ``names`` is (cut part, rest)."""
    size = df.agg(F.count(F.lit(1)).alias("_n"))
    cut = F.floor(F.col("_n") * share)
    inside = F.col(row) >= F.col("_n") - cut if last else F.col(row) < cut
    return (
        attach_stats(df, size, [])
        .withColumn("part", F.when(inside, names[0]).otherwise(names[1]))
        .select(*df.columns, "part")
    )


def class_shares(df: DataFrame, label: str, wanted: list | None = None) -> DataFrame:
    """Rows and share of each label among the wanted ones."""
    kept = df if wanted is None else df.where(F.col(label).isin(list(wanted)))
    counts = kept.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = kept.agg(F.count(F.lit(1)).alias("_total"))
    return attach_stats(counts, total, []).withColumn("share", ratio(F.col("rows"), F.col("_total"))).drop("_total")


def hashed_rank(df: DataFrame, keys: list[str], row_key: str, seed: Column, out: str) -> DataFrame:
    """Rank of the rows of a group in a repeatable pseudo-random order."""
    hashed = df.withColumn("_hash", portable_hash(F.col(row_key), seed))
    return dense_index(hashed, keys, "_hash", out, HASH_SLICE, ties=[row_key]).drop("_hash")


def stratified_split(df: DataFrame, label: str, row_key: str, test_share: float = 0.3, seed: int = 0) -> DataFrame:
    """Random split with the same class shares in both parts; adds ``part``."""
    ranked = hashed_rank(df, [label], row_key, F.lit(seed), "_rank")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    part = F.when(F.col("_rank") < F.floor(F.col("_n") * test_share), "test").otherwise("train")
    return attach_stats(ranked, sizes, [label]).withColumn("part", part).select(*df.columns, "part")


def stratified_folds(df: DataFrame, label: str, row_key: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """Adds ``fold`` in 0..folds-1 with each class spread evenly."""
    ranked = hashed_rank(df, [label], row_key, F.lit(seed), "_rank")
    return ranked.withColumn("fold", (F.col("_rank") % folds).cast("int")).drop("_rank")


def try_splits(
    label_counts: DataFrame, series: str, hits: str, rows: str, first_seed: int, seeds: int, tries: int = 20_000
) -> DataFrame:
    """Shuffle the series once per seed and report the shares of each attempt.

    ``label_counts`` has one row per series: ``hits`` rows of the second class out of
    ``rows``.  The first half of a shuffle is training, the next quarter test, the rest
    validation.  An attempt is accepted if all three shares of ``hits`` lie inside the
    overall class shares widened by ``(seed + 1) / tries``.
    """
    totals = label_counts.agg(
        F.count(F.lit(1)).alias("_series"), F.sum(hits).alias("_h"), F.sum(rows).alias("_r")
    )
    shuffled = hashed_rank(
        label_counts.select(
            series, hits, rows,
            F.explode(F.sequence(F.lit(first_seed).cast("bigint"), F.lit(first_seed + seeds - 1).cast("bigint"))).alias("seed"),
        ),
        ["seed"], series, F.col("seed"), "_rank",
    )
    placed = attach_stats(shuffled, totals, [])
    part = (
        F.when(F.col("_rank") < F.floor(F.col("_series") * 0.5), 0)
        .when(F.col("_rank") < F.floor(F.col("_series") * 0.75), 1)
        .otherwise(2)
    )
    shares = [
        ratio(F.sum(F.when(part == i, F.col(hits))), F.sum(F.when(part == i, F.col(rows)))).alias(n)
        for i, n in enumerate(["train_share", "test_share", "valid_share"])
    ]
    tried = placed.groupBy("seed", "_h", "_r").agg(*shares)
    second = ratio(F.col("_h"), F.col("_r"))
    low, high = F.least(second, 1.0 - second), F.greatest(second, 1.0 - second)
    slack = (F.col("seed") + 1) / F.lit(tries)
    fits = [
        (F.col(n) > low - slack) & (F.col(n) < high + slack) for n in ("train_share", "test_share", "valid_share")
    ]
    accepted = F.coalesce(fits[0] & fits[1] & fits[2], F.lit(False))
    return tried.withColumn("accepted", accepted).drop("_h", "_r")


def find_balanced_split(
    label_counts: DataFrame, series: str, hits: str, rows: str, tries: int = 20_000, batch: int = 64
) -> dict | None:
    """First accepted attempt of :func:`try_splits`, searched in batches of seeds."""
    for first in range(0, tries, batch):
        attempts = try_splits(label_counts, series, hits, rows, first, min(batch, tries - first), tries)
        found = attempts.where("accepted").orderBy("seed").first()
        if found:
            return found.asDict()
    return None


def assign_parts(df: DataFrame, series: str, seed: int) -> DataFrame:
    """Give every row the part its series has under ``seed``."""
    ids = df.select(series).distinct()
    ranked = hashed_rank(ids, [], series, F.lit(seed), "_rank")
    total = ids.agg(F.count(F.lit(1)).alias("_series"))
    part = (
        F.when(F.col("_rank") < F.floor(F.col("_series") * 0.5), "train")
        .when(F.col("_rank") < F.floor(F.col("_series") * 0.75), "test")
        .otherwise("valid")
    )
    parts = attach_stats(ranked, total, []).select(series, part.alias("part"))
    return df.join(parts, on=series, how="inner")


def series_label_counts(df: DataFrame, series: str, label: str, wanted: list, second) -> DataFrame:
    """Rows with a wanted label per series and how many carry the ``second`` class."""
    kept = df.where(F.col(label).isin(list(wanted)))
    return kept.groupBy(series).agg(
        count_if(F.col(label) == second).alias("hits"), F.count(F.lit(1)).alias("rows")
    )
