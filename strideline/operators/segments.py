"""Label runs, fixed chunks, resampling and blocks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.scalar import known
from strideline.materialise import cut
from strideline.ordering import (
    SLICE_ROWS,
    attach_stats,
    dense_index,
    hierarchical_offsets,
    int_div,
    run_starts,
)

# Microseconds per resampling unit.
FREQ_MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "D": 86_400_000_000}
DAY_MICROS = 86_400_000_000
BINS_PER_BLOCK = 1 << 16


def freq_micros(freq: str) -> int:
    """``'1000ms'`` to microseconds.  Bins line up with midnight if they divide one day."""
    match = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", freq)
    if not match or match.group(2) not in FREQ_MICROS:
        raise ValueError(f"unknown frequency {freq!r}")
    micros = int(match.group(1) or 1) * FREQ_MICROS[match.group(2)]
    if micros < 1 or (DAY_MICROS % micros and micros % DAY_MICROS):
        raise ValueError(f"{freq!r} does not divide a day evenly")
    return micros


def label_rank(column: str, labels: list) -> Column:
    """Place of the label in the requested order; the caller filters other labels out."""
    rank = F.when(F.col(column) == labels[0], 0)
    for i, value in enumerate(labels[1:], start=1):
        rank = rank.when(F.col(column) == value, i)
    return rank


def segment_by_label(
    df: DataFrame, keys: list[str], pos: str, label: str, wanted: list,
    start: str = "run_start", rank: str = "label_rank", slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Rows with a wanted label and the run they belong to.

    A run breaks where the label changes or a position is missing.  ``(rank, start)`` is
    the order of the segments: first by place in ``wanted``, then by position.
    """
    if not wanted:
        raise ValueError("no labels to segment by")
    chosen = df.where(F.col(label).isin(list(wanted))).withColumn(rank, label_rank(label, list(wanted)))
    return run_starts(chosen, keys, pos, {start: [label]}, slice_rows)


def segment_nested(
    df: DataFrame, keys: list[str], pos: str, outer: str, outer_wanted: list, inner: str, inner_wanted: list,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Runs of the inner label inside runs of the outer one.

    Adds ``outer_rank, outer_start, inner_rank, inner_start``; in this order they sort the
    segments (not chronological inside an outer run).  An inner run never leaves its outer
    run because both need consecutive positions.
    """
    if not outer_wanted or not inner_wanted:
        raise ValueError("no labels to segment by")
    chosen = df.where(F.col(outer).isin(list(outer_wanted)))
    both = run_starts(chosen, keys, pos, {"outer_start": [outer], "inner_start": [outer, inner]}, slice_rows)
    ranks = {"outer_rank": label_rank(outer, list(outer_wanted)), "inner_rank": label_rank(inner, list(inner_wanted))}
    return both.where(F.col(inner).isin(list(inner_wanted))).withColumns(ranks)


SEGMENT_ORDER = ["outer_rank", "outer_start", "inner_rank", "inner_start"]


def chunk_evenly(df: DataFrame, keys: list[str], index: str, length: int, out: str = "chunk") -> DataFrame:
    """Cut n rows into ``n div length + 1`` nearly equal chunks.

    The first ``n mod N`` chunks have one row more.  Needs a dense 0-based index and adds
    the chunk number and ``chunk_size``.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    plan = (
        sizes.withColumn("_chunks", F.expr(f"_n div {int(length)}L + 1"))
        .withColumn("_q", F.expr("_n div _chunks"))
        .withColumn("_r", F.expr("_n % _chunks"))
    ).drop("_n", "_chunks")
    joined = attach_stats(df, plan, keys)
    in_long = F.col(index) < F.col("_r") * (F.col("_q") + 1)
    return (
        joined.withColumn(
            out,
            F.when(in_long, F.expr(f"`{index}` div (_q + 1)"))
            .otherwise(F.col("_r") + F.expr(f"(`{index}` - _r * (_q + 1)) div greatest(_q, 1L)")),
        )
        .withColumn("chunk_size", F.when(in_long, F.col("_q") + 1).otherwise(F.col("_q")))
        .select(*df.columns, out, "chunk_size")
    )


def exact_chunks(df: DataFrame, keys: list[str], index: str, length: int) -> DataFrame:
    """Only the chunks of :func:`chunk_evenly` that have exactly ``length`` rows."""
    return chunk_evenly(df, keys, index, length).where(F.col("chunk_size") == length)


def chunk_means(df: DataFrame, keys: list[str], index: str, length: int, columns: list[str]) -> DataFrame:
    """One mean row per exact chunk."""
    kept = exact_chunks(df, keys, index, length)
    return kept.groupBy(*keys, "chunk").agg(*[F.avg(known(c)).alias(c) for c in columns])


def segment_fixed(
    df: DataFrame, keys: list[str], index: str, length: int, aggregate: bool = False, exact: bool = False,
    columns: list[str] = (),
) -> DataFrame:
    if not exact:
        return chunk_evenly(df, keys, index, length)
    if not aggregate:
        return exact_chunks(df, keys, index, length)
    return chunk_means(df, keys, index, length, list(columns))


def resample(
    df: DataFrame, keys: list[str], time_us: str, freq: str, columns: list[str], mode: str = "mean",
    fill: bool = True, out: str = "bin_us",
) -> DataFrame:
    """Bin rows by time; with ``fill`` the bins between the first and last of a group exist too.

    An empty bin is null for ``mean`` and zero for ``sum``.  The bins of a group are
    listed in blocks so that no array grows with the span of the group.
    """
    keys = list(keys)
    if mode not in ("mean", "sum"):
        raise NotImplementedError(mode)
    micros = freq_micros(freq)
    calc = F.avg if mode == "mean" else F.sum
    start = F.expr(f"(`{time_us}` - pmod(`{time_us}`, {micros}L)) div {micros}L")
    binned = df.withColumn("_bin", start)
    values = binned.groupBy(*keys, "_bin").agg(*[calc(known(c)).alias(c) for c in columns])
    if fill:
        ends = binned.groupBy(*keys).agg(F.min("_bin").alias("_lo"), F.max("_bin").alias("_hi"))
        size = BINS_PER_BLOCK
        spine = (
            ends.withColumn("_block", F.explode(F.sequence(int_div("_lo", size), int_div("_hi", size))))
            .withColumn("_from", F.greatest(F.col("_lo"), F.col("_block") * size))
            .withColumn("_to", F.least(F.col("_hi"), F.col("_block") * size + (size - 1)))
            .where(F.col("_from") <= F.col("_to"))
            # The blocks of one group spread over the tasks before they become rows.
            .repartition(*keys, "_block")
            .select(*keys, F.explode(F.sequence("_from", "_to")).alias("_bin"))
        )
        values = spine.join(values, on=keys + ["_bin"], how="left")
    if mode == "sum":
        values = values.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})
    return values.select(*keys, (F.col("_bin") * micros).alias(out), *columns)


LEVEL_RANGE = 1 << 16


def desegment(
    df: DataFrame, within: list[str], levels: list[list[str]], row: str, columns: list[str], out: str = "pos",
) -> DataFrame:
    """Lay segments end to end and number the rows.

    ``levels`` order the segments inside ``within``; ``row`` is an integer that is dense
    inside a segment (a position or a bin number), so the new position is the offset of
    the segment plus the distance to its first row - no sort of the rows.
    """
    within = list(within)
    segment = [c for level in levels for c in level]
    sizes = df.groupBy(*within, *segment).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(row).alias("_first")
    )
    # A level told by a number, such as the start of a run, may have as many segments as the
    # series has rows; ranges of the number become a level of their own.
    kinds, spread = dict(sizes.dtypes), []
    for level in levels:
        if len(level) == 1 and kinds[level[0]] in ("int", "bigint"):
            sizes = sizes.withColumn(f"_range_{level[0]}", int_div(level[0], LEVEL_RANGE))
            spread.append([f"_range_{level[0]}"])
        spread.append(level)
    # One row per segment; every level reads it again.
    offsets = hierarchical_offsets(cut(sizes), spread, "_rows", "_offset", within=within)
    place = offsets.select(*within, *segment, "_offset", "_first")
    kept = list(dict.fromkeys([*within, *segment, *columns]))
    return (
        df.join(place, on=within + segment, how="inner")
        .withColumn(out, F.col("_offset") + F.col(row) - F.col("_first"))
        .select(*kept, out)
    )


def homogeneous_chunks(df: DataFrame, keys: list[str], chunk: str, label: str) -> DataFrame:
    """Rows of the chunks that carry exactly one known label."""
    w = Window.partitionBy(*keys, chunk)
    value = known(label)
    return (
        df.withColumn("_lo", F.min(value).over(w)).withColumn("_hi", F.max(value).over(w))
        .where(F.col("_lo") == F.col("_hi")).drop("_lo", "_hi")
    )


def number_blocks(
    df: DataFrame, keys: list[str], pos: str, length: int, block: str = "block_id", index: str = "idx",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Blocks of ``length`` consecutive surviving rows; the last one may be short."""
    return dense_index(df, keys, pos, index, slice_rows).withColumn(block, int_div(index, length))


def majority_label(df: DataFrame, keys: list[str], label: str, index: str, out: str = "label") -> DataFrame:
    """Most frequent label per block; of equally frequent ones the first seen."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("_n"), F.min(index).alias("_first")
    )
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct(F.col("_n"), -F.col("_first"))).alias(out))
