"""Row order as data.

A DataFrame has no row order, so every order-sensitive operator works on explicit
positions.  One series may hold a large share of all rows; nothing here therefore puts
a whole series into one window partition.  Windows run inside *slices* of at most
``slice_rows`` positions, and what has to cross a slice border travels either as

* halo rows - the few rows next to a border, copied into the neighbouring slice, or
* offsets - running totals over the small table that has one row per slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 1 << 20
SLICE_FANOUT = 1 << 10


def int_div(column: str, by: int) -> Column:
    """Integer quotient that stays integral (no detour through double)."""
    return F.expr(f"`{column}` div {int(by)}L")


def attach_stats(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Put group statistics next to the rows of the group.

    Without keys the statistics are one row and become a scalar subquery.  With keys it
    is an equi-join left to AQE, which broadcasts a small side after seeing its real size
    and splits a hot key otherwise.
    """
    names = [c for c in stats.columns if c not in keys]
    if keys:
        return df.join(stats, on=list(keys), how="left")
    packed = stats.select(F.struct(*names)).scalar()
    return (
        df.withColumn("_stats", packed)
        .select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("_stats")[n].alias(n) for n in names])
    )


def hierarchical_offsets(
    sizes: DataFrame, levels: list[list[str]], size: str, out: str, within: list[str] = ()
) -> DataFrame:
    """Exclusive running total of ``size`` in the lexicographic order of ``levels``.

    ``sizes`` has one row per ``within + all levels``.  Each level sums to its own prefix
    and runs only over its siblings, so no window is larger than one level's fan-out.
    """
    within = list(within)
    result = sizes
    parts = []
    prefix: list[str] = []
    for depth, level in enumerate(levels):
        upto = prefix + level
        totals = sizes.groupBy(*within, *upto).agg(F.sum(size).alias("_total"))
        siblings = within + prefix
        w = (Window.partitionBy(*siblings) if siblings else Window.partitionBy()).orderBy(*level)
        part = f"_part{depth}"
        before = F.sum("_total").over(w.rowsBetween(Window.unboundedPreceding, -1))
        offsets = totals.select(*within, *upto, F.coalesce(before, F.lit(0)).alias(part))
        result = result.join(offsets, on=within + upto, how="inner")
        parts.append(part)
        prefix = upto
    total = reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    return result.withColumn(out, total.cast("bigint")).drop(*parts)


def dense_index(
    df: DataFrame,
    keys: list[str],
    pos: str,
    out: str,
    slice_rows: int = SLICE_ROWS,
    ties: list[str] = (),
) -> DataFrame:
    """0-based rank of ``pos`` inside each ``keys`` group (one group when no keys).

    ``pos`` is a non-negative integer that may have holes.  Rows are ranked inside their
    slice; slices are shifted by the number of rows in the slices before them.
    """
    keys = list(keys)
    sliced = df.withColumn("_slice", int_div(pos, slice_rows))
    sizes = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_super", int_div("_slice", SLICE_FANOUT))
    )
    offsets = hierarchical_offsets(sizes, [["_super"], ["_slice"]], "_n", "_offset", within=keys)
    w = Window.partitionBy(*keys, "_slice").orderBy(pos, *ties)
    ranked = sliced.withColumn("_rank", F.row_number().over(w))
    return (
        ranked.join(offsets.select(*keys, "_slice", "_offset"), on=keys + ["_slice"], how="inner")
        .withColumn(out, F.col("_offset") + F.col("_rank") - 1)
        .select(*df.columns, out)
    )


def positions_by_time(
    df: DataFrame,
    keys: list[str],
    time: str,
    ties: list[str] = (),
    out: str = "pos",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Dense 0-based position of every row in its series, ordered by time then ``ties``.

    Only series longer than ``slice_rows`` are cut, into equal spans of time.  The table
    of such series has at most ``rows / slice_rows`` rows, which bounds the broadcast.
    """
    keys = list(keys)
    spans = df.groupBy(*keys).agg(
        F.min(time).alias("_t0"), F.max(time).alias("_t1"), F.count(F.lit(1)).alias("_n")
    )
    hot = spans.where(F.col("_n") > slice_rows).select(
        *keys,
        "_t0",
        F.expr(f"(_t1 - _t0) div (_n div {int(slice_rows)}L + 1) + 1").alias("_width"),
    )
    sliced = df.join(F.broadcast(hot), on=keys, how="left").withColumn(
        "_slice", F.coalesce(F.expr(f"(`{time}` - _t0) div _width"), F.lit(0).cast("bigint"))
    )
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    shift = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(shift), F.lit(0)).alias("_offset")
    )
    w = Window.partitionBy(*keys, "_slice").orderBy(time, *ties)
    return (
        sliced.withColumn("_rank", F.row_number().over(w))
        .join(offsets, on=keys + ["_slice"], how="inner")
        .withColumn(out, F.col("_offset") + F.col("_rank") - 1)
        .select(*df.columns, out)
    )


def with_halo(
    df: DataFrame, pos: str, before: int = 0, after: int = 0, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Copy border rows into the neighbouring slices; adds ``_slice`` and ``_core``.

    A window over ``(keys, _slice)`` then sees ``before`` rows ahead of the slice and
    ``after`` rows behind it; keep only ``_core`` rows of the result.
    """
    low = F.greatest(F.lit(0).cast("bigint"), F.col(pos) - after)
    return (
        df.withColumn("_low", low)
        .withColumn("_high", F.col(pos) + before)
        .withColumn(
            "_slice", F.explode(F.sequence(int_div("_low", slice_rows), int_div("_high", slice_rows)))
        )
        .withColumn("_core", F.col("_slice") == int_div(pos, slice_rows))
        .drop("_low", "_high")
    )


def run_starts(
    df: DataFrame,
    keys: list[str],
    pos: str,
    runs: dict[str, list[str]],
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Position of the first row of the run each row belongs to.

    ``runs`` maps an output column to the labels that make up a run: it ends where one of
    them changes or a position is missing.  Starts are found with one halo row; a run that
    began in an earlier slice is carried in by a table with one row per slice.
    """
    keys = list(keys)
    halo = with_halo(df, pos, before=1, slice_rows=slice_rows)
    w = Window.partitionBy(*keys, "_slice").orderBy(pos)
    adjacent = F.coalesce(F.lag(pos).over(w) == F.col(pos) - 1, F.lit(False))
    starts = {}
    for out, labels in runs.items():
        follows = reduce(lambda a, b: a & b, [F.lag(c).over(w).eqNullSafe(F.col(c)) for c in labels], adjacent)
        starts[f"_start_{out}"] = F.when(~follows, F.col(pos))
    marked = halo.withColumns(starts).where("_core")
    last = marked.groupBy(*keys, "_slice").agg(*[F.max(f"_start_{o}").alias(f"_last_{o}") for o in runs])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, "_slice", *[F.max(f"_last_{o}").over(earlier).alias(f"_carry_{o}") for o in runs])
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.withColumns({f"_run_{o}": F.max(f"_start_{o}").over(so_far) for o in runs})
        .join(carry, on=keys + ["_slice"], how="inner")
        .withColumns({o: F.coalesce(f"_run_{o}", f"_carry_{o}") for o in runs})
        .select(*df.columns, *runs)
    )
