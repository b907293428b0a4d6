"""Matrix profile and motifs of a series.

The profile of n windows compares all of them, diagonal by diagonal: along a diagonal the dot
product of two windows is a running sum, so a comparison costs the same for any window
length; short windows are multiplied as matrices instead.  A unit is a band of diagonals over one slice of
the series.  It needs that slice and the two slices the band reaches, so a slice of full length travels to as
many tasks as the series has slices, twelve bytes a row and slice.  Units of shorter slices share a task, up to
``TILE_ROWS`` rows a side, and such a series travels once.  A unit of the shortest windows compares two
groups of ``GROUP_ROWS`` rows.  Only the best partner of each window comes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.functions.scalar import known
from strideline.materialise import cut, stored
from strideline.ordering import SLICE_ROWS, attach_stats, int_div, with_halo

TILE_ROWS = 8192
#: Cells that are compared at once, so that they stay in the cache of a core.
CELLS = 1 << 16
#: Longest windows that are put into boxes, rows of a group and of a box, and pairs that are compared without boxes.
BOXED, GROUP_ROWS, BOX, PLAIN = 16, 1 << 18, 64, 1 << 28
#: Longest windows that are multiplied as matrices, and the left and right windows of one product.
SHORT, LEFT, RIGHT = 64, 128, 512


def profile_zone(m: int) -> int:
    """Windows this close to each other never match in a profile."""
    return m // 4


def motif_zone(m: int) -> int:
    """Windows this close to an occurrence are not further occurrences."""
    return m // 2


# --- slices ------------------------------------------------------------------------------


def series_slices(df: DataFrame, keys: list[str], pos: str, value: str, m: int, slice_rows: int = TILE_ROWS) -> DataFrame:
    """``(keys, _slice, _from, _ps, _vs)``: the values of a slice and the m - 1 behind it.

    ``_ps`` holds the positions where some are missing, else it is empty and the values stand at ``_from`` and on.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(pos).cast("bigint").alias("_p"), known(value).alias("_v")).where("_v IS NOT NULL")
    packed = (
        with_halo(rows, "_p", after=m - 1, slice_rows=slice_rows)
        .groupBy(*keys, "_slice").agg(F.array_sort(F.collect_list(F.struct("_p", "_v"))).alias("_t"))
        .select(*keys, "_slice", F.col("_t._p").alias("_ps"), F.col("_t._v").alias("_vs"))
    )
    first = F.element_at("_ps", 1)
    whole = F.size("_ps") == F.element_at("_ps", -1) - first + 1
    return packed.select(*keys, "_slice", first.alias("_from"), F.when(whole, F.array().cast("array<bigint>")).otherwise(F.col("_ps")).alias("_ps"), "_vs")


def _laid_out(start: int, size: int, parts) -> np.ndarray:
    """Values at ``start`` and on, NaN where there is none; parts are (first position, positions, values)."""
    out = np.full(size, np.nan)
    for first, places, values in parts:
        at = (np.arange(first, first + len(values)) if not len(places) else places) - start
        inside = (at >= 0) & (at < size)
        out[at[inside]] = values[inside]
    return out


def _known_part(start: int, size: int, parts) -> np.ndarray:
    """As :func:`_laid_out`, up to the last value."""
    ends = [first + len(values) if not len(places) else places[-1] + 1 for first, places, values in parts if len(values)]
    return _laid_out(start, max(0, min(size, max(ends, default=start) - start)), parts)


class _Windows:
    """Windows of m values: shifted values, means, and scales that are zero where a window takes no part."""

    def __init__(self, values: np.ndarray, m: int, shift: float):
        view = np.lib.stride_tricks.sliding_window_view(values, m) if len(values) >= m else np.empty((0, m))
        std = view.std(axis=1)
        self.ok = std > 0
        self.x = np.nan_to_num(values - shift)
        self.mean = np.where(self.ok, view.mean(axis=1) - shift, 0.0)
        self.scale = np.where(self.ok, 1.0 / np.where(self.ok, std, 1.0), 0.0)
        self.m = m

    def __len__(self) -> int:
        return len(self.ok)

    def standard(self, at: np.ndarray) -> np.ndarray:
        rows = self.x[at[:, None] + np.arange(self.m)]
        return (rows - self.mean[at, None]) * self.scale[at, None]


def _nearest(left: _Windows, right: _Windows, lowest: int, highest: int):
    """Best partner of each window over the diagonals ``lowest`` to ``highest`` (exclusive) of (left, right).

    Gives for left and for right windows the number of the partner on the other side, -1 without one.
    Of equally near ones it is the first.
    """
    m, n = left.m, len(left)
    if m <= SHORT:
        return _nearest_short(left, right, lowest, highest)
    best, partner = np.full(n, -np.inf), np.full(n, -1)
    best_r, partner_r = np.full(len(right), -np.inf), np.full(len(right), -1)
    highest = min(highest, len(right))
    if n == 0 or lowest >= highest:
        return partner, partner_r
    pad = n + highest
    x = np.concatenate([right.x, np.zeros(max(0, pad + m - 1 - len(right.x)))])
    tail = np.zeros(max(0, pad - len(right)))
    mean, scale = np.concatenate([right.mean, tail]), np.concatenate([right.scale, tail])
    blocked = np.where(np.concatenate([right.ok, tail.astype(bool)]), 0.0, -np.inf)
    own = np.where(left.ok, 0.0, -np.inf)
    values, means, scales, blocks = (np.lib.stride_tricks.sliding_window_view(v, w) for v, w in ((x, n + m - 1), (mean, n), (scale, n), (blocked, n)))
    number = np.arange(n)
    for k0 in range(lowest, highest, max(1, CELLS // n)):
        k1 = min(highest, k0 + max(1, CELLS // n))
        sums = np.cumsum(left.x[None, : n + m - 1] * values[k0:k1], axis=1)
        dots = sums[:, m - 1 :].copy()
        dots[:, 1:] -= sums[:, : n - 1]
        close = (dots - m * left.mean * means[k0:k1]) * (left.scale * scales[k0:k1]) + (own + blocks[k0:k1])
        row = close.argmax(axis=0)
        top = close[row, number]
        better = top > best
        best[better], partner[better] = top[better], (number + k0 + row)[better]
        for k, line in enumerate(close, k0):
            size = min(n, len(right) - k)
            there, other = best_r[k : k + size], partner_r[k : k + size]
            better = (line[:size] >= there) & (line[:size] > -np.inf)
            there[better], other[better] = line[:size][better], number[:size][better]
    return partner, partner_r


def _nearest_short(left: _Windows, right: _Windows, lowest: int, highest: int):
    """The same from products of standard windows, which for short windows cost less than running sums."""
    mine, theirs = np.flatnonzero(left.ok), np.flatnonzero(right.ok)
    a, b = left.standard(mine), right.standard(theirs)
    partner, partner_r = np.full(len(left), -1), np.full(len(right), -1)
    best_r = np.full(len(theirs), -np.inf)
    for at in range(0, len(mine), LEFT):
        i = mine[at : at + LEFT]
        best = np.full(len(i), -np.inf)
        first, last = np.searchsorted(theirs, (i[0] + lowest, i[-1] + highest))
        for c in range(first, last, RIGHT):
            j = theirs[c : min(c + RIGHT, last)]
            close = a[at : at + LEFT] @ b[c : c + len(j)].T
            if j[0] - i[-1] < lowest or j[-1] - i[0] >= highest:
                gap = j[None, :] - i[:, None]
                close[(gap < lowest) | (gap >= highest)] = -np.inf
            top = close.max(axis=1)
            better = np.flatnonzero(top > best)
            if len(better):
                best[better], partner[i[better]] = top[better], j[close[better].argmax(axis=1)]
            top, there = close.max(axis=0), best_r[c : c + len(j)]
            better = np.flatnonzero(top > there)
            if len(better):
                there[better], partner_r[j[better]] = top[better], i[close[:, better].argmax(axis=0)]
    return partner, partner_r


def _box_order(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which each ``BOX`` rows in a row are near each other: halves along the widest axis."""
    out, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= BOX:
            out.append(rows)
            continue
        part = x[rows]
        line = part[:, np.ptp(part, axis=0).argmax()]
        half = -(-len(rows) // (2 * BOX)) * BOX
        order = np.argpartition(line, half - 1)
        open_ += [rows[order[half:]], rows[order[:half]]]
    return np.concatenate(out)


def _nearest_boxed(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, zone: int) -> np.ndarray:
    """Place of the best partner among the windows ``b`` of each window ``a``, -1 without one.

    Places ascend; windows up to ``zone`` apart are no partners.  Of equally near ones it is the first.
    """
    m = a.shape[1]
    tie = 1e-12 * m
    turn = np.linalg.eigh(b.T @ b)[1]
    seen_a, seen_b = a @ turn, b @ turn
    order_a, order_b = _box_order(seen_a), _box_order(seen_b)
    cuts = np.arange(0, len(b), BOX)
    low, high = (f.reduceat(seen_b[order_b], cuts) for f in (np.minimum, np.maximum))
    b, places = b[order_b], at_b[order_b]
    rank = np.empty(len(b), np.int64)
    rank[order_b] = np.arange(len(b))
    start_of, apart = np.full(len(cuts), -1), np.arange(-zone, zone + 1)
    partner = np.full(len(a), -1)
    for k in range(0, len(a), BOX):
        rows = order_a[k : k + BOX]
        mine, own = a[rows], seen_a[rows]
        gap = np.maximum(np.maximum(own.min(axis=0) - high, low - own.max(axis=0)), 0.0)
        gap = (gap * gap).sum(axis=1)
        turns = gap.argsort(kind="stable")
        gap = gap[turns]
        # Where the windows stand that are too close to be partners.
        near = at_a[rows][:, None] + apart
        found = np.minimum(np.searchsorted(at_b, near), len(at_b) - 1)
        who, what = np.nonzero(at_b[found] == near)
        taken = rank[found[who, what]]
        best, chosen = np.full(len(rows), -np.inf), np.full(len(rows), -1)
        done, step, open_, slot = 0, 4, np.arange(len(rows)), np.arange(len(rows))
        while done < (upto := np.searchsorted(gap, 2 * m - 2 * best[open_].min() + 1e-9, "right")):
            # Boxes come nearest first: a window that this one can't improve is done.
            open_ = open_[2 * m - 2 * best[open_] + 1e-9 >= gap[done]]
            slot[:] = -1
            slot[open_] = np.arange(len(open_))
            boxes = turns[done : min(done + step, upto)]
            done, step = done + len(boxes), min(2 * step, 32)
            sizes = np.minimum(BOX, len(b) - boxes * BOX)
            start_of[boxes] = np.cumsum(sizes) - sizes
            columns = (boxes[:, None] * BOX + np.arange(BOX)).ravel()
            columns = columns[columns < len(b)]
            close = mine[open_] @ b[columns].T
            there = start_of[taken // BOX]
            here = (there >= 0) & (slot[who] >= 0)
            close[slot[who[here]], there[here] + taken[here] % BOX] = -np.inf
            start_of[boxes] = -1
            top = close.max(axis=1)
            hit = np.flatnonzero((top >= best[open_] - tie) & (top > -np.inf))
            if len(hit):
                at, tops = open_[hit], top[hit]
                first = np.where(close[hit] >= tops[:, None] - tie, places[columns], np.iinfo(np.int64).max).min(axis=1)
                chosen[at] = np.where((tops > best[at] + tie) | (chosen[at] < 0), first, np.minimum(first, chosen[at]))
                best[at] = np.maximum(best[at], tops)
        partner[rows] = chosen
    return partner


def _distances(left: _Windows, i: np.ndarray, right: _Windows, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for k in range(0, len(i), 1024):
        gap = left.standard(i[k : k + 1024]) - right.standard(j[k : k + 1024])
        out[k : k + 1024] = np.sqrt((gap * gap).sum(axis=1))
    return out


def _group_pairs(mine: list, p: int, theirs: list, q: int, size: int, m: int, zone: int) -> list[tuple]:
    """Places, distances and partners of the windows of two groups of slices, each with its best partner in the other group."""
    if not mine or not theirs:
        return []
    x = _known_part(p * size, size + m - 1, mine)
    shift = float(np.nanmean(x)) if len(x) else 0.0
    left = _Windows(x, m, shift)
    right = left if p == q else _Windows(_known_part(q * size, size + m - 1, theirs), m, shift)
    i, j = np.flatnonzero(left.ok), np.flatnonzero(right.ok)
    if not len(i) or not len(j):
        return []
    ways = []
    if len(i) * len(j) <= PLAIN:
        to_right, to_left = _nearest(left, right, zone + 1 - (q - p) * size, size)
        i, j = np.flatnonzero(to_right >= 0), np.flatnonzero(to_left >= 0)
        ways = [(i, to_right[i], False), (to_left[j], j, True)]
    else:
        a, b = left.standard(i), right.standard(j)
        to_right = _nearest_boxed(a, i + p * size, b, j + q * size, zone)
        ways = [(i[to_right >= 0], to_right[to_right >= 0] - q * size, False)]
        if p != q:
            to_left = _nearest_boxed(b, j + q * size, a, i + p * size, zone)
            ways.append((to_left[to_left >= 0] - p * size, j[to_left >= 0], True))
    out = []
    for i, j, turned in ways:
        gaps, i_at, j_at = _distances(left, i, right, j), i + p * size, j + q * size
        out.append((j_at, gaps, i_at) if turned else (i_at, gaps, j_at))
    return out


def matrix_profile(
    df: DataFrame, keys: list[str], pos: str, value: str, m: int, zone: int | None = None,
    tile_rows: int = TILE_ROWS, slices: DataFrame | None = None,
) -> DataFrame:
    """Distance and position of the nearest other window of every window.

    ``distance`` is the z-normalised Euclidean distance.  Positions are dense per key;
    windows over a gap or without any deviation take no part.
    """
    keys = list(keys)
    zone = profile_zone(m) if zone is None else zone
    slices = series_slices(df, keys, pos, value, m, tile_rows) if slices is None else slices
    # Slices of one side of a task.
    per = max(1, (GROUP_ROWS if m <= BOXED else TILE_ROWS) // tile_rows)
    ends = slices.groupBy(*keys).agg(F.expr(f"min(_slice) div {per}L").alias("_first"), F.expr(f"max(_slice) div {per}L").alias("_last"))
    placed = attach_stats(slices.withColumn("_group", F.expr(f"_slice div {per}L")), ends, keys)
    here, first, last = (F.col(c) for c in ("_group", "_first", "_last"))
    none = F.array().cast("array<struct<p:bigint,q:bigint>>")

    def unit(p, q):
        return F.struct(p.alias("p"), q.alias("q"))

    as_left = F.transform(F.sequence(here, last), lambda q: unit(here, q))
    as_right = F.transform(F.sequence(first, here), lambda p: unit(p, here))
    # A band reaches one slice further, which may be the first of the next group.
    behind = F.when((F.col("_slice") % per == 0) & (here > first), F.transform(F.sequence(first, here - 1), lambda p: unit(p, here - 1))).otherwise(none)
    units = placed.select(*keys, "_slice", "_from", "_ps", "_vs", F.explode(F.array_distinct(F.concat(as_left, as_right, behind))).alias("_u"))
    units = units.select(*keys, F.col("_u.p").alias("_p"), F.col("_u.q").alias("_q"), "_slice", "_from", "_ps", "_vs")
    key_fields = [df.schema[k] for k in keys]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields), "pos bigint, distance double, partner bigint"])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        parts: dict[int, tuple] = {}
        for at, start, places, values in zip(*(table.column(c) for c in ("_slice", "_from", "_ps", "_vs")), strict=True):
            parts[at.as_py()] = (start.as_py(), np.asarray(places.values), np.asarray(values.values))
        p, q = key[-2].as_py(), key[-1].as_py()
        found: list[tuple] = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        if m <= BOXED:
            found += _group_pairs([v for c, v in parts.items() if c // per == p], p, [v for c, v in parts.items() if c // per == q], q, per * tile_rows, m, zone)
            parts = {}
        for a in sorted(c for c in parts if c // per == p):
            low = a * tile_rows
            x = _known_part(low, tile_rows + m - 1, [parts[a]])
            shift = float(np.nanmean(x)) if len(x) else 0.0
            left = _Windows(x, m, shift)
            for c in range(max(a, q * per), min((q + 1) * per, max(parts) + 1)):
                low_r, whole = c * tile_rows, [parts[r] for r in (c, c + 1) if r in parts]
                right = _Windows(_known_part(low_r, 2 * tile_rows + m - 1, whole), m, shift)
                to_right, to_left = _nearest(left, right, max(0, zone + 1 - (c - a) * tile_rows), tile_rows)
                i, j = np.flatnonzero(to_right >= 0), np.flatnonzero(to_left >= 0)
                found.append((i + low, _distances(left, i, right, to_right[i]), to_right[i] + low_r))
                found.append((j + low_r, _distances(left, to_left[j], right, j), to_left[j] + low))
        places, gaps, partners = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.lexsort((partners, gaps, places))
        order = order[np.diff(places[order], prepend=-1) > 0]
        columns = [pa.array([k.as_py()] * len(order), k.type) for k in key[:-2]]
        names = [*keys, "pos", "distance", "partner"]
        return pa.Table.from_arrays([*columns, pa.array(places[order], pa.int64()), pa.array(gaps[order]), pa.array(partners[order], pa.int64())], names)

    # A unit of few bytes takes seconds here, so units are not put together by their bytes.
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    units = units.repartition(tasks, *keys, "_p", "_q")
    best = units.groupBy(*keys, "_p", "_q").applyInArrow(compare, schema)
    return best.groupBy(*keys, "pos").agg(
        F.min("distance").alias("distance"), F.min(F.struct("distance", "partner"))["partner"].alias("partner")
    )


def _away(rows: DataFrame, occurrences: DataFrame, keys: list[str], zone: int) -> DataFrame:
    """Rows that stand within ``zone`` of no occurrence.

    An occurrence meets rows in the one or two ranges of positions that its zone touches.  Sizes of tables on disk say
    little about their rows here, so joins of this module never broadcast a side that grows with the series.
    """
    width = 2 * zone + 1
    ranges = F.array_distinct(F.array(F.expr(f"(pos - {zone}) div {width}L"), F.expr(f"(pos + {zone}) div {width}L")))
    marks = occurrences.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("pos").alias("_mark"), F.explode(ranges).alias("_at"))
    same = [F.col(k) == F.col(f"_k{n}") for n, k in enumerate(keys)]
    close = [F.col("_range") == F.col("_at"), F.abs(F.col("pos") - F.col("_mark")) <= zone]
    placed = rows.withColumn("_range", int_div("pos", width))
    return placed.join(marks.hint("merge"), on=reduce(lambda a, b: a & b, same + close), how="left_anti").drop("_range")


# --- greedy choice -----------------------------------------------------------------------

CHOSEN, OPEN, GONE = 1, 0, -1


def _settle(pos: np.ndarray, distance: np.ndarray, state: np.ndarray, low: float | np.ndarray, high: float | np.ndarray, zone: int) -> np.ndarray:
    """Greedy choice as far as what lies between ``low`` and ``high``, of all or of each candidate, decides it.

    ``state`` tells what is chosen already.  A candidate stays open when a better one near it is open, or
    may stand where nothing is known.
    """
    left, right = np.searchsorted(pos, pos - zone, "left"), np.searchsorted(pos, pos + zone, "right")
    unseen = (pos - zone < low) | (pos + zone > high)
    out = np.where(state == CHOSEN, CHOSEN, 2)
    for c in np.lexsort((pos, distance)):
        if out[c] != CHOSEN:
            near = out[left[c] : right[c]]
            out[c] = GONE if (near == CHOSEN).any() else OPEN if unseen[c] or (near == OPEN).any() else CHOSEN
    return out


def _starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """First rows of the runs of equal values in ``names``."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in names:
        code = table.column(name).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _settled_groups(table: pa.Table, starts: np.ndarray, zone: int, slice_rows: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that stay and their states, of many slices that stand one behind the other, each in order of position."""
    pos, distance, state, slices = (table.column(c).to_numpy() for c in ("pos", "distance", "state", "_slice"))
    ends = np.append(starts[1:], len(pos)) - 1
    # Slices are laid out further apart than a zone reaches.
    spans = pos[ends] - pos[starts] + 2 * zone + 2
    moved = np.repeat(np.cumsum(spans) - spans - pos[starts], np.diff(np.append(starts, len(pos))))
    low = slices * slice_rows - shift + moved
    # Up to a zone beyond each border every candidate is here.
    done = _settle(pos + moved, distance, state, low - zone, low + slice_rows - 1 + zone, zone)
    kept = table.column("_core").to_numpy() & (done != GONE)
    return kept, done


def _settled_slices(left: DataFrame, keys: list[str], zone: int, slice_rows: int, shift: int) -> DataFrame:
    """One pass over slices; rows that are gone are left out.  The slices of a batch are judged together."""
    moved = left.withColumn("_at", F.col("pos") + shift)
    group = [*keys, "_slice"]
    halo = with_halo(moved, "_at", before=zone, after=zone, slice_rows=slice_rows).repartition(*group).sortWithinPartitions(*group, "pos")

    def judged(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept, done = _settled_groups(table.combine_chunks(), starts, zone, slice_rows, shift)
        out = table.select([*keys, "pos", "distance"]).filter(pa.array(kept))
        yield from out.append_column("state", pa.array(done[kept].astype(np.int32))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            starts = _starts(held, group)
            if len(starts) > 1:
                # The last slice may go on in the next batch.
                yield from judged(held.slice(0, starts[-1]), starts[:-1])
                held = held.slice(starts[-1])
        if held is not None:
            yield from judged(held, _starts(held, group))

    return cut(halo.mapInArrow(run, left.schema))


def _settled_stream(left: DataFrame, keys: list[str], zone: int) -> DataFrame:
    """What no slice could decide: chains of candidates across several slices, in order of position.

    Of each series only the undecided candidates and one zone before them are held.
    """
    ordered = (left.repartition(*keys) if keys else left.repartition(1)).sortWithinPartitions(*keys, "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, limit = None, 4096

        def flush(last: bool):
            nonlocal held
            if not held:
                return []
            pos = np.array([r[-3] for r in held])
            high = np.inf if last else pos[-1]
            done = _settle(pos, np.array([r[-2] for r in held]), np.array([r[-1] for r in held]), -np.inf, high, zone)
            open_ = np.flatnonzero(done == OPEN)
            keep = pos[open_[0]] - zone if len(open_) else (np.inf if last else pos[-1] - zone)
            out = [(*r[:-1], CHOSEN) for r, s in zip(held, done, strict=True) if s == CHOSEN and r[-3] < keep]
            held = [(*r[:-1], int(s)) for r, s in zip(held, done, strict=True) if s != GONE and r[-3] >= keep]
            return out

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        arrow = None
        for b in batches:
            arrow, ready = b.schema, []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[:-3] != now:
                    ready += flush(True)
                    limit = 4096
                now = row[:-3]
                held.append(row)
                if len(held) >= limit:
                    ready += flush(False)
                    limit = max(4096, 2 * len(held))
            if ready:
                yield batch(ready)
        if held and arrow is not None:
            yield batch(flush(True))

    return cut(ordered.mapInArrow(run, left.schema))


def suppress_neighbours(
    candidates: DataFrame, keys: list[str], zone: int, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Greedy choice by distance where a chosen window removes all within ``zone`` of it.

    Slices decide what depends on nothing beyond them, then slices moved by half decide what hangs
    together across a border.  Chains longer than that, such as a series of equal distances, where each choice
    waits for the one before, are decided in one ordered stream for each series.
    """
    keys = list(keys)
    start = candidates.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.col("distance").cast("double").alias("distance"), F.lit(OPEN).alias("state"))
    left = _settled_slices(start, keys, zone, slice_rows, 0)
    if not left.where(F.col("state") == OPEN).isEmpty():
        left = _settled_slices(left, keys, zone, slice_rows, slice_rows // 2)
        if not left.where(F.col("state") == OPEN).isEmpty():
            left = _settled_stream(left, keys, zone)
    return left.where(F.col("state") == CHOSEN).select(*keys, "pos", "distance")


def motif_seed(profile: DataFrame, keys: list[str]) -> DataFrame:
    """The closest pair of windows of each series."""
    best = F.min(F.struct("distance", "pos", "partner")).alias("_b")
    packed = profile.groupBy(*keys).agg(best).where(F.col("_b").isNotNull())
    return packed.select(*keys, "_b.pos", "_b.partner", "_b.distance")


def _seed_distances(x: np.ndarray, seed: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``x`` that take part, and how far each of them is from the seed; none if the seed takes no part."""
    shift = float(seed.mean())
    pattern = _Windows(seed, m, shift)
    if not len(pattern) or not pattern.ok[0]:
        return np.empty(0, np.int64), np.empty(0)
    own = _Windows(x, m, shift)
    whole = np.flatnonzero(own.ok)
    return whole, _distances(own, whole, pattern, np.zeros(len(whole), np.int64))


def windows_near(slices: DataFrame, keys: list[str], seeds: DataFrame, m: int, tile_rows: int) -> DataFrame:
    """``(keys, radius, pos, distance)`` of all windows within ``radius`` times the seed's distance of the seed.

    ``seeds`` has ``(keys, radius, pos, distance)``, one row per series and radius; windows are cut from the slices.
    """
    at = F.when(F.size("_ps") == 0, F.col("pos") - F.col("_from") + 1).otherwise(F.array_position("_ps", F.col("pos"))).cast("int")
    homes = seeds.select(*keys, "radius", "pos", "distance", F.expr(f"pos div {tile_rows}L").alias("_slice"))
    patterns = slices.hint("merge").join(homes, on=[*keys, "_slice"], how="inner").select(
        *keys, "radius", F.slice("_vs", at, F.lit(m)).alias("_seed"), (F.col("distance") * F.col("radius")).alias("_limit"))
    # Without keys the patterns are as many as the radii asked for.
    one = F.lit(0).alias("_one")
    both = slices.hint("merge").join(patterns, on=keys) if keys else slices.select("*", one).join(F.broadcast(patterns.select("*", one)), on="_one")
    key_fields = "".join(f"`{k}` {slices.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, gaps, held, last = [], [], [], 0, None
            for i in range(b.num_rows):
                here = b.column("_slice")[i].as_py() * tile_rows
                part = (b.column("_from")[i].as_py(), np.asarray(b.column("_ps")[i].values), np.asarray(b.column("_vs")[i].values))
                seed = np.asarray(b.column("_seed")[i].values)
                # Radii of a slice come one behind the other, often with the same seed.
                now = (here, part[0], part[1], part[2], seed)
                if last is None or not all(map(np.array_equal, now, last)):
                    last, whole, found = now, *_seed_distances(_known_part(here, tile_rows + m - 1, [part]), seed, m)
                kept = found <= b.column("_limit")[i].as_py()
                rows.append(np.full(int(kept.sum()), i))
                starts.append(whole[kept] + here)
                gaps.append(found[kept])
                held += len(rows[-1])
                if held >= CELLS:
                    yield packed(b, rows, starts, gaps)
                    rows, starts, gaps, held = [], [], [], 0
            if rows:
                yield packed(b, rows, starts, gaps)

    def packed(b: pa.RecordBatch, rows: list, starts: list, gaps: list) -> pa.RecordBatch:
        at = pa.array(np.concatenate(rows))
        columns = [b.column(k).take(at) for k in [*keys, "radius"]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(starts), pa.int64()), pa.array(np.concatenate(gaps))], [*keys, "radius", "pos", "distance"])

    return both.mapInArrow(run, f"{key_fields}radius double, pos bigint, distance double")


def motifs_of_radii(
    df: DataFrame, keys: list[str], pos: str, value: str, m: int, radii: list[float], max_motifs: int = 2,
    profile: DataFrame | None = None, slice_rows: int = SLICE_ROWS, tile_rows: int = TILE_ROWS, slices: DataFrame | None = None,
) -> DataFrame:
    """Occurrences ``(keys, radius, tag, pos, distance)`` of the best motifs of each series, for all radii together.

    A motif is the closest remaining pair plus every window within ``radius`` times its
    distance, nearest first, none within half a window of another occurrence.  ``distance``
    is that of the pair.  Bounded number of jobs for each motif, whatever the number of radii.
    """
    keys, group = list(keys), [*keys, "radius"]
    zone = motif_zone(m)
    slices = stored(series_slices(df, keys, pos, value, m, tile_rows), "slices") if slices is None else slices
    profile = cut(profile if profile is not None else matrix_profile(df, keys, pos, value, m, tile_rows=tile_rows, slices=slices))
    open_profile = profile.withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    found: list[DataFrame] = []
    for tag in range(1, max_motifs + 1):
        seed = cut(motif_seed(open_profile, group))
        ends = seed.select(*group, F.explode(F.array("pos", "partner")).alias("pos"), "distance")
        taken = ends.select(*group, "pos")
        for part in found:
            taken = taken.unionByName(part.select(*group, "pos"))
        near = windows_near(slices, keys, seed.select(*group, "pos", "distance"), m, tile_rows)
        candidates = _away(near, taken, group, zone)
        further = suppress_neighbours(candidates, group, zone, slice_rows)
        far = further.select(*group, "pos").join(seed.select(*group, "distance").hint("merge"), on=group)
        occurrences = stored(ends.unionByName(far).withColumn("tag", F.lit(tag)).select(*group, "tag", "pos", "distance"), "occurrences")
        found.append(occurrences)
        open_profile = _away(open_profile, occurrences, group, zone)
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def top_motifs(
    df: DataFrame, keys: list[str], pos: str, value: str, m: int, radius: float, max_motifs: int = 2,
    profile: DataFrame | None = None, slice_rows: int = SLICE_ROWS, tile_rows: int = TILE_ROWS, slices: DataFrame | None = None,
) -> DataFrame:
    """Occurrences ``(keys, tag, pos, distance)`` of the best motifs of each series for one radius."""
    return motifs_of_radii(df, keys, pos, value, m, [radius], max_motifs, profile, slice_rows, tile_rows, slices).drop("radius")


MOTIF_COLUMNS = ["mean", "tag", "std", "min", "max", "distance"]


def motif_features(
    df: DataFrame, keys: list[str], pos: str, value: str, occurrences: DataFrame, m: int, columns: int = 6,
    by: list[str] = (), slices: DataFrame | None = None, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """One row per occurrence with the first ``columns`` of mean, tag, std, min, max, distance.

    ``by`` names columns of the occurrences that tell sets of them apart.  An occurrence goes to its slice, which holds
    the whole window, so windows become rows only behind the join, where they are summed up again at once.
    """
    if not 1 <= columns <= len(MOTIF_COLUMNS):
        raise ValueError(f"between 1 and {len(MOTIF_COLUMNS)} columns")
    keys = list(keys)
    slices = series_slices(df, keys, pos, value, m, tile_rows) if slices is None else slices
    spread = occurrences.select(
        *keys, *by, F.col("tag").alias("_tag"), F.col("pos").cast("bigint").alias("occurrence"), F.col("distance").alias("_distance"),
        F.expr(f"pos div {tile_rows}L").alias("_slice"),
    )
    at = F.col("occurrence") - F.col("_from") + 1
    start = F.greatest(at, F.lit(1)).cast("int")
    dense = F.slice("_vs", start, F.greatest(F.lit(0), m - (start - at)).cast("int"))
    inside = F.filter(F.arrays_zip("_ps", "_vs"), lambda t: (t["_ps"] >= F.col("occurrence")) & (t["_ps"] < F.col("occurrence") + m))
    window = F.when(F.size("_ps") == 0, dense).otherwise(F.transform(inside, lambda t: t["_vs"]))
    rows = spread.join(slices.hint("merge"), on=[*keys, "_slice"], how="inner").select(
        *keys, *by, "_tag", "occurrence", "_distance", F.explode(window).alias("_v"))
    made = {
        "mean": F.avg("_v"), "tag": F.first("_tag").cast("double"), "std": F.stddev_pop("_v"),
        "min": F.min("_v"), "max": F.max("_v"), "distance": F.first("_distance"),
    }
    wanted = MOTIF_COLUMNS[:columns]
    out = rows.groupBy(*keys, *by, F.col("_tag").alias("motif"), "occurrence").agg(
        *[made[c].alias(c) for c in wanted]
    )
    return out.na.drop("any", subset=wanted)


def motif_labels(df: DataFrame, keys: list[str], pos: str, label: str, occurrences: DataFrame, by: list[str] = ()) -> DataFrame:
    """Label of the first row of every occurrence."""
    keys = list(keys)
    labels = df.select(*keys, F.col(pos).cast("bigint").alias("occurrence"), F.col(label).alias("label"))
    starts = occurrences.select(*keys, *by, F.col("tag").alias("motif"), F.col("pos").alias("occurrence"))
    return starts.join(labels.hint("merge"), on=keys + ["occurrence"], how="inner").where(F.col("label").isNotNull())


def sweep_motifs(
    df: DataFrame, keys: list[str], pos: str, value: str, label: str | None, radii: list[float], lengths: list[int],
    max_motifs: int = 2, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Features and labels of every (radius, length) pair.

    The profile depends on the length only and is computed once per length; the radii of a
    length go through the same jobs.  A length longer than the series finds nothing and adds no rows.
    """
    parts = []
    for m in lengths:
        slices = stored(series_slices(df, keys, pos, value, m), "slices")
        occurrences = motifs_of_radii(df, keys, pos, value, m, radii, max_motifs, None, slice_rows, slices=slices)
        rows = motif_features(df, keys, pos, value, occurrences, m, by=["radius"], slices=slices)
        if label is not None:
            labels = motif_labels(df, keys, pos, label, occurrences, ["radius"])
            rows = rows.join(labels.hint("merge"), on=[*keys, "radius", "motif", "occurrence"], how="inner")
        parts.append(cut(rows.withColumn("length", F.lit(m))))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def infer_motifs(
    df: DataFrame, keys: list[str], pos: str, value: str, *, radius: float, length: int, label: str | None = None,
    max_motifs: int = 2,
) -> DataFrame:
    """Motif features of new data for one (radius, length), with labels if there are any."""
    return sweep_motifs(df, keys, pos, value, label, [radius], [length], max_motifs)
