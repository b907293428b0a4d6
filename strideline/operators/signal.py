"""Axis reduction, normalisation, outliers, smoothing and symbolic representation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement
from math import exp
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.scalar import known, ratio
from strideline.materialise import cut
from strideline.operators.cleaning import require_columns
from strideline.ordering import SLICE_ROWS, attach_stats, dense_index, int_div, with_halo

REDUCED = "acceleration_abs"

#: Letters of symbolic words.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def sax_breakpoints(alphabet: int, digits: int | None = 2) -> list[float]:
    """Quantiles of the standard normal distribution that cut it into equally likely letters.

    Published tables give two decimals; without ``digits`` the full precision is kept.
    """
    if not 2 <= alphabet <= len(LETTERS):
        raise ValueError(f"an alphabet has 2 to {len(LETTERS)} letters")
    cuts = [NormalDist().inv_cdf(i / alphabet) for i in range(1, alphabet)]
    return cuts if digits is None else [round(c, digits) for c in cuts]


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def l2_norm(df: DataFrame, columns: list[str], out: str = REDUCED) -> DataFrame:
    """Square root of the sum of squares; a missing axis counts as zero."""
    require_columns(df, columns)
    squares = [F.coalesce(known(c) * known(c), F.lit(0.0)) for c in columns]
    return df.withColumn(out, F.sqrt(_total(squares)))


def l1_norm(df: DataFrame, columns: list[str], out: str = REDUCED, signed: bool = False) -> DataFrame:
    """Sum of absolute values, or with ``signed`` the absolute value of the sum."""
    require_columns(df, columns)
    if signed:
        return df.withColumn(out, F.abs(_total([F.coalesce(known(c), F.lit(0.0)) for c in columns])))
    return df.withColumn(out, _total([F.coalesce(F.abs(known(c)), F.lit(0.0)) for c in columns]))


def covariance_terms(columns: list[str]) -> dict[tuple[str, str], Column]:
    """One sample covariance per pair of columns, over rows where all are known."""
    complete = reduce(lambda a, b: a & b, [known(c).isNotNull() for c in columns])
    value = {c: F.when(complete, known(c)) for c in columns}
    return {
        (a, b): F.covar_samp(value[a], value[b]) for a, b in combinations_with_replacement(columns, 2)
    }


def _direction_two(cov: DataFrame) -> DataFrame:
    """Eigenvector of the larger eigenvalue of a symmetric 2x2 matrix, not scaled."""
    a, b, c = F.col("_c00"), F.col("_c01"), F.col("_c11")
    top = (a + c) / 2 + F.sqrt((a - c) * (a - c) / 4 + b * b)
    flat = b == 0
    return cov.withColumns({
        "_v0": F.when(flat, F.when(a >= c, 1.0).otherwise(0.0)).otherwise(b),
        "_v1": F.when(flat, F.when(a >= c, 0.0).otherwise(1.0)).otherwise(top - a),
    })


def _direction_three(cov: DataFrame) -> DataFrame:
    """Eigenvector of the largest eigenvalue of a symmetric 3x3 matrix, not scaled.

    The eigenvalue follows from the trigonometric form of the cubic; the eigenvector is
    the longest cross product of two rows of the shifted matrix.  A matrix without any
    spread has no direction; the first axis stands in.
    """
    c = {(i, j): F.col(f"_c{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)}
    d = [F.col(f"_d{i}") for i in range(3)]
    mean = (c[0, 0] + c[1, 1] + c[2, 2]) / 3
    staged = cov.withColumn("_mean", mean).withColumns({f"_d{i}": c[i, i] - F.col("_mean") for i in range(3)})
    off = c[0, 1] * c[0, 1] + c[0, 2] * c[0, 2] + c[1, 2] * c[1, 2]
    det = (
        d[0] * (d[1] * d[2] - c[1, 2] * c[1, 2])
        - c[0, 1] * (c[0, 1] * d[2] - c[1, 2] * c[0, 2])
        + c[0, 2] * (c[0, 1] * c[1, 2] - d[1] * c[0, 2])
    )
    staged = staged.withColumns({
        "_spread": F.sqrt((d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + 2 * off) / 6),
        "_det": det,
    })
    spread = F.col("_spread")
    cosine = F.coalesce(ratio(F.col("_det"), 2 * spread * spread * spread), F.lit(0.0))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / 3
    staged = staged.withColumn("_top", F.col("_mean") + 2 * spread * F.cos(angle))
    staged = staged.withColumns({f"_e{i}": c[i, i] - F.col("_top") for i in range(3)})
    rows = [[F.col(f"_e{i}") if i == j else c[i, j] for j in range(3)] for i in range(3)]

    def cross(u: list[Column], v: list[Column]) -> Column:
        x, y, z = u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]
        return F.struct((x * x + y * y + z * z).alias("s"), x.alias("x"), y.alias("y"), z.alias("z"))

    staged = staged.withColumns({f"_p{k}": cross(rows[i], rows[j]) for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2)))})
    staged = staged.withColumn("_best", F.greatest("_p0", "_p1", "_p2"))
    some = F.col("_best.s") > 0
    return staged.withColumns({
        f"_v{i}": F.when(some, F.col(f"_best.{n}")).otherwise(1.0 if i == 0 else 0.0) for i, n in enumerate("xyz")
    })


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _direction_any(cov: DataFrame, k: int, sweeps: int = 12) -> DataFrame:
    """Eigenvector of the largest eigenvalue of a symmetric matrix of any size, by cyclic Jacobi rotations.

    The matrix and the product of the rotations are flat arrays; every rotation clears one pair of elements off
    the diagonal.  The squares off the diagonal fall quadratically with the sweeps.
    """
    pairs = [(p, q) for p in range(k) for q in range(p + 1, k)]
    cell = lambda a, i, j: F.get(a, i * k + j)
    places = F.sequence(F.lit(0), F.lit(k * k - 1))
    rows = F.array(*[F.lit(p) for p, _ in pairs])
    columns = F.array(*[F.lit(q) for _, q in pairs])

    def turned(a: Column, r: Column, by_column: bool) -> Column:
        """``a`` with columns (or rows) p and q replaced by their turned sums."""
        def element(e: Column) -> Column:
            i, j = F.floor(e / k).cast("int"), (e % k).cast("int")
            at, other = (j, i) if by_column else (i, j)
            one = cell(a, other, r["p"]) if by_column else cell(a, r["p"], other)
            two = cell(a, other, r["q"]) if by_column else cell(a, r["q"], other)
            return F.when(at == r["p"], r["c"] * one - r["s"] * two).when(at == r["q"], r["s"] * one + r["c"] * two).otherwise(F.get(a, e))

        return F.transform(places, element)

    def rotation(state: Column, step: Column) -> Column:
        p, q = F.get(rows, step % len(pairs)), F.get(columns, step % len(pairs))
        a = state["a"]
        apq, gap = cell(a, p, q), cell(a, q, q) - cell(a, p, p)
        # The smaller root of t^2 + 2 t gap / (2 apq) - 1 = 0, written without a division by zero.
        sign = F.when(gap * apq < 0, -1.0).otherwise(1.0)
        t = F.when(apq == 0, 0.0).otherwise(sign * 2 * F.abs(apq) / (F.abs(gap) + F.sqrt(gap * gap + 4 * apq * apq)))
        angle = _let(t, lambda x: F.struct(p.alias("p"), q.alias("q"), (1.0 / F.sqrt(1.0 + x * x)).alias("c"), (x / F.sqrt(1.0 + x * x)).alias("s")))
        return _let(angle, lambda r: F.struct(
            _let(turned(a, r, True), lambda half: turned(half, r, False)).alias("a"), turned(state["v"], r, True).alias("v")))

    matrix = F.array(*[F.col(f"_c{min(i, j)}{max(i, j)}").cast("double") for i in range(k) for j in range(k)])
    unit = F.array(*[F.lit(1.0 if i == j else 0.0) for i in range(k) for j in range(k)])
    steps = F.sequence(F.lit(0), F.lit(sweeps * len(pairs) - 1))
    solved = cov.withColumn("_e", F.aggregate(steps, F.struct(matrix.alias("a"), unit.alias("v")), rotation))
    top = F.greatest(*[F.struct(F.get("_e.a", F.lit(i * k + i)).alias("x"), F.lit(-i).alias("i")) for i in range(k)])
    solved = solved.withColumn("_top", -top["i"])
    return solved.withColumns({f"_v{i}": F.get("_e.v", F.lit(i * k) + F.col("_top")) for i in range(k)})


def principal_direction(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """Loadings ``_w0.._wk`` of the first principal component, per key, for two to ten axes.

    Signs are fixed so that the largest absolute loading is positive.
    """
    if not 2 <= len(columns) <= 10:
        raise ValueError("between two and ten axes")
    terms = covariance_terms(columns)
    named = {pair: f"_c{columns.index(pair[0])}{columns.index(pair[1])}" for pair in terms}
    cov = df.groupBy(*keys).agg(*[terms[p].alias(named[p]) for p in terms])
    closed = {2: _direction_two, 3: _direction_three}.get(len(columns))
    raw = closed(cov) if closed else _direction_any(cov, len(columns))
    v = [F.col(f"_v{i}") for i in range(len(columns))]
    largest = F.greatest(*[F.struct(F.abs(x).alias("a"), F.signum(x).alias("s")) for x in v])
    scale = F.sqrt(_total([x * x for x in v])) * F.when(largest["s"] < 0, -1.0).otherwise(1.0)
    return raw.withColumn("_scale", scale).select(*keys, *[(x / F.col("_scale")).alias(f"_w{i}") for i, x in enumerate(v)])


def pca_reduce(df: DataFrame, columns: list[str], keys: list[str] = (), out: str = REDUCED) -> DataFrame:
    """Projection of the uncentred rows on the first principal component of their group."""
    require_columns(df, columns)
    keys = list(keys)
    joined = attach_stats(df, principal_direction(df, columns, keys), keys)
    return joined.withColumn(
        out, _total([known(c) * F.col(f"_w{i}") for i, c in enumerate(columns)])
    ).select(*df.columns, out)


def reduce_axes(
    df: DataFrame, mode: str, columns: list[str], out: str = REDUCED, keys: list[str] = ()
) -> DataFrame:
    if mode == "euclidean":
        return l2_norm(df, columns, out)
    if mode in ("manhatten", "manhattan"):
        return l1_norm(df, columns, out)
    if mode == "pca":
        return pca_reduce(df, columns, keys, out)
    raise ValueError(f"unknown mode {mode!r}")


def normal_stats(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """Mean and sample standard deviation per column: ``mean_<c>``, ``std_<c>``."""
    require_columns(df, columns)
    aggs = []
    for c in columns:
        aggs += [F.avg(known(c)).alias(f"mean_{c}"), F.stddev_samp(known(c)).alias(f"std_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def znormalize(
    df: DataFrame, columns: list[str], keys: list[str] = (), stats: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(x - mean) / std``; returns the data and the statistics used.

    Pass the statistics of the training data to normalise other data the same way.
    A zero deviation gives null.
    """
    keys = list(keys)
    if stats is None:
        stats = normal_stats(df, columns, keys)
    scaled = {c: ratio(known(c) - F.col(f"mean_{c}"), F.col(f"std_{c}")) for c in columns}
    return attach_stats(df, stats, keys).withColumns(scaled).select(*df.columns), stats


def min_max_scale(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    require_columns(df, columns)
    keys = list(keys)
    aggs = []
    for c in columns:
        aggs += [F.min(known(c)).alias(f"_min_{c}"), F.max(known(c)).alias(f"_max_{c}")]
    joined = attach_stats(df, df.groupBy(*keys).agg(*aggs), keys)
    scaled = {
        c: ratio(known(c) - F.col(f"_min_{c}"), F.col(f"_max_{c}") - F.col(f"_min_{c}")) for c in columns
    }
    return joined.withColumns(scaled).select(*df.columns)


#: Rows of a range that are ranked value by value, and parts a larger range is cut into.
RANKED_ROWS, RANGE_PARTS = 1 << 16, 1 << 12


def _magnitude_part(x: Column) -> Column:
    """Whole numbers that grow with x, two for each power of two."""
    size = F.floor(2.0 * F.least(F.log2(F.abs(x)), F.lit(1025.0))) + 2200
    return F.when(x == 0, 0).otherwise(F.signum(x) * size).cast("bigint")


def exact_quantiles(
    df: DataFrame, column: str, probabilities: list[float], keys: list[str] = (), ranked_rows: int = RANKED_ROWS
) -> DataFrame:
    """Exact linear-interpolated quantiles ``q0..qn`` of groups of any size, by counts alone.

    A quantile lies between two ranks.  Each rank has a range of values that holds it, at first
    that of the whole group.  A pass counts the rows in parts of the range and keeps the part with the rank:
    parts of magnitude at first, then equal parts between the smallest and largest value in the range.
    A range of at most ``ranked_rows`` rows is counted value by value, which ends the search.  Every pass cuts a range to
    about a four-thousandth and no two doubles are closer than a 2^-52nd, so six passes do for any group.
    """
    keys = list(keys)
    rows = df.where(known(column).isNotNull()).select(*keys, known(column).alias("_x"))
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("low"), F.max("_x").alias("high"))
    wanted = [
        F.struct(F.lit(i).alias("q"), F.lit(up).alias("up"), (F.ceil if up else F.floor)(F.lit(p) * (F.col("_n") - 1)).cast("bigint").alias("rank"))
        for i, p in enumerate(probabilities) for up in (False, True)
    ]
    targets = ends.select(*keys, "_n", "low", "high", F.lit(0).cast("bigint").alias("below"), F.col("_n").alias("inside"), F.explode(F.array(*wanted)).alias("_w"))
    targets = targets.select(*keys, "_n", "_w.*", "low", "high", "below", "inside")
    target, first = [*keys, "q", "up"], True
    targets = cut(targets)
    while not targets.where("low < high").isEmpty():
        # Equal ranges of a group are counted once: most ranks share theirs until the last pass.
        ranges = targets.where("low < high").select(*keys, "low", "high", "inside").distinct()
        packed = ranges.groupBy(*keys).agg(F.collect_set(F.struct("low", "high", "inside")).alias("_r"))
        near = attach_stats(rows, packed, keys).select(*keys, "_x", F.explode("_r").alias("_r")).where("_x >= _r.low AND _x <= _r.high")
        x, low, high = F.col("_x"), F.col("_r.low"), F.col("_r.high")
        part = _magnitude_part(x) if first else F.floor((x - low) / (high - low) * (RANGE_PARTS - 1)).cast("bigint")
        few = F.col("_r.inside") <= ranked_rows
        counts = near.groupBy(*keys, F.col("_r.low").alias("low"), F.col("_r.high").alias("high"), F.when(few, x).alias("_v"), F.when(~few, part).alias("_part")).agg(
            F.count(F.lit(1)).alias("_m"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
        # A window holds the parts of a range, or its values where they are few.
        upto = F.sum("_m").over(Window.partitionBy(*keys, "low", "high").orderBy("_least").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_m"))
        open_ = targets.where("low < high").withColumn("_at", F.col("rank") - F.col("below"))
        same = [open_[c].eqNullSafe(counts[c]) for c in [*keys, "low", "high"]]
        hit = reduce(lambda p, q: p & q, same) & (counts["_before"] <= open_["_at"]) & (open_["_at"] < counts["_upto"])
        moved = open_.join(counts, hit).select(
            *(open_[c] for c in [*keys, "_n", "q", "up", "rank"]), counts["_least"].alias("low"), counts["_most"].alias("high"),
            (open_["below"] + counts["_before"]).alias("below"), counts["_m"].alias("inside"))
        targets = cut(targets.where("low >= high").unionByName(moved))
        first = False
    per = targets.groupBy(*keys, "q").agg(
        F.first("_n").alias("_n"), F.max(F.when(~F.col("up"), F.col("low"))).alias("_f"), F.max(F.when(F.col("up"), F.col("low"))).alias("_c"))
    chance = F.get(F.array(*[F.lit(float(p)) for p in probabilities]), F.col("q"))
    at = chance * (F.col("_n") - 1)
    exact = F.col("_f") + (F.col("_c") - F.col("_f")) * (at - F.floor(at))
    return per.withColumn("_q", exact).groupBy(*keys).agg(*[F.max(F.when(F.col("q") == i, F.col("_q"))).alias(f"q{i}") for i in range(len(probabilities))])


def trim_quantile(df: DataFrame, columns: list[str], quantile: float = 0.99, keys: list[str] = ()) -> DataFrame:
    """Keep rows between the ``1 - quantile`` and ``quantile`` quantiles, column after column."""
    require_columns(df, columns)
    keys = list(keys)
    kept = df
    for place, c in enumerate(columns):
        if place:
            kept = cut(kept)
        stats = exact_quantiles(kept, c, [1.0 - quantile, quantile], keys)
        kept = attach_stats(kept, stats, keys).where(known(c).between(F.col("q0"), F.col("q1"))).select(*df.columns)
    return kept


def trim_threshold(df: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    require_columns(df, columns)
    for c in columns:
        df = df.where(F.abs(known(c)) <= threshold)
    return df


def remove_outliers(
    df: DataFrame, mode: str, columns: list[str], quantile: float | None = None,
    threshold: float | None = None, keys: list[str] = (),
) -> DataFrame:
    if mode == "quantile":
        return trim_quantile(df, columns, quantile, keys)
    if mode == "threshold":
        return trim_threshold(df, columns, threshold)
    raise ValueError(f"unknown mode {mode!r}")


def drop_tail(df: DataFrame, keys: list[str], index: str, rows: int) -> DataFrame:
    """Drop the last ``rows`` rows by a dense 0-based index."""
    keys = list(keys)
    last = df.groupBy(*keys).agg(F.max(index).alias("_last"))
    return attach_stats(df, last, keys).where(F.col(index) <= F.col("_last") - rows).select(*df.columns)


def gaussian_rolling_sum(
    df: DataFrame, keys: list[str], pos: str, column: str, out: str,
    window: int = 5, std: float = 3.0, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Weighted sum of the last ``window`` values with Gaussian weights, fewer at the start.

    Rows are counted, not positions: holes in ``pos`` are closed first, so that slice borders
    don't show in the result.  Series without holes, which one count per series tells, keep their positions.
    """
    spans = df.groupBy(*keys).agg((F.max(pos) - F.min(pos) + 1 > F.count(F.lit(1))).alias("_holes"))
    holes = not spans.where("_holes").isEmpty()
    numbered = dense_index(df, keys, pos, "_dense", slice_rows) if holes else df.withColumn("_dense", F.col(pos).cast("bigint"))
    halo = with_halo(numbered, "_dense", before=window - 1, slice_rows=slice_rows)
    w = Window.partitionBy(*keys, "_slice").orderBy("_dense")
    centre = (window - 1) / 2
    terms = []
    for j in range(window):
        weight = exp(-0.5 * ((j - centre) / std) ** 2)
        value = F.col(column) if j == 0 else F.lag(column, j).over(w)
        terms.append(F.coalesce(value * weight, F.lit(0.0)))
    return halo.withColumn(out, _total(terms)).where("_core").select(*df.columns, out)


def _pairwise(df: DataFrame, columns: list[str], measure) -> DataFrame:
    pairs = [(a, b) for a in columns for b in columns]
    wide = df.agg(*[measure(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"_{i}").alias("value"))
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("_p")).select("_p.*")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, from one pass over the rows."""
    return _pairwise(df, columns, F.corr)


def covariance_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    return _pairwise(df, columns, F.covar_samp)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts of equal-width bins between the smallest and largest value."""
    x = known(column)
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(F.lit(1.0))
    bin_no = F.least(F.floor((x - F.col("_lo")) / width), F.lit(bins - 1)).cast("bigint")
    return (
        attach_stats(df, ends, []).where(x.isNotNull())
        .groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    )


def sax_words(
    df: DataFrame, keys: list[str], pos: str, column: str, frame: int, word: int, alphabet: int | Sequence[int] = 4,
    digits: int | None = 2,
) -> DataFrame:
    """Symbolic words: z-normalise the series, average frames, map to letters, join ``word`` letters.

    Several alphabets share the frames; their words come as rows with the size of the alphabet ahead of the word.
    """
    sizes = [alphabet] if isinstance(alphabet, int) else list(alphabet)
    breaks = {n: sax_breakpoints(n, digits) for n in sizes}
    scaled, _ = znormalize(df, [column], keys)
    frames = (
        scaled.withColumn("_frame", int_div(pos, frame))
        .groupBy(*keys, "_frame").agg(F.avg(column).alias("_paa"))
        .where(F.col("_paa").isNotNull())
    )

    def letter(n: int) -> Column:
        level = _total([F.when(F.col("_paa") >= b, 1).otherwise(0) for b in breaks[n]])
        return F.element_at(F.array(*map(F.lit, LETTERS[:n])), level + 1)

    # A frame has one letter for each alphabet, in one string.
    lettered = frames.withColumn("_letters", F.concat(*[letter(n) for n in sizes]))
    words = (
        lettered.withColumn("word_no", int_div("_frame", word))
        .groupBy(*keys, "word_no")
        .agg(F.array_sort(F.collect_list(F.struct("_frame", "_letters"))).alias("_l"))
    )

    def joined(place: int) -> Column:
        return F.array_join(F.transform(F.col("_l._letters"), lambda s: F.substring(s, place + 1, 1)), "").alias("word")

    if isinstance(alphabet, int):
        return words.select(*keys, "word_no", joined(0))
    every = F.array(*[F.struct(F.lit(n).alias("alphabet"), joined(i)) for i, n in enumerate(sizes)])
    return words.select(*keys, "word_no", F.inline(every))


def rerepresent(df: DataFrame, target: str, **options) -> DataFrame:
    if target == "SAX":
        return sax_words(df, **options)
    raise NotImplementedError(target)
