"""Statistical features of bounded blocks.

A block is a run of rows, 15 to 90 in practice; its length is read from the data and has no
limit but that a block fits into a task.  All requested calculators share one plan:

1. one shuffle by block key,
2. row columns - lags, leads, block statistics - from windows over the block,
3. one aggregation on the same key, which needs no further shuffle,
4. closing arithmetic on the aggregates.

Only what the requested calculators ask for enters the plan.  A calculator is a function
``(plan, **params) -> Column`` registered under its name; the result column is called
``<value>__<calculator>__<param>_<value>``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.scalar import count_if, known, ratio
from strideline.materialise import stored

#: Plans of more columns deal their blocks to tasks themselves, with so many values in each.
WIDE, CELLS = 256, 1 << 24

CALCULATORS: dict[str, Callable[..., Column]] = {}


def calculator(fn):
    CALCULATORS[fn.__name__] = fn
    return fn


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


class BlockPlan:
    """Collects the row columns and aggregates that the calculators ask for."""

    def __init__(self, keys: list[str], catalogue: dict[str, list[dict]] | None = None):
        wanted = catalogue or {}
        self.keys = keys
        # What several parameter sets of one calculator share.
        self.corridor_levels = sorted({float(g[k]) for g in wanted.get("change_quantiles", []) for k in ("ql", "qh")})
        self.partial_lags = max((g["lag"] for g in wanted.get("partial_autocorrelation", [])), default=0)
        self.x, self.i, self.n = F.col("_x"), F.col("_i"), F.col("_n")
        self.block = Window.partitionBy(*keys).orderBy("_i")
        self.whole = self.block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        self.so_far = self.block.rowsBetween(Window.unboundedPreceding, 0)
        self._rows: dict[int, dict[str, Column]] = {}
        self._aggs: dict[str, Column] = {}
        self._posts: dict[int, dict[str, Column]] = {}
        self._quantiles: list[float] = []

    def row(self, name: str, column: Column, level: int = 1) -> Column:
        """Row column; a column of one level may use those of lower levels."""
        self._rows.setdefault(level, {})[name] = column
        return F.col(f"`{name}`")

    def agg(self, name: str, column: Column | str) -> Column:
        """Aggregate, as a column or as SQL text (large grids are cheaper to build as text)."""
        self._aggs.setdefault(name, F.expr(column) if isinstance(column, str) else column)
        return F.col(f"`{name}`")

    def post(self, name: str, column: Column | str, level: int = 1) -> Column:
        """Column over the aggregates that several features use."""
        self._posts.setdefault(level, {}).setdefault(name, F.expr(column) if isinstance(column, str) else column)
        return F.col(f"`{name}`")

    # Row columns many calculators share.
    def mean_row(self) -> Column:
        return self.row("_mean", F.avg("_x").over(self.whole))

    def std_row(self) -> Column:
        return self.row("_std", F.stddev_pop("_x").over(self.whole))

    def min_row(self) -> Column:
        return self.row("_min", F.min("_x").over(self.whole))

    def max_row(self) -> Column:
        return self.row("_max", F.max("_x").over(self.whole))

    def lag_row(self) -> Column:
        return self.row("_lag1", F.lag("_x", 1).over(self.block))

    def lead_row(self, j: int) -> Column:
        return self.x if j == 0 else self.row(f"_lead{j}", F.lead("_x", j).over(self.block))

    # Aggregates many calculators share.
    def size(self) -> Column:
        return self.agg("_size", F.count(F.lit(1)))

    def mean(self) -> Column:
        return self.agg("_a_mean", F.avg("_x"))

    def std(self) -> Column:
        return self.agg("_a_std", F.stddev_pop("_x"))

    def var(self) -> Column:
        return self.agg("_a_var", F.var_pop("_x"))

    def low(self) -> Column:
        return self.agg("_a_min", F.min("_x"))

    def high(self) -> Column:
        return self.agg("_a_max", F.max("_x"))

    def quantile(self, q: float) -> Column:
        if q not in self._quantiles:
            self._quantiles.append(q)
        return F.get(F.col("_quantiles"), F.lit(self._quantiles.index(q)))

    def width(self) -> int:
        """Columns that the plan adds to a row or a block."""
        return sum(map(len, self._rows.values())) + len(self._aggs) + len(self._quantiles)

    def run(self, df: DataFrame, features: dict[str, Column]) -> DataFrame:
        rows = df
        for level in sorted(self._rows):
            rows = rows.withColumns(self._rows[level])
        aggs = dict(self._aggs)
        if self._quantiles:
            aggs["_quantiles"] = F.percentile("_x", F.array(*[F.lit(q) for q in self._quantiles]))
        grouped = rows.groupBy(*self.keys).agg(*[c.alias(n) for n, c in aggs.items()])
        for level in sorted(self._posts):
            grouped = grouped.withColumns(self._posts[level])
        return grouped.select(*self.keys, *[c.cast("double").alias(n) for n, c in features.items()])


# --- naming ----------------------------------------------------------------------------


def feature_name(value: str, name: str, params: dict) -> str:
    parts = [f'{k}_"{v}"' if isinstance(v, str) else f"{k}_{v}" for k, v in sorted(params.items())]
    return "__".join([value, name, *parts])


def parse_feature_names(names: list[str]) -> dict[str, dict[str, list[dict]]]:
    """Names back to ``{value: {calculator: [params, ...]}}``."""
    catalogue: dict[str, dict[str, list[dict]]] = {}
    for name in names:
        value, calc, *parts = name.split("__")
        if calc not in CALCULATORS and calc not in ARRAY_CALCULATORS:
            raise ValueError(f"unknown calculator in {name!r}")
        params = {}
        for part in parts:
            key, text = re.fullmatch(r"([a-z_]+?)_([-(\d'\"TF].*)", part).groups()
            params[key] = ast.literal_eval(text)
        catalogue.setdefault(value, {}).setdefault(calc, []).append(params)
    return catalogue


# --- one aggregation -------------------------------------------------------------------


@calculator
def sum_values(p):
    return p.agg("_a_sum", F.sum("_x"))


@calculator
def mean(p):
    return p.mean()


@calculator
def median(p):
    return p.quantile(0.5)


@calculator
def minimum(p):
    return p.low()


@calculator
def maximum(p):
    return p.high()


@calculator
def absolute_maximum(p):
    return p.agg("_a_absmax", F.max(F.abs("_x")))


@calculator
def length(p):
    return p.size()


@calculator
def standard_deviation(p):
    return p.std()


@calculator
def variance(p):
    return p.var()


@calculator
def abs_energy(p):
    return p.agg("_a_energy", F.sum(p.x * p.x))


@calculator
def root_mean_square(p):
    return F.sqrt(abs_energy(p) / p.size())


@calculator
def skewness(p):
    n = p.size()
    g = p.agg("_a_skew", F.skewness("_x"))
    flat = p.high() == p.low()
    return F.when(n > 2, F.when(flat, 0.0).otherwise(g * F.sqrt(n * (n - 1)) / (n - 2)))


@calculator
def kurtosis(p):
    n = p.size()
    g = p.agg("_a_kurt", F.kurtosis("_x"))
    flat = p.high() == p.low()
    return F.when(n > 3, F.when(flat, 0.0).otherwise(((n + 1) * g + 6) * (n - 1) / ((n - 2) * (n - 3))))


@calculator
def variance_larger_than_standard_deviation(p):
    return _flag(p.var() > p.std())


@calculator
def large_standard_deviation(p, r):
    return _flag(p.std() > F.lit(r) * (p.high() - p.low()))


@calculator
def quantile(p, q):
    return p.quantile(q)


@calculator
def value_count(p, value):
    return p.agg(f"_vc_{value}", count_if(p.x == value))


@calculator
def range_count(p, min, max):  # noqa: A002
    return p.agg(f"_rc_{min}_{max}", count_if((p.x >= min) & (p.x < max)))


@calculator
def count_above(p, t):
    return p.agg(f"_ca_{t}", F.avg(_flag(p.x >= t)))


@calculator
def count_below(p, t):
    return p.agg(f"_cb_{t}", F.avg(_flag(p.x <= t)))


@calculator
def has_duplicate_max(p):
    top = p.max_row()
    return _flag(p.agg("_at_max", count_if(p.x == top)) > 1)


@calculator
def has_duplicate_min(p):
    bottom = p.min_row()
    return _flag(p.agg("_at_min", count_if(p.x == bottom)) > 1)


def _value_rows(p: BlockPlan) -> tuple[Column, Column]:
    """How often the value of the row occurs and which occurrence it is."""
    same = Window.partitionBy(*p.keys, "_x")
    times = p.row("_times", F.count(F.lit(1)).over(same))
    nth = p.row("_nth", F.row_number().over(same.orderBy("_i")))
    return times, nth


def _distinct(p: BlockPlan) -> Column:
    _times, nth = _value_rows(p)
    return p.agg("_distinct", count_if(nth == 1))


@calculator
def has_duplicate(p):
    return _flag(_distinct(p) < p.size())


@calculator
def ratio_value_number_to_time_series_length(p):
    return _distinct(p) / p.size()


@calculator
def percentage_of_reoccurring_values_to_all_values(p):
    times, nth = _value_rows(p)
    return p.agg("_rep_values", count_if((times > 1) & (nth == 1))) / _distinct(p)


@calculator
def percentage_of_reoccurring_datapoints_to_all_datapoints(p):
    times, _nth = _value_rows(p)
    return p.agg("_rep_rows", count_if(times > 1)) / p.size()


@calculator
def sum_of_reoccurring_values(p):
    times, nth = _value_rows(p)
    return F.coalesce(p.agg("_rep_sum_once", F.sum(F.when((times > 1) & (nth == 1), p.x))), F.lit(0.0))


@calculator
def sum_of_reoccurring_data_points(p):
    times, _nth = _value_rows(p)
    return F.coalesce(p.agg("_rep_sum_all", F.sum(F.when(times > 1, p.x))), F.lit(0.0))


@calculator
def symmetry_looking(p, r):
    return _flag(F.abs(p.mean() - p.quantile(0.5)) < F.lit(r) * (p.high() - p.low()))


@calculator
def variation_coefficient(p):
    return ratio(p.std(), p.mean())


def _entropy(shares: list[Column]) -> Column:
    return -_total([F.when(s > 0, s * F.ln(s)).otherwise(0.0) for s in shares])


@calculator
def binned_entropy(p, max_bins):
    low, high = p.min_row(), p.max_row()
    width = (high - low) / max_bins
    number = F.when(high > low, F.least(F.floor((p.x - low) / width), F.lit(max_bins - 1))).otherwise(0)
    bin_no = p.row(f"_bin{max_bins}", number, level=2)
    counts = [p.agg(f"_bin{max_bins}_{b}", count_if(bin_no == b)) for b in range(max_bins)]
    return _entropy([c / p.size() for c in counts])


@calculator
def benford_correlation(p):
    size = F.abs(p.x)
    digit = p.row("_digit", F.when(size > 0, F.floor(size / F.pow(F.lit(10.0), F.floor(F.log10(size))))))
    shares = [p.agg(f"_digit{d}", count_if(digit == d)) / p.size() for d in range(1, 10)]
    expected = [F.log10(F.lit(1.0 + 1.0 / d)) for d in range(1, 10)]
    mean_s, mean_e = _total(shares) / 9, F.lit(1.0 / 9.0)
    cov = _total([(s - mean_s) * (e - mean_e) for s, e in zip(shares, expected)])
    var_s = _total([(s - mean_s) * (s - mean_s) for s in shares])
    var_e = _total([(e - mean_e) * (e - mean_e) for e in expected])
    return ratio(cov, F.sqrt(var_s * var_e))


# --- statistics of the block next to its rows --------------------------------------------


@calculator
def count_above_mean(p):
    return p.agg("_above_mean", count_if(p.x > p.mean_row()))


@calculator
def count_below_mean(p):
    return p.agg("_below_mean", count_if(p.x < p.mean_row()))


@calculator
def ratio_beyond_r_sigma(p, r):
    far = F.abs(p.x - p.mean_row()) > F.lit(r) * p.std_row()
    return p.agg(f"_beyond_{r}", F.avg(_flag(far)))


@calculator
def first_location_of_maximum(p):
    return p.agg("_first_max", F.min(F.when(p.x == p.max_row(), p.i))) / p.size()


@calculator
def first_location_of_minimum(p):
    return p.agg("_first_min", F.min(F.when(p.x == p.min_row(), p.i))) / p.size()


@calculator
def last_location_of_maximum(p):
    return (p.agg("_last_max", F.max(F.when(p.x == p.max_row(), p.i))) + 1) / p.size()


@calculator
def last_location_of_minimum(p):
    return (p.agg("_last_min", F.max(F.when(p.x == p.min_row(), p.i))) + 1) / p.size()


def _longest(p: BlockPlan, inside: Column, name: str) -> Column:
    """Longest run of rows where ``inside`` holds: distance to the last row outside."""
    broken = p.row(f"_broken_{name}", F.max(F.when(~inside, p.i)).over(p.so_far), level=2)
    run = p.agg(f"_run_{name}", F.max(F.when(inside, p.i - F.coalesce(broken, F.lit(-1)))))
    return F.coalesce(run, F.lit(0))


@calculator
def longest_strike_above_mean(p):
    return _longest(p, p.x > p.mean_row(), "above")


@calculator
def longest_strike_below_mean(p):
    return _longest(p, p.x < p.mean_row(), "below")


@calculator
def energy_ratio_by_chunks(p, num_segments, segment_focus):
    k = num_segments
    q, r = F.expr(f"_n div {k}L"), F.expr(f"_n % {k}L")
    start = F.lit(segment_focus) * q + F.least(F.lit(segment_focus).cast("bigint"), r)
    end = F.lit(segment_focus + 1) * q + F.least(F.lit(segment_focus + 1).cast("bigint"), r)
    inside = (p.i >= start) & (p.i < end)
    part = p.agg(f"_energy_{k}_{segment_focus}", F.sum(F.when(inside, p.x * p.x).otherwise(0.0)))
    return ratio(part, abs_energy(p))


@calculator
def index_mass_quantile(p, q):
    mass = p.row("_mass", F.sum(F.abs("_x")).over(p.so_far))
    total = p.row("_mass_all", F.sum(F.abs("_x")).over(p.whole))
    first = p.agg(f"_mass_{q}", F.min(F.when((total > 0) & (mass >= F.lit(q) * total), p.i + 1)))
    return first / p.size()


@calculator
def mean_n_absolute_max(p, number_of_maxima):
    order = Window.partitionBy(*p.keys).orderBy(F.abs("_x").desc(), "_i")
    place = p.row("_abs_place", F.row_number().over(order))
    top = p.agg(f"_absmax_{number_of_maxima}", F.avg(F.when(place <= number_of_maxima, F.abs(p.x))))
    return F.when(p.size() >= number_of_maxima, top)


# --- neighbours in the block -------------------------------------------------------------


@calculator
def mean_change(p):
    first, last = p.agg("_first_x", F.min_by("_x", "_i")), p.agg("_last_x", F.max_by("_x", "_i"))
    return F.when(p.size() > 1, (last - first) / (p.size() - 1))


@calculator
def mean_abs_change(p):
    return p.agg("_mean_abs_change", F.avg(F.abs(p.x - p.lag_row())))


@calculator
def absolute_sum_of_changes(p):
    return F.coalesce(p.agg("_sum_abs_change", F.sum(F.abs(p.x - p.lag_row()))), F.lit(0.0))


@calculator
def mean_second_derivative_central(p):
    bend = (p.lead_row(1) - 2 * p.x + p.lag_row()) / 2
    return p.agg("_bend", F.avg(bend))


@calculator
def cid_ce(p, normalize):
    step = p.x - p.lag_row()
    raw = F.sqrt(F.coalesce(p.agg("_sum_sq_change", F.sum(step * step)), F.lit(0.0)))
    return F.coalesce(ratio(raw, p.std()), F.lit(0.0)) if normalize else raw


@calculator
def c3(p, lag):
    product = p.x * p.lead_row(lag) * p.lead_row(2 * lag)
    return F.coalesce(p.agg(f"_c3_{lag}", F.avg(product)), F.lit(0.0))


@calculator
def time_reversal_asymmetry_statistic(p, lag):
    one, two = p.lead_row(lag), p.lead_row(2 * lag)
    return F.coalesce(p.agg(f"_tras_{lag}", F.avg(two * two * one - one * p.x * p.x)), F.lit(0.0))


@calculator
def autocorrelation(p, lag):
    p.mean_row()
    p.lead_row(lag)
    p.var()
    ahead = f"_lead{lag}" if lag else "_x"
    p.agg(f"_acov_{lag}", f"avg((_x - _mean) * ({ahead} - _mean))")
    return F.expr(f"CASE WHEN _a_var > 0 THEN _acov_{lag} / nullif(_a_var, 0) END")


@calculator
def agg_autocorrelation(p, f_agg, maxlag):
    name = f"_acf_{maxlag}"
    lags = F.array(*[autocorrelation(p, j) for j in range(1, maxlag + 1)])
    # A flat or one-row block counts as zero correlation throughout.
    usable = (p.var() > 0) & (p.size() > 1)
    p.post(name, F.when(usable, F.array_compact(lags)).otherwise(F.array(F.lit(0.0))))
    mean_name = p.post(f"{name}_mean", f"aggregate({name}, 0D, (a, v) -> a + v) / size({name})", level=2)
    if f_agg == "mean":
        return mean_name
    if f_agg == "var":
        return F.expr(f"aggregate({name}, 0D, (a, v) -> a + (v - {name}_mean) * (v - {name}_mean)) / size({name})")
    if f_agg == "median":
        p.post(f"{name}_sorted", f"array_sort({name})", level=2)
        return F.expr(
            f"(get({name}_sorted, (size({name}) - 1) div 2) + get({name}_sorted, size({name}) div 2)) / 2"
        )
    raise ValueError(f"unknown aggregate {f_agg!r}")


@calculator
def partial_autocorrelation(p, lag):
    """Levinson-Durbin recursion over the array of autocorrelations."""
    if lag == 0:
        return F.lit(1.0)
    p.size()
    p.post("_rho", F.array(F.lit(1.0), *[autocorrelation(p, j) for j in range(1, p.partial_lags + 1)]))
    start = F.struct(
        F.array().cast("array<double>").alias("phi"), F.lit(1.0).alias("err"),
        F.array().cast("array<double>").alias("found"),
    )

    def step(acc: Column, k: Column) -> Column:
        phi, err = acc["phi"], acc["err"]
        explained = F.aggregate(
            F.zip_with(phi, F.reverse(F.slice("_rho", F.lit(2), k - 1)), lambda a, b: a * b),
            F.lit(0.0), lambda a, v: a + v,
        )
        last = F.try_divide(F.get("_rho", k) - explained, err)
        grown = F.concat(F.zip_with(phi, F.reverse(phi), lambda a, b: a - last * b), F.array(last))
        return F.struct(
            grown.alias("phi"), (err * (F.lit(1.0) - last * last)).alias("err"),
            F.concat(acc["found"], F.array(last)).alias("found"),
        )

    p.post("_pacf", F.aggregate(F.sequence(F.lit(1), F.lit(p.partial_lags)), start, step, lambda acc: acc["found"]), level=2)
    return F.expr(f"CASE WHEN _size div 2 > {lag} THEN get(_pacf, {lag - 1}) END")


@calculator
def number_crossing_m(p, m):
    crossed = (p.x > m) != (p.lag_row() > m)
    return p.agg(f"_cross_{m}", count_if(crossed))


@calculator
def number_peaks(p, n):
    left = p.row(f"_left_{n}", F.max("_x").over(p.block.rowsBetween(-n, -1)))
    right = p.row(f"_right_{n}", F.max("_x").over(p.block.rowsBetween(1, n)))
    peak = (p.x > left) & (p.x > right) & (p.i >= n) & (p.i < p.n - n)
    return p.agg(f"_peaks_{n}", count_if(peak))


@calculator
def change_quantiles(p, f_agg, isabs, qh, ql):
    if ql >= qh:
        return F.lit(0.0)
    levels = F.array(*[F.lit(v) for v in p.corridor_levels])
    p.row("_levels", F.percentile("_x", levels).over(p.whole))
    p.lag_row()
    low, high = (f"_levels[{p.corridor_levels.index(v)}]" for v in (ql, qh))
    inside = f"_x BETWEEN {low} AND {high} AND _lag1 BETWEEN {low} AND {high}"
    step = "abs(_x - _lag1)" if isabs else "_x - _lag1"
    calc = {"mean": "avg", "var": "var_pop"}[f_agg]
    name = f"_corridor_{f_agg}_{isabs}_{p.corridor_levels.index(qh)}_{p.corridor_levels.index(ql)}"
    p.agg(name, f"{calc}(CASE WHEN {inside} THEN {step} END)")
    return F.expr(f"coalesce({name}, 0D)")


# --- trends ------------------------------------------------------------------------------


def two_sided_t(t: Column, dof: Column) -> Column:
    """P(|T| > t) for an integer number of degrees of freedom: a finite trigonometric sum."""
    theta = F.atan(F.abs(t) / F.sqrt(dof))
    sine, cosine = F.sin(theta), F.cos(theta)
    odd = dof % 2 == 1
    first = F.when(odd, cosine).otherwise(F.lit(1.0))
    steps = F.floor((dof - 2) / 2).cast("int")  # terms after the first

    def grow(acc: Column, k: Column) -> Column:
        factor = F.when(odd, (2.0 * k) / (2.0 * k + 1.0)).otherwise((2.0 * k - 1.0) / (2.0 * k))
        term = acc["term"] * cosine * cosine * factor
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    start = F.struct(first.alias("term"), first.alias("total"))
    count = F.when(odd, F.floor((dof - 3) / 2)).otherwise(steps).cast("int")
    numbers = F.when(count >= 1, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(numbers, start, grow, lambda acc: acc["total"])
    inner = F.when(
        odd, F.lit(2.0) / F.pi() * (theta + F.when(dof > 1, sine * total).otherwise(0.0))
    ).otherwise(sine * total)
    return F.lit(1.0) - inner


def _trend(p: BlockPlan, attr: str, name: str, y: str, x: str) -> Column:
    """Ordinary least squares of ``y`` on ``x``, both SQL text over row columns."""
    if attr in ("slope", "intercept"):
        return p.agg(f"{name}_{attr}", f"regr_{attr}({y}, {x})")
    for part in ("count", "syy", "sxx", "sxy"):
        p.agg(f"{name}_{part}", f"regr_{part}({y}, {x})")
    r = p.post(
        f"{name}_r",
        f"CASE WHEN {name}_count > 1 THEN greatest(-1D, least(1D, "
        f"coalesce({name}_sxy / nullif(sqrt({name}_syy * {name}_sxx), 0), 0D))) END",
    )
    if attr == "rvalue":
        return r
    if attr == "stderr":
        return F.expr(
            f"CASE WHEN {name}_count > 2 THEN sqrt(greatest(0D, (1 - {name}_r * {name}_r) * {name}_syy"
            f" / nullif({name}_sxx * ({name}_count - 2), 0))) WHEN {name}_count = 2 THEN 0D END"
        )
    if attr == "pvalue":
        # One minus r squared below rounding noise is a perfect fit.
        dof = F.expr(f"{name}_count - 2")
        t = F.expr(f"abs({name}_r) * sqrt(({name}_count - 2) / greatest(1e-20D, 1 - {name}_r * {name}_r))")
        return F.when(dof > 0, two_sided_t(p.post(f"{name}_t", F.when(dof > 0, t), level=2), dof))
    raise ValueError(f"unknown attribute {attr!r}")


@calculator
def linear_trend(p, attr):
    return _trend(p, attr, "_lt", "_x", "cast(_i AS double)")


@calculator
def agg_linear_trend(p, attr, chunk_len, f_agg):
    calc = {"max": F.max, "min": F.min, "mean": F.avg, "var": F.var_pop}[f_agg]
    number = f"_chunk_{chunk_len}"
    p.row(number, F.expr(f"_i div {int(chunk_len)}L"))
    chunk = Window.partitionBy(*p.keys, number)
    p.row(f"{number}_{f_agg}", calc("_x").over(chunk), level=2)
    # The first row of a chunk stands for the chunk.
    head = f"CASE WHEN _i % {int(chunk_len)} = 0 THEN {number}_{f_agg} END"
    return _trend(p, attr, f"_alt_{chunk_len}_{f_agg}", head, f"cast({number} AS double)")


@calculator
def linear_trend_timewise(p, attr):
    p.row("_t0", F.min("_t").over(p.whole))
    return _trend(p, attr, "_ltt", "_x", "(_t - _t0) / 3600000000D")


# --- spectrum ----------------------------------------------------------------------------


def _harmonic(p: BlockPlan, k: int, value: str, name: str) -> tuple[str, str]:
    """Real and imaginary part of the k-th Fourier coefficient of a row column."""
    angle = f"2 * pi() * {k} * _i / _n"
    p.agg(f"{name}_re_{k}", f"sum({value} * cos({angle}))")
    p.agg(f"{name}_im_{k}", f"-sum({value} * sin({angle}))")
    p.size()
    return f"{name}_re_{k}", f"{name}_im_{k}"


def _fourier_text(p: BlockPlan, attr: str, k: int) -> str:
    real, imag = _harmonic(p, k, "_x", "_dft")
    value = {
        "real": real,
        "imag": imag,
        "abs": f"sqrt({real} * {real} + {imag} * {imag})",
        "angle": f"degrees(atan2({imag}, {real}))",
    }[attr]
    return f"CASE WHEN _size div 2 >= {k} THEN {value} END"


@calculator
def fft_coefficient(p, attr, coeff):
    return F.expr(_fourier_text(p, attr, coeff))


@calculator
def cwt_coefficients(p, coeff, w, widths=None):
    """Convolution with the Ricker wavelet of width ``w`` at position ``coeff``."""
    p.size()
    points = f"least({10 * w}L, _n)"
    p.row(f"_tap_{w}", F.expr(f"({points} - 1) div 2 - _i"))
    p.row(f"_shift_{w}", F.expr(f"({points} - 1) div 2 - ({points} - 1) / 2 - _i"))
    scale = 2.0 / ((3.0 * w) ** 0.5 * 3.141592653589793 ** 0.25)
    square = f"power(({coeff} + _shift_{w}) / {w}D, 2D)"
    inside = f"{coeff} + _tap_{w} >= 0 AND {coeff} + _tap_{w} < {points}"
    name = f"_cwt_{w}_{coeff}"
    p.agg(name, f"sum(CASE WHEN {inside} THEN _x * {scale!r}D * (1 - {square}) * exp(-{square} / 2) ELSE 0D END)")
    return F.expr(f"CASE WHEN _size > {coeff} THEN {name} END")


@calculator
def permutation_entropy(p, dimension, tau):
    """Entropy of the orderings of ``dimension`` values ``tau`` rows apart."""
    values = [p.lead_row(j * tau) for j in range(dimension)]
    bits = [F.when(values[a] > values[b], 1 << place).otherwise(0)
            for place, (a, b) in enumerate(combinations(range(dimension), 2))]
    name = f"_order_{dimension}_{tau}"
    complete = values[-1].isNotNull()
    code = p.row(name, F.when(complete, _total(bits)), level=2)
    alike = p.row(f"{name}_n", F.count(F.lit(1)).over(Window.partitionBy(*p.keys, name)), level=3)
    rows = p.agg(f"{name}_rows", F.count(name))
    # Each row adds the log of its pattern's count; that sums to the entropy of the shares.
    mean_log = p.agg(f"{name}_log", F.avg(F.when(code.isNotNull(), F.ln(alike))))
    return F.ln(rows) - mean_log


# --- spectra of whole blocks and pairwise kernels, see block_kernels ---------------------------------------------------

from strideline.functions.block_kernels import ARRAY_CALCULATORS, array_features  # noqa: E402


def _known_rows(df: DataFrame, keys: list[str], index: str, value: str, time: str | None) -> DataFrame:
    columns = [*keys, known(value).alias("_x"), F.col(index).alias("_order")]
    if time:
        columns.append(F.col(time).cast("double").alias("_t"))
    return df.select(*columns).where(F.col("_x").isNotNull())


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("_order")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({
        "_i": (F.row_number().over(order) - 1).cast("bigint"),
        "_n": F.count(F.lit(1)).over(whole),
    }).drop("_order")


def prepare_blocks(df: DataFrame, keys: list[str], index: str, value: str, time: str | None = None) -> DataFrame:
    """Known values only, with a dense index and the block size next to every row."""
    return _numbered(_known_rows(df, keys, index, value, time), keys)


def dealt(rows: DataFrame, keys: list[str], width: int, cells: int = CELLS) -> DataFrame:
    """Whole blocks in as many tasks as give each about ``cells`` values, for rows that grow by ``width`` columns.

    Rows are small before the windows, so their size in the shuffle says nothing of what a task will hold.
    """
    rows = stored(rows, "rows")
    tasks = -(-rows.count() * width // cells)
    return rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), *keys)


def extract_features(
    df: DataFrame, keys: list[str], index: str, value: str, catalogue: dict[str, list[dict]],
    time: str | None = None,
) -> DataFrame:
    """One row per block, one column per requested feature.

    ``catalogue`` maps a calculator to the parameter sets wanted from it.
    """
    plan = BlockPlan(list(keys), catalogue)
    relational, kernels = {}, {}
    for name, grid in catalogue.items():
        if name == "linear_trend_timewise" and time is None:
            raise ValueError("linear_trend_timewise needs a time column")
        if name not in CALCULATORS and name not in ARRAY_CALCULATORS:
            raise ValueError(f"unknown calculator {name!r}")
        for params in grid:
            if name in ARRAY_CALCULATORS:
                kernels[feature_name(value, name, params)] = (name, params)
            else:
                relational[feature_name(value, name, params)] = CALCULATORS[name](plan, **params)
    rows = _known_rows(df, list(keys), index, value, time)
    if plan.width() > WIDE:
        rows = dealt(rows, list(keys), plan.width())
    rows = _numbered(rows, list(keys))
    wide = plan.run(rows, relational) if relational or not kernels else None
    if kernels:
        paired = array_features(rows, list(keys), kernels)
        wide = paired if wide is None else wide.join(paired, on=list(keys), how="inner")
    return wide


def default_catalogue(with_time: bool = False) -> dict[str, list[dict]]:
    """Every calculator with its usual parameters."""
    none: list[dict] = [{}]
    simple = [
        "sum_values", "mean", "median", "minimum", "maximum", "absolute_maximum", "length", "standard_deviation",
        "variance", "abs_energy", "root_mean_square", "skewness", "kurtosis",
        "variance_larger_than_standard_deviation", "has_duplicate_max", "has_duplicate_min", "has_duplicate",
        "ratio_value_number_to_time_series_length", "percentage_of_reoccurring_values_to_all_values",
        "percentage_of_reoccurring_datapoints_to_all_datapoints", "sum_of_reoccurring_values",
        "sum_of_reoccurring_data_points", "variation_coefficient", "benford_correlation", "count_above_mean",
        "count_below_mean", "first_location_of_maximum", "first_location_of_minimum", "last_location_of_maximum",
        "last_location_of_minimum", "longest_strike_above_mean", "longest_strike_below_mean", "mean_change",
        "mean_abs_change", "absolute_sum_of_changes", "mean_second_derivative_central", "sample_entropy",
    ]
    deciles = [round(0.1 * j, 1) for j in range(1, 10)]
    shares = [round(0.05 * j, 2) for j in range(20)]
    catalogue: dict[str, list[dict]] = {name: none for name in simple}
    catalogue.update({
        "large_standard_deviation": [{"r": r} for r in shares],
        "symmetry_looking": [{"r": r} for r in shares],
        "quantile": [{"q": q} for q in deciles if q != 0.5],
        "index_mass_quantile": [{"q": q} for q in deciles],
        "value_count": [{"value": v} for v in (0, 1, -1)],
        "range_count": [{"min": -1, "max": 1}],
        "count_above": [{"t": 0}],
        "count_below": [{"t": 0}],
        "binned_entropy": [{"max_bins": 10}],
        "ratio_beyond_r_sigma": [{"r": r} for r in (0.5, 1, 1.5, 2, 2.5, 3, 5, 6, 7, 10)],
        "energy_ratio_by_chunks": [{"num_segments": 10, "segment_focus": j} for j in range(10)],
        "mean_n_absolute_max": [{"number_of_maxima": 7}],
        "cid_ce": [{"normalize": b} for b in (True, False)],
        "c3": [{"lag": j} for j in (1, 2, 3)],
        "time_reversal_asymmetry_statistic": [{"lag": j} for j in (1, 2, 3)],
        "autocorrelation": [{"lag": j} for j in range(10)],
        "agg_autocorrelation": [{"f_agg": f, "maxlag": 40} for f in ("mean", "median", "var")],
        "partial_autocorrelation": [{"lag": j} for j in range(10)],
        "number_crossing_m": [{"m": m} for m in (0, -1, 1)],
        "number_peaks": [{"n": n} for n in (1, 3, 5, 10, 50)],
        "change_quantiles": [
            {"f_agg": f, "isabs": b, "qh": qh, "ql": ql}
            for ql in (0.0, 0.2, 0.4, 0.6, 0.8) for qh in (0.2, 0.4, 0.6, 0.8, 1.0) if ql < qh
            for b in (False, True) for f in ("mean", "var")
        ],
        "linear_trend": [{"attr": a} for a in ("pvalue", "rvalue", "intercept", "slope", "stderr")],
        "agg_linear_trend": [
            {"attr": a, "chunk_len": c, "f_agg": f}
            for a in ("rvalue", "intercept", "slope", "stderr") for c in (5, 10, 50) for f in ("max", "min", "mean", "var")
        ],
        "fft_coefficient": [{"attr": a, "coeff": k} for a in ("real", "imag", "abs", "angle") for k in range(100)],
        "fft_aggregated": [{"aggtype": a} for a in ("centroid", "variance", "skew", "kurtosis")],
        "fourier_entropy": [{"bins": b} for b in (2, 3, 5, 10, 100)],
        "spkt_welch_density": [{"coeff": k} for k in (2, 5, 8)],
        "cwt_coefficients": [
            {"coeff": k, "w": w, "widths": (2, 5, 10, 20)} for k in range(15) for w in (2, 5, 10, 20)
        ],
        "permutation_entropy": [{"dimension": d, "tau": 1} for d in (3, 4, 5, 6, 7)],
        "approximate_entropy": [{"m": 2, "r": r} for r in (0.1, 0.3, 0.5, 0.7, 0.9)],
        "ar_coefficient": [{"coeff": j, "k": 10} for j in range(11)],
    })
    if with_time:
        catalogue["linear_trend_timewise"] = [{"attr": a} for a in ("pvalue", "rvalue", "intercept", "slope", "stderr")]
    return catalogue
