"""Features of whole blocks: spectra, comparisons of every row with every other, small systems.

A block is gathered into one array; the kernels then work on whole Arrow batches
of such arrays.  Pairs are compared inside the kernel and never become rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARRAY_CALCULATORS: dict[str, Callable[..., float]] = {}


def kernel(fn):
    ARRAY_CALCULATORS[fn.__name__] = fn
    return fn


def _windows(x: np.ndarray, m: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, m)


def _close_counts(x: np.ndarray, m: int, tolerance: float) -> np.ndarray:
    """For every window of length m, how many windows lie within ``tolerance`` of it."""
    w = _windows(x, m)
    gap = np.zeros((len(w), len(w)))
    for j in range(m):
        np.maximum(gap, np.abs(w[:, j, None] - w[None, :, j]), out=gap)
    return (gap <= tolerance).sum(axis=1)


@kernel
def sample_entropy(x: np.ndarray) -> float:
    if len(x) < 4:
        return np.nan
    tolerance = 0.2 * x.std()
    shorter = (_close_counts(x, 2, tolerance) - 1).sum()
    longer = (_close_counts(x, 3, tolerance) - 1).sum()
    return -np.log(longer / shorter) if longer and shorter else np.nan


@kernel
def approximate_entropy(x: np.ndarray, m: int, r: float) -> float:
    if len(x) <= m + 1:
        return 0.0
    tolerance = r * x.std()

    def phi(size: int) -> float:
        counts = _close_counts(x, size, tolerance)
        return float(np.log(counts / len(counts)).mean())

    return abs(phi(m) - phi(m + 1))


@kernel
def ar_coefficient(x: np.ndarray, coeff: int, k: int) -> float:
    """Least-squares autoregression of order k with a constant term."""
    if coeff > k or len(x) <= 2 * k + 1:
        return np.nan
    target = x[k:]
    lagged = [x[k - j : len(x) - j] for j in range(1, k + 1)]
    design = np.column_stack([np.ones(len(target)), *lagged])
    return float(np.linalg.lstsq(design, target, rcond=None)[0][coeff])


def _standard_windows(x: np.ndarray, m: int) -> np.ndarray:
    w = _windows(x, m)
    std = w.std(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(std > 0, (w - w.mean(axis=1, keepdims=True)) / std, np.nan)


@kernel
def matrix_profile(x: np.ndarray, feature: str, m: int) -> float:
    """Summary of the distances of all windows to their nearest other window."""
    zone = -(-m // 2)
    if len(x) < m + zone + 1:
        return np.nan
    z = _standard_windows(x, m)
    d = np.sqrt(np.maximum(0.0, 2 * m - 2 * (z @ z.T)))
    place = np.arange(len(d))
    d[np.abs(place[:, None] - place[None, :]) <= zone] = np.inf
    d[np.isnan(d)] = np.inf
    profile = d.min(axis=1)
    profile = profile[np.isfinite(profile)]
    if not len(profile):
        return np.nan
    summary = {"min": np.min, "max": np.max, "mean": np.mean, "median": np.median}
    if feature in summary:
        return float(summary[feature](profile))
    return float(np.percentile(profile, float(feature)))


@kernel
def query_similarity_count(x: np.ndarray, query: tuple, threshold: float) -> float:
    """Windows whose z-normalised distance to ``query`` is at most ``threshold``."""
    q = np.asarray(query, dtype=float)
    if len(x) < len(q) or q.std() == 0:
        return np.nan
    z = _standard_windows(x, len(q))
    d = np.sqrt(np.maximum(0.0, 2 * len(q) - 2 * (z @ ((q - q.mean()) / q.std()))))
    return float(np.sum(d <= threshold))


@kernel
def fft_aggregated(x: np.ndarray, aggtype: str) -> float:
    """Moments of the amplitude spectrum, the coefficient number being the variable."""
    amplitude = np.abs(np.fft.rfft(x))
    total = amplitude.sum()
    if total == 0:
        return np.nan
    k = np.arange(len(amplitude), dtype=float)
    m1, m2, m3, m4 = ((amplitude * k**p).sum() / total for p in (1, 2, 3, 4))
    spread = m2 - m1 * m1
    if aggtype == "centroid":
        return m1
    if aggtype == "variance":
        return spread
    if aggtype not in ("skew", "kurtosis"):
        raise ValueError(f"unknown aggregate {aggtype!r}")
    if spread < 0.5:
        return np.nan
    if aggtype == "skew":
        return (m3 - 3 * m1 * spread - m1**3) / spread**1.5
    # The catalogue subtracts three times the centre itself, not its fourth power.
    return (m4 - 4 * m1 * m3 + 6 * m2 * m1 * m1 - 3 * m1) / (spread * spread)


#: Rows of a segment of the power density; longer blocks average half-overlapping segments.
SEGMENT = 256


def _density(x: np.ndarray) -> np.ndarray:
    """One-sided Hann-windowed power density of the mean-free block."""
    size = min(len(x), SEGMENT)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    if not (taper**2).sum():
        return np.zeros(0)
    parts = _windows(x, size)[:: size - size // 2]
    power = (np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * taper)) ** 2).mean(axis=0) / (taper**2).sum()
    power[1 : (size + 1) // 2] *= 2
    return power


@kernel
def spkt_welch_density(x: np.ndarray, coeff: int) -> float:
    power = _density(x)
    return float(power[coeff]) if coeff < len(power) else np.nan


@kernel
def fourier_entropy(x: np.ndarray, bins: int) -> float:
    """Entropy of the binned power density."""
    power = _density(x)
    if not len(power):
        return np.nan
    low, high = power.min(), power.max()
    if high <= low:
        return 0.0
    counts = np.bincount(np.minimum(((power - low) / (high - low) * bins).astype(int), bins - 1))
    share = counts[counts > 0] / len(power)
    return float(-(share * np.log(share)).sum())


def array_features(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, dict]]) -> DataFrame:
    """Gather each block (ordered by ``_i``) and run the wanted kernels on it."""
    calls = [(ARRAY_CALCULATORS[name], params) for name, params in wanted.values()]

    @F.pandas_udf("array<double>")
    def run(blocks: pd.Series) -> pd.Series:
        arrays = (np.asarray(b, dtype=float) for b in blocks)
        return pd.Series([[fn(a, **params) for fn, params in calls] for a in arrays])

    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_b"))
    computed = gathered.withColumn("_f", run(F.col("_b._x")))
    return computed.select(
        *keys,
        *[F.nullif(F.get("_f", F.lit(j)), F.lit(float("nan"))).alias(n) for j, n in enumerate(wanted)],
    )
