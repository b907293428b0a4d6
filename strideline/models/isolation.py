"""Isolation forest as an outlier filter.

Each tree isolates a handful of sampled rows, so the whole forest is a few thousand rows
and is built on the driver; scoring and the threshold run over all rows on the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.operators.signal import exact_quantiles
from strideline.ordering import attach_stats

EULER = 0.5772156649015329


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    if n < 2:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


@dataclass
class IsolationModel:
    """Complete binary trees in arrays: split feature and value per node, path per leaf."""

    features: np.ndarray
    splits: np.ndarray
    paths: np.ndarray
    depth: int
    samples: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """-2^(-mean path / c); lower is more unusual."""
        out = np.empty(len(x))
        trees = np.arange(len(self.features))
        for lo in range(0, len(x), 512):
            rows = x[lo : lo + 512]
            node = np.zeros((len(rows), len(trees)), dtype=np.int64)
            for _ in range(self.depth):
                feature = self.features[trees, node]
                right = rows[np.arange(len(rows))[:, None], feature] > self.splits[trees, node]
                node = 2 * node + 1 + right
            leaf = node - (2**self.depth - 1)
            mean = self.paths[trees, leaf].mean(axis=1)
            out[lo : lo + 512] = -np.power(2.0, -mean / average_path(self.samples))
        return out

    def score(self, df: DataFrame, vector: str, out: str = "score") -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def run(values: pd.Series) -> pd.Series:
            return pd.Series(model.scores(np.stack(values.to_numpy()).astype(float)))

        return df.withColumn(out, run(F.col(vector)))

    def keep_inliers(self, df: DataFrame, vector: str, contamination: float) -> DataFrame:
        """Drop the ``contamination`` share of rows with the lowest scores."""
        scored = self.score(df, vector, "_score")
        limit = exact_quantiles(scored, "_score", [contamination])
        return attach_stats(scored, limit, []).where(F.col("_score") >= F.col("q0")).select(*df.columns)


def _grow(rows: np.ndarray, depth: int, rng: np.random.Generator, tree: int, model: IsolationModel) -> None:
    stack = [(0, rows, 0)]
    leaves_from = 2**depth - 1
    while stack:
        node, part, level = stack.pop()
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else np.empty(0, dtype=int)
        if level == depth or not len(spread):
            # All leaves below an early end share its path.
            first, last = node, node
            for _ in range(depth - level):
                first, last = 2 * first + 1, 2 * last + 2
            model.paths[tree, first - leaves_from : last - leaves_from + 1] = level + average_path(len(part))
            continue
        feature = int(rng.choice(spread))
        split = rng.uniform(part[:, feature].min(), part[:, feature].max())
        model.features[tree, node], model.splits[tree, node] = feature, split
        right = part[:, feature] > split
        stack += [(2 * node + 1, part[~right], level + 1), (2 * node + 2, part[right], level + 1)]


def fit_isolation(
    df: DataFrame, vector: str, row_keys: list[str], trees: int = 750, samples: int = 5, seed: int = 0
) -> IsolationModel:
    """Build the forest from ``trees * samples`` rows picked by a seeded hash of the row key."""
    picked = (
        df.select(F.xxhash64(F.lit(seed), *row_keys).alias("_h"), F.col(vector).alias("_x"))
        .orderBy("_h").limit(trees * samples).collect()
    )
    pool = np.array([r["_x"] for r in picked], dtype=float)
    rng = np.random.default_rng(seed)
    samples = min(samples, len(pool))
    depth = max(1, int(np.ceil(np.log2(max(samples, 2)))))
    model = IsolationModel(
        np.zeros((trees, 2**depth - 1), dtype=np.int64), np.full((trees, 2**depth - 1), np.inf),
        np.zeros((trees, 2**depth)), depth, samples,
    )
    order = rng.permutation(len(pool))
    for tree in range(trees):
        if len(pool) >= trees * samples:
            rows = pool[order[tree * samples : (tree + 1) * samples]]
        else:
            rows = pool[rng.choice(len(pool), samples, replace=False)]
        _grow(rows, depth, rng, tree, model)
    return model


def isolation_filter(
    df: DataFrame, columns: list[str], row_keys: list[str], contamination: float = 0.01, trees: int = 750,
    samples: int = 5, seed: int = 0,
) -> DataFrame:
    """Rows that are no outliers in the given feature columns."""
    packed = df.withColumn("_vector", F.array(*[F.col(f"`{c}`").cast("double") for c in columns]))
    model = fit_isolation(packed, "_vector", row_keys, trees, samples, seed)
    return model.keep_inliers(packed, "_vector", contamination).drop("_vector")
