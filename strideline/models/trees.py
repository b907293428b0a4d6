"""Classification trees grown level by level, many of them in the same passes over the rows.

Features are cut at quantiles into bins.  A pass sends every row down all trees at once and counts
classes per open node, feature and bin; what moves between machines is these counts, for nodes that
were met, or the bins of a node's rows where they take less room.  Each node's best split is chosen where its counts come together, and one row per
open node reaches the driver, which holds the trees, as it does for any fitted model.

A node looks at ``max_features`` features in an order of its own, and at more only while none of them can
split it.  The random splitter tries one random cut of each feature between the smallest and
the largest bin of the node.  Nodes of fewer than ``min_samples_split`` rows stay leaves, and
no split leaves fewer than ``min_samples_leaf`` rows on a side.  Ties go to the first feature and values.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.materialise import stored

#: Bins of a feature, and rows that are counted at once.
BINS, ROWS = 32, 16384
#: Cells that one count may hold; beyond it only met cells are listed.
CELLS = 1 << 22


@dataclass(frozen=True)
class TreeSettings:
    max_depth: int = 30
    criterion: str = "gini"
    splitter: str = "best"
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: int | None = None
    seed: int = 0


@dataclass
class Tree:
    """Nodes in the order they were made; the right child follows the left one, and feature -1 marks a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    counts: list[list[int]] = field(default_factory=lambda: [[]])

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(v, np.int64) for v in (self.feature, self.cut, self.left))


def nodes_of(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf that each row of bins (or values, with cuts as values) reaches."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        rows = rows[feature[node[rows]] >= 0]
        at = node[rows]
        node[rows] = left[at] + (x[rows, feature[at]] > cut[at])
    return node


def impurity(counts: np.ndarray, criterion: str) -> np.ndarray:
    """Impurity of class counts along the last axis."""
    total = counts.sum(axis=-1, keepdims=True)
    p = counts / np.maximum(total, 1)
    if criterion == "gini":
        return 1.0 - (p * p).sum(axis=-1)
    if criterion == "entropy":
        return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=-1)
    raise ValueError(f"unknown criterion {criterion!r}")


def best_split(counts: np.ndarray, s: TreeSettings, node: int) -> tuple[int, int]:
    """Feature and cut for counts per feature, bin and class; feature -1 if no split is allowed."""
    rng = np.random.default_rng([s.seed, node])
    upto = counts.cumsum(axis=1)
    parent = upto[0, -1]
    n, left = parent.sum(), upto.sum(axis=2)
    allowed = (left >= max(1, s.min_samples_leaf)) & (n - left >= max(1, s.min_samples_leaf))
    if s.splitter == "random":
        filled = counts.sum(axis=2) > 0
        low, high = filled.argmax(axis=1), filled.shape[1] - 1 - filled[:, ::-1].argmax(axis=1)
        cut = low + np.floor(rng.random(len(low)) * np.maximum(high - low, 1)).astype(int)
        one = np.zeros_like(allowed)
        one[np.arange(len(cut)), np.minimum(cut, allowed.shape[1] - 1)] = True
        allowed &= one
    elif s.splitter != "best":
        raise ValueError(f"unknown splitter {s.splitter!r}")
    order = rng.permutation(len(counts))
    able = allowed[order].any(axis=1)
    looked = min(len(order), s.max_features or len(order))
    if not able[:looked].any():
        looked = int(able.argmax()) + 1 if able.any() else 0
    if not looked:
        return -1, 0
    share = left / n
    gain = impurity(parent, s.criterion) - share * impurity(upto, s.criterion) - (1 - share) * impurity(parent - upto, s.criterion)
    seen = np.zeros(len(counts), bool)
    seen[order[:looked]] = True
    gain = np.where(allowed & seen[:, None], np.round(gain, 12), -np.inf)
    feature, cut = (int(v) for v in np.unravel_index(int(gain.argmax()), gain.shape))
    # Between two values of the node any cut does the same; the middle one is kept.
    last = int(np.searchsorted(left[feature], left[feature, cut], side="right")) - 1
    return feature, (cut + last + 1) // 2 if s.splitter == "best" else cut


def bin_edges(rows: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Up to ``bins - 1`` edges of each feature of ``x``, midway between neighbouring quantiles."""
    chances = [i / (bins - 1) for i in range(bins)]
    found = rows.agg(*[F.percentile_approx(F.col("x")[i], chances, 10_000).alias(f"q{i}") for i in range(width)]).first()
    values = [np.unique(np.array(q or [], float)) for q in found]
    return [(v[:-1] + v[1:]) / 2 for v in values]


def binned(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """``(label, fold, bins)`` of rows ``(x, label, fold)``; a byte per feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(b.num_rows, len(edges))
            bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("fold"), pa.array([r.tobytes() for r in bins], pa.binary())], ["label", "fold", "bins"])

    return rows.select("x", F.col("label").cast("int"), F.col("fold").cast("int")).mapInArrow(run, "label int, fold int, bins binary")


def _loads(batches: Iterator[pa.RecordBatch], width: int):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            x = np.frombuffer(b"".join(part.column("bins").to_pylist()), np.uint8).reshape(part.num_rows, width)
            yield x, part.column("label").to_numpy(), part.column("fold").to_numpy()


def _smaller_rows(own: np.ndarray, cells: np.ndarray, size: int, nodes: int, x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Which nodes take less room as rows than as cells, and their rows: bins, then the label in four bytes."""
    row = x.shape[1] + 4
    rows = np.bincount(own, minlength=nodes)
    chosen = rows * row < 8 * np.bincount(cells // size, minlength=nodes)
    order = np.argsort(own, kind="stable")
    order = order[chosen[own[order]]]
    payload = np.concatenate([x[order], label[order].astype("<i4").view(np.uint8).reshape(-1, 4)], axis=1)
    ends = np.concatenate([[0], np.cumsum(np.where(chosen, rows, 0) * row)]).astype(np.int32)
    return chosen, pa.Array.from_buffers(pa.binary(), nodes, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(payload.tobytes())])


def grow(rows: DataFrame, plans: list[tuple[TreeSettings, int | None]], width: int, classes: int) -> list[Tree]:
    """One tree for each ``(settings, fold)``, grown on the rows of the other folds (all rows if None)."""
    context = rows.sparkSession.sparkContext
    trees = [Tree() for _ in plans]
    open_ = {m: [0] for m in range(len(plans))}
    size = width * BINS * classes
    while open_:
        shared = context.broadcast({m: (trees[m].arrays(), np.array(nodes), plans[m][1]) for m, nodes in open_.items()})

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = np.arange(width) * BINS * classes
            for x, label, fold in _loads(batches, width):
                for m, (arrays, nodes, held) in shared.value.items():  # noqa: B023
                    rows_ = np.arange(len(x)) if held is None else np.flatnonzero(fold != held)
                    at = nodes_of(x[rows_], *arrays)
                    which = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
                    met = nodes[which] == at
                    rows_, names, own = rows_[met], *np.unique(which[met], return_inverse=True)
                    if not len(rows_):
                        continue
                    cell = (own[:, None] * size + place + x[rows_].astype(np.int64) * classes + label[rows_, None]).ravel()
                    if len(names) * size <= CELLS:
                        found = np.bincount(cell, minlength=len(names) * size)
                        cells = np.flatnonzero(found)
                        found = found[cells]
                    else:
                        cells, found = np.unique(cell, return_counts=True)
                    chosen, packed = _smaller_rows(own, cells, size, len(names), x[rows_], label[rows_])
                    kept = ~chosen[cells // size]
                    cells, found = cells[kept], found[kept]
                    cuts = np.searchsorted(cells, np.arange(len(names) + 1) * size)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([m] * len(names), pa.int32()), pa.array(nodes[names], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((cells % size).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(found.astype(np.int32))), packed,
                    ], ["model", "node", "cells", "counts", "rows"])

        def choose(key: tuple, table: pa.Table) -> pa.Table:
            m, node = (k.as_py() for k in key)
            cells = table.column("cells").combine_chunks().flatten().to_numpy()
            found = table.column("counts").combine_chunks().flatten().to_numpy()
            counts = np.bincount(cells, weights=found, minlength=size)
            packed = np.frombuffer(b"".join(table.column("rows").to_pylist()), np.uint8).reshape(-1, width + 4)
            for at in range(0, len(packed), ROWS):
                part = packed[at : at + ROWS]
                label = np.ascontiguousarray(part[:, width:]).view("<i4")
                counts += np.bincount((np.arange(width) * BINS * classes + part[:, :width].astype(np.int64) * classes + label).ravel(), minlength=size)
            counts = counts.reshape(width, BINS, classes)
            total = counts[0].sum(axis=0)
            s = plans[m][0]
            feature, cut = best_split(counts, s, node) if _splits(total, 0, s) else (-1, 0)
            left = counts[feature, : cut + 1].sum(axis=0) if feature >= 0 else total
            longs = lambda v: pa.array([v.astype(np.int64).tolist()], pa.list_(pa.int64()))
            return pa.Table.from_arrays([pa.array([m], pa.int32()), pa.array([node], pa.int32()), pa.array([feature], pa.int32()), pa.array([cut], pa.int32()), longs(total), longs(left)],
                                        ["model", "node", "feature", "cut", "total", "part"])

        partial = rows.mapInArrow(count, "model int, node int, cells array<int>, counts array<int>, rows binary")
        chosen = partial.groupBy("model", "node").applyInArrow(choose, "model int, node int, feature int, cut int, total array<long>, part array<long>").collect()
        shared.unpersist()
        open_ = {}
        for r in sorted(chosen, key=lambda r: (r["model"], r["node"])):
            tree, s = trees[r["model"]], plans[r["model"]][0]
            tree.counts[r["node"]] = list(r["total"])
            if r["feature"] < 0:
                continue
            tree.feature[r["node"]], tree.cut[r["node"]], tree.left[r["node"]] = r["feature"], r["cut"], len(tree.feature)
            for counts in (list(r["part"]), [a - b for a, b in zip(r["total"], r["part"], strict=True)]):
                depth = tree.depth[r["node"]] + 1
                if _splits(np.array(counts), depth, s):
                    open_.setdefault(r["model"], []).append(len(tree.feature))
                for values, v in ((tree.feature, -1), (tree.cut, 0), (tree.left, 0), (tree.depth, depth), (tree.counts, counts)):
                    values.append(v)
    return trees


def _splits(counts: np.ndarray, depth: int, s: TreeSettings) -> bool:
    n = counts.sum()
    return depth < s.max_depth and n >= max(2, s.min_samples_split, 2 * s.min_samples_leaf) and np.count_nonzero(counts) > 1


def _labels(tree: Tree) -> np.ndarray:
    return np.array([int(np.argmax(c)) if c else 0 for c in tree.counts])


def held_out_hits(rows: DataFrame, trees: list[Tree], plans: list[tuple[TreeSettings, int | None]], width: int) -> list[tuple[int, int]]:
    """Right predictions and rows of each tree's own fold, from one pass."""
    shared = rows.sparkSession.sparkContext.broadcast([(t.arrays(), _labels(t), p[1]) for t, p in zip(trees, plans, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(shared.value), 2), np.int64)
        for x, label, fold in _loads(batches, width):
            for m, (arrays, said, held) in enumerate(shared.value):
                own = np.flatnonzero(fold == held)
                out[m] += [(said[nodes_of(x[own], *arrays)] == label[own]).sum(), len(own)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out[:, 0]), pa.array(out[:, 1])], ["model", "hits", "n"])

    found = rows.mapInArrow(run, "model int, hits long, n long").groupBy("model").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    by = {r["model"]: (r["hits"], r["n"]) for r in found}
    return [by.get(m, (0, 0)) for m in range(len(plans))]


class TreeModel(Transformer, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A grown tree as a pipeline stage; ``nodes`` is its JSON form with cuts as values."""

    nodes = Param(Params._dummy(), "nodes", "nodes of the tree", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction", nodes=None):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @staticmethod
    def of(tree: Tree, edges: list[np.ndarray]) -> TreeModel:
        cuts = [float(edges[f][c]) if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut, strict=True)]
        return TreeModel(nodes=json.dumps({"feature": tree.feature, "cut": cuts, "left": tree.left, "label": _labels(tree).tolist()}))

    def _transform(self, df: DataFrame) -> DataFrame:
        tree = json.loads(self.getOrDefault(self.nodes))

        @F.pandas_udf("double")
        def said(vectors: pd.Series) -> pd.Series:
            arrays = np.array(tree["feature"]), np.array(tree["cut"]), np.array(tree["left"])
            at = nodes_of(np.stack(vectors.to_numpy()), *arrays) if len(vectors) else np.zeros(0, int)
            return pd.Series(np.array(tree["label"], float)[at])

        return df.withColumn(self.getPredictionCol(), said(vector_to_array(self.getFeaturesCol())))


def search(rows: DataFrame, settings: list[TreeSettings], folds: int, width: int, classes: int) -> tuple[int, float, TreeModel]:
    """Best setting by cross-validation, its mean accuracy, and its tree on all rows.

    ``rows`` are ``(x, label, fold)``.  The trees of all settings and folds grow together.
    """
    edges = bin_edges(rows, width)
    table = stored(binned(rows, edges), "binned")
    plans = [(s, f) for s in settings for f in range(folds)]
    trees = grow(table, plans, width, classes)
    hits = held_out_hits(table, trees, plans, width)
    means = [float(np.mean([h / n if n else 0.0 for h, n in hits[i * folds : (i + 1) * folds]])) for i in range(len(settings))]
    best = int(np.argmax(means))
    return best, means[best], TreeModel.of(grow(table, [(settings[best], None)], width, classes)[0], edges)
