"""Perceptrons with any of three activations, many of them trained in the same passes over the rows.

One job is one epoch for all perceptrons that still learn.  Models with ``adam`` or ``sgd`` take mini-batch steps
over the rows of each partition, from the same weights, and the weights of the partitions are averaged by
their rows.  Models with ``lbfgs`` take one step of limited memory from the summed
gradient.  What travels is a vector of weights for each model and partition.

``alpha`` is the squared penalty.  With ``early_stopping`` a tenth of the rows is held back, and learning
ends when their accuracy has not grown for ten epochs; else it ends when the loss has not.  The
learning rate of ``sgd`` is constant, falls with the root of the steps, or is divided by five when the loss
stands still.  A model whose weights overflow keeps the last finite ones.
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

#: Epochs without progress that end learning, and the progress asked for.
PATIENCE, TOLERANCE = 10, 1e-4
#: Steps that limited memory looks back.
MEMORY = 8
#: Rows of each net that are put side by side for nets that step together.
STACKED = 2048
SOLVERS = ("adam", "sgd", "lbfgs")
SCHEDULES = ("constant", "invscaling", "adaptive")

_ACTIVATIONS = {
    "logistic": (lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))), lambda a: a * (1.0 - a)),
    "tanh": (np.tanh, lambda a: 1.0 - a * a),
    "relu": (lambda z: np.maximum(z, 0.0), lambda a: (a > 0).astype(float)),
}


@dataclass(frozen=True)
class NetSettings:
    hidden: tuple[int, ...] = (16, 8)
    activation: str = "relu"
    solver: str = "adam"
    alpha: float = 1e-4
    learning_rate: float = 1e-3
    schedule: str = "constant"
    batch_size: int = 8
    shuffle: bool = True
    early_stopping: bool = False
    max_iter: int = 200
    seed: int = 0

    def __post_init__(self):
        if self.activation not in _ACTIVATIONS or self.solver not in SOLVERS or self.schedule not in SCHEDULES:
            raise ValueError(f"unknown activation, solver or schedule in {self}")


@dataclass
class Net:
    """Weights as one vector, and what learning remembers."""

    layers: tuple[int, ...]
    settings: NetSettings
    held: int | None
    weights: np.ndarray
    rate: float
    steps: int = 0
    epoch: int = 0
    idle: int = 0
    best: float = np.inf
    kept: np.ndarray | None = None
    past: list = field(default_factory=list)
    last: tuple | None = None
    scale: float = 1.0
    done: bool = False


def first_weights(layers: tuple[int, ...], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(layers, layers[1:], strict=False):
        reach = np.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-reach, reach, a * b), np.zeros(b)]
    return np.concatenate(parts)


def unpacked(w: np.ndarray, layers: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(layers, layers[1:], strict=False):
        out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def outputs(x: np.ndarray, w: np.ndarray, layers: tuple[int, ...], activation: str) -> list[np.ndarray]:
    """Activations of all layers, the last one as class shares."""
    act, _ = _ACTIVATIONS[activation]
    out = [x]
    parts = unpacked(w, layers)
    for i, (m, b) in enumerate(parts):
        z = out[-1] @ m + b
        if i < len(parts) - 1:
            out.append(act(z))
        else:
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
    return out


def loss_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, layers: tuple[int, ...], activation: str) -> float:
    """Summed logarithmic loss of the rows, without the penalty."""
    return float(-np.log(np.clip(outputs(x, w, layers, activation)[-1][np.arange(len(y)), y], 1e-300, 1.0)).sum())


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, layers: tuple[int, ...], activation: str) -> tuple[float, np.ndarray]:
    """Summed logarithmic loss of the rows and its gradient, without the penalty."""
    out = outputs(x, w, layers, activation)
    _, slope = _ACTIVATIONS[activation]
    share = np.clip(out[-1][np.arange(len(y)), y], 1e-300, 1.0)
    delta = out[-1].copy()
    delta[np.arange(len(y)), y] -= 1.0
    parts, grads = unpacked(w, layers), []
    for i in range(len(parts) - 1, -1, -1):
        grads[:0] = [(out[i].T @ delta).ravel(), delta.sum(axis=0)]
        if i:
            delta = (delta @ parts[i][0].T) * slope(out[i])
    return float(-np.log(share).sum()), np.concatenate(grads)


def _gradients(x: np.ndarray, y: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], into: list[tuple[np.ndarray, np.ndarray]], activation: str) -> None:
    """Summed gradients of several nets, each over its own rows: ``x`` is (net, row, feature), ``y`` (net, row)."""
    act, slope = _ACTIVATIONS[activation]
    out = [x]
    for i, (m, b) in enumerate(parts):
        z = out[-1] @ m
        z += b[:, None, :]
        out.append(act(z) if i < len(parts) - 1 else z)
    z = np.exp(z - z.max(axis=2, keepdims=True))
    delta = z / z.sum(axis=2, keepdims=True)
    delta[np.arange(len(x))[:, None], np.arange(x.shape[1]), y] -= 1.0
    for i in range(len(parts) - 1, -1, -1):
        into[i][0][...] = out[i].swapaxes(1, 2) @ delta
        into[i][1][...] = delta.sum(axis=1)
        if i:
            delta = (delta @ parts[i][0].swapaxes(1, 2)) * slope(out[i])


def _stacked(w: np.ndarray, layers: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the layers of several nets' weights, one net a row."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:], strict=False):
        out.append((w[:, at : at + a * b].reshape(len(w), a, b), w[:, at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _descended(nets: list[Net], x: np.ndarray, y: np.ndarray, rows: list[np.ndarray]) -> list[np.ndarray]:
    """Weights after the mini-batches of one partition, of nets with equal settings; ``rows`` are each net's own.

    The nets step together while all have full batches, which shares the cost of a step; what is left each does alone.
    """
    s, layers, size = nets[0].settings, nets[0].layers, max(1, nets[0].settings.batch_size)
    w = np.stack([n.weights for n in nets])
    first, second, g = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    t = [n.steps for n in nets]
    order = []
    for k, (net, own) in enumerate(zip(nets, rows, strict=True)):
        if s.solver == "adam" and net.last is not None:
            first[k], second[k] = net.last[0], net.last[1]
        order.append(own[np.random.default_rng([s.seed, net.epoch]).permutation(len(own))] if s.shuffle else own)

    def descend(which: slice, start: int, stop: int) -> None:
        own, picked = range(len(nets))[which], np.stack([o[start:stop] for o in order[which]])
        v, one, two, grad = w[which], first[which], second[which], g[which]
        parts, into = _stacked(v, layers), _stacked(grad, layers)
        total = np.array([[max(len(rows[k]), 1)] for k in own], float)
        rates = [nets[k].rate for k in own]
        xs, ys = x[picked], y[picked]
        for at in range(0, stop - start, size):
            now = ys[:, at : at + size]
            _gradients(xs[:, at : at + size], now, parts, into, s.activation)
            step = grad / now.shape[1] + s.alpha * v / total
            for k in own:
                t[k] += 1
            if s.solver == "adam":
                one *= 0.9
                one += 0.1 * step
                two *= 0.999
                two += 0.001 * step * step
                low, high = (np.array([[1 - decay ** t[k]] for k in own]) for decay in (0.9, 0.999))
                v -= np.array(rates)[:, None] * (one / low) / (np.sqrt(two / high) + 1e-8)
            else:
                rate = [r / np.sqrt(t[k]) if s.schedule == "invscaling" else r for r, k in zip(rates, own, strict=True)]
                one *= 0.9
                one -= np.array(rate)[:, None] * step
                v += one

    common = min(len(o) for o in order) // size * size
    chunk = max(1, STACKED // size) * size
    for at in range(0, common, chunk):
        descend(slice(0, len(nets)), at, min(at + chunk, common))
    for k, o in enumerate(order):
        for at in range(common, len(o), chunk):
            descend(slice(k, k + 1), at, min(at + chunk, len(o)))
    found = [np.concatenate(parts) for parts in zip(w, first, second, strict=True)] if s.solver == "adam" else list(w)
    # Weights that overflowed never become finite again.
    return [f if np.isfinite(w[k]).all() else np.full(len(f), np.nan) for k, f in enumerate(found)]


def _back(b: pa.RecordBatch, width: int):
    x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, width)
    return x, b.column("label").to_numpy(), b.column("fold").to_numpy(), b.column("back").to_numpy(zero_copy_only=False)


def _epoch(rows: DataFrame, nets: dict[int, Net], width: int) -> dict[int, tuple]:
    """One pass for all nets: rows learned from, loss, held-back hits and rows, and the summed vector."""
    shared = rows.sparkSession.sparkContext.broadcast(nets)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_back(b, width) for b in batches if b.num_rows]
        if not parts:
            return
        for start in range(0, len(parts), 8):  # at most eight batches are learned from at once
            x, y, fold, back = (np.concatenate(c) for c in zip(*parts[start : start + 8], strict=True))
            found, alike = {}, {}
            for m, net in shared.value.items():
                own = np.ones(len(x), bool) if net.held is None else fold != net.held
                kept = np.flatnonzero(own & ~(back & net.settings.early_stopping))
                check = own & back & net.settings.early_stopping
                with np.errstate(all="ignore"):
                    if net.settings.solver == "lbfgs":
                        loss, vector = loss_and_gradient(x[kept], y[kept], net.weights, net.layers, net.settings.activation)
                    else:
                        loss, vector = loss_of(x[kept], y[kept], net.weights, net.layers, net.settings.activation), None
                        alike.setdefault((net.layers, net.settings), []).append((m, net, kept))
                    hits = int((outputs(x[check], net.weights, net.layers, net.settings.activation)[-1].argmax(axis=1) == y[check]).sum()) if check.any() else 0
                found[m] = [m, len(kept), loss, hits, int(check.sum()), vector]
            for same in alike.values():
                models, nets_, kept_ = zip(*same, strict=True)
                with np.errstate(all="ignore"):
                    for m, kept, vector in zip(models, kept_, _descended(list(nets_), x, y, list(kept_)), strict=True):
                        found[m][5] = vector * len(kept)
            found = [(*f[:5], f[5].tobytes()) for f in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                             ["model", "n", "loss", "hits", "checked", "vector"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v.as_py(), float) for v in table.column("vector")], axis=0)
        sums = [sum(table.column(c).to_pylist()) for c in ("n", "loss", "hits", "checked")]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([sums[0]], pa.int64()), pa.array([float(sums[1])], pa.float64()),
                                     pa.array([sums[2]], pa.int64()), pa.array([sums[3]], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["model", "n", "loss", "hits", "checked", "vector"])

    schema = "model int, n long, loss double, hits long, checked long, vector binary"
    out = rows.mapInArrow(learn, schema).groupBy("model").applyInArrow(add, schema).collect()
    shared.unpersist()
    return {r["model"]: (r["n"], r["loss"], r["hits"], r["checked"], np.frombuffer(bytes(r["vector"]), float)) for r in out}


def _progress(net: Net, value: float) -> None:
    """Counts epochs without progress of a value that should fall; the schedule and the end follow from it."""
    s = net.settings
    if value < net.best - TOLERANCE:
        net.idle = 0
        net.kept = net.weights.copy() if s.early_stopping else None
    else:
        net.idle += 1
    net.best = min(net.best, value)
    if s.solver == "sgd" and s.schedule == "adaptive" and net.idle >= 2 and net.rate > 1e-6:
        net.rate, net.idle = net.rate / 5.0, 0
    elif net.idle >= PATIENCE:
        net.done = True


def _updated(net: Net, n: int, loss: float, hits: int, checked: int, vector: np.ndarray) -> None:
    s = net.settings
    net.epoch += 1
    if n == 0:
        net.done = True
        return
    penalty = 0.5 * s.alpha * float((net.weights**2).sum()) / n
    value = loss / n + penalty
    _progress(net, 1.0 - hits / checked if s.early_stopping and checked else value)
    if net.done:
        return
    if s.solver == "lbfgs":
        limited_memory_step(net, value, vector / n + s.alpha * net.weights / n)
    else:
        mean = vector / n
        size = len(net.weights)
        if not np.isfinite(mean).all():
            net.done = True
            return
        net.weights = mean[:size]
        net.last = (mean[size : 2 * size], mean[2 * size :]) if s.solver == "adam" else None
        net.steps += max(1, -(-n // max(1, s.batch_size)))
    net.done |= net.epoch >= s.max_iter


def limited_memory_step(net, value: float, g: np.ndarray) -> None:
    """A step along the direction of limited memory; a step that made the loss grow is taken back and halved.

    ``net`` has weights, last, past, scale and done.
    """
    if not np.isfinite(value) or not np.isfinite(g).all() or (net.last is not None and value > net.last[1] + 1e-12):
        if net.last is None or net.scale < 1e-10:
            net.weights = net.last[0] if net.last is not None else net.weights
            net.done = True
            return
        net.scale /= 2
        net.weights = net.last[0] + net.scale * net.last[3]
        return
    if net.last is not None:
        step, change = net.weights - net.last[0], g - net.last[2]
        if step @ change > 1e-12:
            net.past = [*net.past, (step, change)][-MEMORY:]
    q, factors = g.copy(), []
    for step, change in reversed(net.past):
        a = (step @ q) / (step @ change)
        factors.append(a)
        q -= a * change
    if net.past:
        step, change = net.past[-1]
        q *= (step @ change) / (change @ change)
    else:
        q /= max(1.0, float(np.sqrt(g @ g)))
    for (step, change), a in zip(net.past, reversed(factors), strict=True):
        q += step * (a - (change @ q) / (step @ change))
    net.last, net.scale = (net.weights.copy(), value, g, -q), 1.0
    net.weights = net.weights - q


def train(rows: DataFrame, plans: list[tuple[NetSettings, int | None]], width: int, classes: int) -> list[Net]:
    """One net for each ``(settings, fold)``, trained on the rows of the other folds (all rows if None).

    ``rows`` are ``(x, label, fold, back)``.
    """
    nets = []
    for s, held in plans:
        layers = (width, *s.hidden, classes)
        nets.append(Net(layers, s, held, first_weights(layers, s.seed), s.learning_rate))
    while live := {m: net for m, net in enumerate(nets) if not net.done}:
        found = _epoch(rows, live, width)
        for m, net in live.items():
            _updated(net, *found.get(m, (0, 0.0, 0, 0, net.weights)))
    for net in nets:
        if net.settings.early_stopping and net.kept is not None:
            net.weights = net.kept
        elif net.settings.solver == "lbfgs" and net.last is not None:
            net.weights = net.last[0]
    return nets


def held_out_hits(rows: DataFrame, nets: list[Net], width: int) -> list[tuple[int, int]]:
    """Right predictions and rows of each net's own fold, from one pass."""
    shared = rows.sparkSession.sparkContext.broadcast([(n.weights, n.layers, n.settings.activation, n.held) for n in nets])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(shared.value), 2), np.int64)
        for b in batches:
            x, y, fold, _ = _back(b, width)
            for m, (w, layers, activation, held) in enumerate(shared.value):
                own = fold == held
                if own.any():
                    with np.errstate(all="ignore"):
                        said = outputs(x[own], w, layers, activation)[-1].argmax(axis=1)
                    out[m] += [(said == y[own]).sum(), own.sum()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out[:, 0]), pa.array(out[:, 1])], ["model", "hits", "n"])

    found = rows.mapInArrow(run, "model int, hits long, n long").groupBy("model").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    by = {r["model"]: (r["hits"], r["n"]) for r in found}
    return [by.get(m, (0, 0)) for m in range(len(nets))]


class NetModel(Transformer, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A trained net as a pipeline stage; ``net`` is its JSON form."""

    net = Param(Params._dummy(), "net", "layers, activation and weights", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction", net=None):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @staticmethod
    def of(net: Net) -> NetModel:
        return NetModel(net=json.dumps({"layers": list(net.layers), "activation": net.settings.activation, "weights": net.weights.tolist()}))

    def _transform(self, df: DataFrame) -> DataFrame:
        net = json.loads(self.getOrDefault(self.net))

        @F.pandas_udf("double")
        def said(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=float)
            with np.errstate(all="ignore"):
                last = outputs(np.stack(vectors.to_numpy()), np.array(net["weights"]), tuple(net["layers"]), net["activation"])[-1]
            return pd.Series(last.argmax(axis=1).astype(float))

        return df.withColumn(self.getPredictionCol(), said(vector_to_array(self.getFeaturesCol())))


def search(rows: DataFrame, settings: list[NetSettings], folds: int, width: int, classes: int) -> tuple[int, float, NetModel]:
    """Best setting by cross-validation, its mean accuracy, and its net on all rows; ``rows`` are ``(x, label, fold, row)``."""
    back = F.pmod(F.xxhash64("row"), F.lit(10)) == 0
    # Partitions are what mini-batches are taken from, so rows are dealt to them by their number.
    spread = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "row")
    table = stored(spread.select("x", F.col("label").cast("int"), F.col("fold").cast("int"), back.alias("back")), "rows")
    plans = [(s, f) for s in settings for f in range(folds)]
    nets = train(table, plans, width, classes)
    hits = held_out_hits(table, nets, width)
    means = [float(np.mean([h / n if n else 0.0 for h, n in hits[i * folds : (i + 1) * folds]])) for i in range(len(settings))]
    best = int(np.argmax(means))
    return best, means[best], NetModel.of(train(table, [(settings[best], None)], width, classes)[0])
