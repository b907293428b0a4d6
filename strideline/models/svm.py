"""Support vector machines on explicit kernel features, many of them trained in the same passes over the rows.

A kernel becomes features of fixed size: random Fourier features for ``rbf``, a tensor sketch for ``poly`` of any degree
(products of count sketches under a Fourier transform), the values themselves for ``linear``.  The squared hinge
loss with penalty ``1 / C`` on the summed loss is smooth, so one pass gives loss and
gradient of all machines, and each takes a step of limited memory.  The settings share a pass, and the folds of a
setting share its features.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

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
from strideline.models.perceptron import PATIENCE, TOLERANCE, limited_memory_step

#: Features that stand for a kernel.
SIZE = 256
KERNELS = ("rbf", "linear", "poly")


@dataclass(frozen=True)
class SvmSettings:
    kernel: str = "rbf"
    degree: int = 3
    gamma: float = 1.0
    C: float = 1.0
    max_iter: int = 200
    seed: int = 0

    def __post_init__(self):
        if self.kernel not in KERNELS:
            raise ValueError(f"unknown kernel {self.kernel!r}")


@dataclass
class Machine:
    settings: SvmSettings
    held: int | None
    weights: np.ndarray
    scale: float = 1.0
    past: list = field(default_factory=list)
    last: tuple | None = None
    best: float = np.inf
    idle: int = 0
    steps: int = 0
    done: bool = False


def kernel_features(x: np.ndarray, s: SvmSettings) -> np.ndarray:
    """Rows whose products are close to the kernel, and a column of ones."""
    rng = np.random.default_rng([s.seed, x.shape[1]])
    with np.errstate(all="ignore"):
        if s.kernel == "rbf":
            w, b = rng.normal(0.0, 1.0, (x.shape[1], SIZE)), rng.uniform(0.0, 2.0 * np.pi, SIZE)
            z = np.sqrt(2.0 / SIZE) * np.cos(np.sqrt(2.0 * s.gamma) * (x @ w) + b)
        elif s.kernel == "poly":
            spectrum = np.ones((len(x), SIZE // 2 + 1), complex)
            for _ in range(s.degree):
                sketch = np.zeros((x.shape[1], SIZE))
                sketch[np.arange(x.shape[1]), rng.integers(0, SIZE, x.shape[1])] = rng.choice([-1.0, 1.0], x.shape[1])
                spectrum = spectrum * np.fft.rfft(np.sqrt(s.gamma) * x @ sketch, axis=1)
            z = np.fft.irfft(spectrum, SIZE, axis=1)
        else:
            z = x
    return np.concatenate((np.nan_to_num(z, nan=0.0, posinf=0.0, neginf=0.0), np.ones((len(x), 1))), axis=1)


def loss_and_gradient(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed squared hinge loss of rows with sides -1 and 1, and its gradient."""
    gap = np.maximum(0.0, 1.0 - y * (z @ w))
    return float((gap * gap).sum()), -2.0 * (z.T @ (gap * y))


def _loads(b: pa.RecordBatch, width: int):
    x = np.array(b.column("x").to_pylist(), float).reshape(b.num_rows, width)
    return x, np.where(b.column("label").to_numpy() == 1, 1.0, -1.0), b.column("fold").to_numpy()


def _pass(rows: DataFrame, machines: dict[int, Machine], width: int) -> dict[int, tuple]:
    """Rows, loss and gradient of each machine, from one pass."""
    by: dict[SvmSettings, list] = {}
    for m, machine in machines.items():
        by.setdefault(machine.settings, []).append((m, machine.held, machine.weights))
    shared = rows.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            x, y, fold = _loads(b, width)
            for s, members in shared.value.items():
                z = kernel_features(x, s)
                for m, held, w in members:
                    own = np.ones(len(y), bool) if held is None else fold != held
                    with np.errstate(all="ignore"):
                        loss, g = loss_and_gradient(z[own], y[own], w)
                    total = sums.setdefault(m, [0, 0.0, np.zeros(len(w))])
                    total[0], total[1], total[2] = total[0] + int(own.sum()), total[1] + loss, total[2] + g
        yield pa.RecordBatch.from_arrays([
            pa.array(list(sums), pa.int32()), pa.array([t[0] for t in sums.values()], pa.int64()), pa.array([t[1] for t in sums.values()], pa.float64()),
            pa.array([t[2].tobytes() for t in sums.values()], pa.binary())], ["model", "n", "loss", "vector"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        vector = np.sum([np.frombuffer(v.as_py(), float) for v in table.column("vector")], axis=0)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([sum(table.column("n").to_pylist())], pa.int64()),
                                     pa.array([float(sum(table.column("loss").to_pylist()))], pa.float64()), pa.array([vector.tobytes()], pa.binary())], ["model", "n", "loss", "vector"])

    schema = "model int, n long, loss double, vector binary"
    out = rows.mapInArrow(run, schema).groupBy("model").applyInArrow(add, schema).collect()
    shared.unpersist()
    return {r["model"]: (r["n"], r["loss"], np.frombuffer(bytes(r["vector"]), float)) for r in out}


def train(rows: DataFrame, plans: list[tuple[SvmSettings, int | None]], width: int) -> list[Machine]:
    """One machine for each ``(settings, fold)``, trained on the rows ``(x, label, fold)`` of the other folds (all rows if None)."""
    machines = [Machine(s, held, np.zeros((width if s.kernel == "linear" else SIZE) + 1)) for s, held in plans]
    while live := {m: machine for m, machine in enumerate(machines) if not machine.done}:
        found = _pass(rows, live, width)
        for m, machine in live.items():
            n, loss, vector = found.get(m, (0, 0.0, machine.weights))
            if not n:
                machine.done = True
                continue
            # The last weight is the level, which bears no penalty.
            bare = np.append(machine.weights[:-1], 0.0)
            penalty = 1.0 / (machine.settings.C * n)
            value = loss / n + 0.5 * penalty * float(bare @ bare)
            machine.idle = 0 if value < machine.best * (1 - TOLERANCE) else machine.idle + 1
            machine.best, machine.steps = min(machine.best, value), machine.steps + 1
            machine.done = machine.idle >= PATIENCE or machine.steps >= machine.settings.max_iter
            if not machine.done:
                limited_memory_step(machine, value, vector / n + penalty * bare)
    for machine in machines:
        if machine.last is not None:
            machine.weights = machine.last[0]
    return machines


def held_out_hits(rows: DataFrame, machines: list[Machine], width: int) -> list[tuple[int, int]]:
    """Right predictions and rows of each machine's own fold, from one pass."""
    by: dict[SvmSettings, list] = {}
    for m, machine in enumerate(machines):
        by.setdefault(machine.settings, []).append((m, machine.held, machine.weights))
    shared = rows.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            x, y, fold = _loads(b, width)
            for s, members in shared.value.items():
                z = kernel_features(x, s)
                for m, held, w in members:
                    own = fold == held
                    out[m] = out.get(m, 0) + np.array([((z[own] @ w > 0) == (y[own] > 0)).sum(), own.sum()])
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([v[0] for v in out.values()], pa.int64()), pa.array([v[1] for v in out.values()], pa.int64())], ["model", "hits", "n"])

    found = rows.mapInArrow(run, "model int, hits long, n long").groupBy("model").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    at = {r["model"]: (r["hits"], r["n"]) for r in found}
    return [at.get(m, (0, 0)) for m in range(len(machines))]


class SvmModel(Transformer, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A trained machine as a pipeline stage; ``machine`` is its JSON form."""

    machine = Param(Params._dummy(), "machine", "settings and weights", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction", machine=None):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @staticmethod
    def of(machine: Machine) -> SvmModel:
        return SvmModel(machine=json.dumps({"settings": asdict(machine.settings), "weights": machine.weights.tolist()}))

    def _transform(self, df: DataFrame) -> DataFrame:
        given = json.loads(self.getOrDefault(self.machine))

        @F.pandas_udf("double")
        def said(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=float)
            z = kernel_features(np.stack(vectors.to_numpy()), SvmSettings(**given["settings"]))
            return pd.Series((z @ np.array(given["weights"]) > 0).astype(float))

        return df.withColumn(self.getPredictionCol(), said(vector_to_array(self.getFeaturesCol())))


def search(rows: DataFrame, settings: list[SvmSettings], folds: int, width: int, classes: int) -> tuple[int, float, SvmModel]:
    """Best setting by cross-validation, its mean accuracy, and its machine on all rows; two classes."""
    if classes != 2:
        raise ValueError("support vectors tell two classes apart")
    table = stored(rows.select("x", F.col("label").cast("int"), F.col("fold").cast("int")), "rows")
    machines = train(table, [(s, f) for s in settings for f in range(folds)], width)
    hits = held_out_hits(table, machines, width)
    means = [float(np.mean([h / n if n else 0.0 for h, n in hits[i * folds : (i + 1) * folds]])) for i in range(len(settings))]
    best = int(np.argmax(means))
    return best, means[best], SvmModel.of(train(table, [(settings[best], None)], width)[0])
