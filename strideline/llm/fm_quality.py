"""Quality scores from a factorisation machine.

Features of a text: hashed words (logarithm of the count, unit length), structure statistics
of its bytes, words and lines cut into bins, and its length as metadata.  Pairs of features
interact through factors of low rank; with s = sum(v x) and q = sum((v x)^2), the sum over all
pairs is (s^2 - q) / 2, so a score takes time linear in the features of a text.

The model is fitted on a bounded sample of labelled rows, those of the smallest id hashes;
scoring covers every row in its task.

Cases: a null or empty text has no words and is scored by its bins; rows are scored one by
one, repeated ones alike; labels that are null or of unknown ids are left out, of several
labels of an id the largest counts; without usable labels every score is one half; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.words import hashed_words, slices, windows

#: Labelled rows that the model is fitted on at most.
SAMPLE = 6000
WORDS, BINS = 1 << 14, 12
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b".,;:!?", b"\n", b" ")
N_STATISTICS = len(_CLASSES) + 6
SIZE = WORDS + BINS * N_STATISTICS


def _statistics(texts: list, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of statistics per text, all in about 0..1 or logarithms."""
    parts = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size)
    columns = []
    for chars in _CLASSES:
        is_in = np.zeros(256, np.int32)
        is_in[list(chars)] = 1
        total = np.concatenate(([0], np.cumsum(is_in[data])))
        columns.append((total[ends] - total[ends - size]) / np.maximum(size, 1))
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words, doc))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    same = np.zeros(len(words))
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    h, of = windows(words, bounds, 3)
    order3 = np.lexsort((h, of))
    again = np.zeros(len(h))
    again[1:] = (h[order3][1:] == h[order3][:-1]) & (of[order3][1:] == of[order3][:-1])
    lines = [t.split("\n") if t else [] for t in texts]
    per_word = lambda x, d: np.bincount(d, weights=x, minlength=len(n)) / np.maximum(n, 1)
    columns += [
        np.log1p(n), size / np.maximum(n, 1) / 10, per_word(new, doc[order]), per_word(same, doc), per_word(again, of[order3]),
        np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines]),
    ]
    return np.stack(columns, axis=1)


def features(texts: list, cuts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and bounds per text, and the statistics the bins are cut from."""
    words, bounds = hashed_words(texts)
    raw = _statistics(texts, words, bounds)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    key, count = np.unique(doc * WORDS + (words >> np.uint64(40)).astype(np.int64) % WORDS, return_counts=True)
    doc, index, value = key // WORDS, key % WORDS, np.log1p(count)
    value /= np.sqrt(np.bincount(doc, weights=value**2, minlength=len(texts)))[doc]
    if cuts is not None:
        bins = np.stack([np.searchsorted(c, raw[:, i], side="left") for i, c in enumerate(cuts)], axis=1)
        own = WORDS + BINS * np.arange(N_STATISTICS) + bins
        index = np.concatenate((index, own.ravel()))
        value = np.concatenate((value, np.full(own.size, 0.5)))
        doc = np.concatenate((doc, np.repeat(np.arange(len(texts)), N_STATISTICS)))
        order = np.argsort(doc, kind="stable")
        index, value, doc = index[order], value[order], doc[order]
    return index, value, np.searchsorted(doc, np.arange(len(texts) + 1)), raw


class Machine:
    """Weights, factors and bin borders."""

    def __init__(self, rank: int = 8, seed: int = 1):
        self.bias, self.w = 0.0, np.zeros(SIZE)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (SIZE, rank))
        self.cuts = np.zeros((N_STATISTICS, BINS - 1))

    def _sums(self, index, value, bounds):
        vx = self.v[index] * value[:, None]
        rows = lambda x: np.diff(np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)))[bounds], axis=0)
        return vx, rows(vx), rows(vx**2), rows((self.w[index] * value)[:, None])[:, 0]

    def margins(self, index, value, bounds) -> np.ndarray:
        _, s, q, linear = self._sums(index, value, bounds)
        return self.bias + linear + 0.5 * (s**2 - q).sum(axis=1)

    def fit(self, texts: list, labels: np.ndarray, epochs: int = 8, rate: float = 0.05, decay: float = 1e-4, batch: int = 64, seed: int = 2):
        """Adaptive gradient steps on the logistic loss."""
        if not len(texts):
            return self
        raw = features(texts, None)[3]
        self.cuts = np.quantile(raw, np.arange(1, BINS) / BINS, axis=0).T
        index, value, bounds, _ = features(texts, self.cuts)
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        seen_w, seen_v, seen_b = np.full(SIZE, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                n = bounds[rows + 1] - bounds[rows]
                own = np.concatenate(([0], np.cumsum(n)))
                flat = np.repeat(bounds[rows] - own[:-1], n) + np.arange(own[-1])
                i, x = index[flat], value[flat]
                vx, s, q, linear = self._sums(i, x, own)
                margin = self.bias + linear + 0.5 * (s**2 - q).sum(axis=1)
                slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
                each = np.repeat(slope, n)
                used, place = np.unique(i, return_inverse=True)
                gw = np.bincount(place, weights=each * x) + decay * self.w[used]
                inner = (each * x)[:, None] * (np.repeat(s, n, axis=0) - vx)
                gv = np.stack([np.bincount(place, weights=inner[:, k]) for k in range(inner.shape[1])], axis=1) + decay * self.v[used]
                seen_w[used] += gw**2
                seen_v[used] += gv**2
                seen_b += slope.sum() ** 2
                self.w[used] -= rate * gw / np.sqrt(seen_w[used])
                self.v[used] -= rate * gv / np.sqrt(seen_v[used])
                self.bias -= rate * slope.sum() / np.sqrt(seen_b)
        return self

    def scores(self, texts: list) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in slices(texts):
            index, value, bounds, _ = features(texts[a:b], self.cuts)
            out[a:b] = 1 / (1 + np.exp(-np.clip(self.margins(index, value, bounds), -500, 500)))
        return out


def _fitted(batches):
    """Fits one machine on the rows of the only partition."""
    texts, labels = [], []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
    m = Machine().fit(texts, np.array(labels, float))
    yield pa.RecordBatch.from_arrays(
        [pa.array([x], t) for x, t in ((m.bias, pa.float64()), (m.w.tobytes(), pa.binary()), (m.v.tobytes(), pa.binary()), (m.cuts.tobytes(), pa.binary()))],
        ["bias", "w", "v", "cuts"])


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, label: str, most: int) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``most`` labelled rows, by the hash of their ids."""
    ids = labels.filter(usable & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most `most` rows of two numbers.
    return docs.join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", most: int = SAMPLE) -> Machine:
    """A machine fitted in one task on the sample; ``usable`` is a condition on the labels."""
    rows = labelled_sample(docs, labels, usable, label, most).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most)
    r = rows.select("text", "label").coalesce(1).mapInArrow(_fitted, "bias double, w binary, v binary, cuts binary").first()
    machine = Machine()
    if r is not None:
        machine.bias, machine.w = r.bias, np.frombuffer(r.w)
        machine.v, machine.cuts = np.frombuffer(r.v).reshape(SIZE, -1), np.frombuffer(r.cuts).reshape(N_STATISTICS, -1)
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row; the machine is a few MB whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1).to_pylist()))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", most: int = SAMPLE,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; ``held_out`` is a condition on doc_id that bars labels."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    machine = fit(rows, labels, ~held_out, label, most)
    return score(rows, machine).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
