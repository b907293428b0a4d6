"""Toxicity from the nearest labelled examples by TF-IDF cosine.

Examples are a bounded sample of labelled rows.  Terms are the words of the examples and the first ``STEM``
bytes of longer ones, so that endings don't hide a word; labels play no part in the choice.  Document
frequencies are counted over all documents, and a term that a single document has, which joins no two texts, is left out.
A text is the sparse vector of all its terms that some example has.

The examples stand in an inverted index: a list of (example, weight) per term.  The lists of
the most frequent terms have full length, one matrix, and are summed first.  The others are cut
at blocks of examples that use the frequent terms alike, and keep the largest weight of each
block.  What the frequent terms give plus the sum of query weight times block weight over the
query's own terms bounds the cosine with every example of a block.  Blocks whose bound is
below the k-th best sum over the frequent terms are skipped, which loses nothing.  The sums are taken in
single precision with room for its errors; what may be among the k nearest is then taken exactly.

The k nearest vote with weights that fall with the distance.  A logistic curve, fitted on the
examples' own votes without themselves, turns votes into calibrated scores; of the numbers of neighbours the one
with the least logistic loss on these votes is used.  A text that
shares no term with any example has no neighbours and gets the calibrated score of the example
share among texts without words, or among all examples if all have words.  Neighbours with
equal cosine count in the order of the index.

Cases: a null or empty text has no terms; repeated rows are scored alike; labels that are
null or of unknown ids are left out, of several labels of an id the largest counts; without
usable labels every score is one half; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.fm_quality import labelled_sample
from strideline.llm.words import hashed_words, slices
from strideline.materialise import stored

#: Labelled rows of each class that become examples at most.
EXAMPLES = 6000
BLOCK, NEIGHBOURS = 64, (8, 16, 32)
#: Bytes of a word that are a term of their own.
STEM = 6
#: More than the errors of sums in single precision.
ROUNDING = 1e-4
#: Terms whose lists have full length, and queries that are compared with these at once.
FREQUENT, QUERIES_AT_ONCE = 256, 256

_BETWEEN = np.ones(256, bool)
_BETWEEN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = False
_BETWEEN[128:] = False


@dataclass
class Rows:
    """Sparse rows: ``term[bounds[i]:bounds[i + 1]]`` and the weights of row ``i``, and the counts behind them."""

    bounds: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    width: int
    count: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def taken(self, rows: np.ndarray) -> Rows:
        at, n = _ranges(self.bounds, rows)
        return Rows(np.concatenate(([0], np.cumsum(n))), self.term[at], self.weight[at], self.width, None if self.count is None else self.count[at])

    def of(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))

    def dense(self, terms: np.ndarray) -> np.ndarray:
        """The columns of ``terms``."""
        column = np.full(self.width, -1)
        column[terms] = np.arange(len(terms))
        at = np.flatnonzero(column[self.term] >= 0)
        x = np.zeros((len(self), len(terms)))
        x[self.of()[at], column[self.term[at]]] = self.weight[at]
        return x


def sparse(x: np.ndarray) -> Rows:
    row, term = np.nonzero(x)
    return Rows(np.searchsorted(row, np.arange(len(x) + 1)), term, x[row, term], x.shape[1])


def _ranges(bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places in the given ranges of bounds, one range after the other, and their lengths."""
    first = bounds[which]
    n = bounds[which + 1] - first
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0), n


def words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and their texts; words are runs of letters, digits and non-ASCII characters."""
    h, bounds, stems, longer = hashed_words(texts, _BETWEEN, STEM)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    return np.concatenate((h, stems)), np.concatenate((doc, doc[longer]))


def vocabulary(texts: list) -> np.ndarray:
    """Sorted hashes of all terms of the texts."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(words(texts[a:b])[0]) for a, b in slices(texts))]))


class Finder:
    """Places of hashes in sorted names, by a table of where each leading bit pattern begins."""

    def __init__(self, names: np.ndarray):
        bits = max(1, int(len(names)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(names, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.names = np.append(names, np.uint64(2**64 - 1))

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places, and which hashes are names."""
        place = self.first[(h >> self.shift).astype(np.int64)]
        todo = np.flatnonzero(self.names[place] < h)
        while len(todo):
            place[todo] += 1
            todo = todo[self.names[place[todo]] < h[todo]]
        return place, (self.names[place] == h) & (place < len(self.names) - 1)


def terms(texts: list, find: Finder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(text, term, count)`` of the words that are names, sorted."""
    h, doc = words(texts)
    term, known = find(h)
    width = len(find.names)
    key = np.sort(doc[known] * width + term[known])
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return key[first] // width, key[first] % width, np.diff(np.append(first, len(key)))


def vectors(texts: list, find: Finder, idf: np.ndarray) -> Rows:
    """Unit TF-IDF rows over all terms; empty rows for texts without any."""
    parts = [(a, *terms(texts[a:b], find)) for a, b in slices(texts)]
    none = np.zeros(0, np.int64)
    doc, term, count = (np.concatenate([none, *x]) for x in ([a + d for a, d, _, _ in parts], [t for _, _, t, _ in parts], [c for _, _, _, c in parts]))
    return weighted(np.searchsorted(doc, np.arange(len(texts) + 1)), term.astype(np.int32), count.astype(np.uint32), idf)


def weighted(bounds: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray) -> Rows:
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    weight = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(doc, weights=weight**2, minlength=len(bounds) - 1))
    return Rows(bounds, term, weight / norm[doc], len(idf), count)


class Lists:
    """The inverted index over rows: full lists of frequent terms, lists in blocks of the others."""

    def __init__(self, x: Rows):
        self.size, self.width, self.blocks = len(x), x.width, -(-len(x) // BLOCK)
        self.frequent = _frequent(x)
        self.full = np.ascontiguousarray(x.dense(self.frequent).T)
        self.rough = self.full.astype(np.float32)
        self.rare = np.ones(x.width, bool)
        self.rare[self.frequent] = False
        at = np.flatnonzero(self.rare[x.term])
        at = at[np.argsort(x.term[at], kind="stable")]
        term, self.place, self.weight = x.term[at].astype(np.int64), x.of()[at].astype(np.int32), x.weight[at]
        key = term * max(self.blocks, 1) + self.place // BLOCK
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        #: Entries are pairs of term and block: their bounds in the lists, block and largest weight.
        self.bounds, self.block = np.append(first, len(key)), self.place[first] // BLOCK
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.entries = np.searchsorted(term[first], np.arange(x.width + 1))

    def cosines(self, q: Rows, k: int, own: np.ndarray | None):
        """For each query the places that may be among the k nearest, and the cosines there."""
        for a in range(0, len(q), QUERIES_AT_ONCE):
            part = q.taken(np.arange(a, min(a + QUERIES_AT_ONCE, len(q))))
            dense = part.dense(self.frequent)
            some = dense.astype(np.float32) @ self.rough
            if own is not None:
                some[np.arange(len(part)), own[a : a + len(part)]] = -2
            least = np.partition(some, -k, axis=1)[:, -k] if self.size > k else np.full(len(part), -1.0)
            above = np.maximum.reduceat(some, np.arange(0, self.size, BLOCK), axis=1)
            for i in range(len(part)):
                term, weight = (v[part.bounds[i] : part.bounds[i + 1]] for v in (part.term, part.weight))
                rare = self.rare[term]
                at, n = _ranges(self.entries, term[rare])
                weight, block = np.repeat(weight[rare], n), self.block[at]
                live = above[i] + np.bincount(block, weights=weight * self.most[at], minlength=self.blocks) > least[i] - ROUNDING
                use = live[block]
                lists, n = _ranges(self.bounds, at[use])
                rest = np.bincount(self.place[lists], weights=np.repeat(weight[use], n) * self.weight[lists], minlength=self.size)
                places = np.flatnonzero(np.repeat(live, BLOCK)[: self.size])
                if own is not None:
                    places = places[places != own[a + i]]
                near = some[i, places] + rest[places]
                if len(places) > k:
                    places = places[near >= np.partition(near, -k)[-k] - 2 * ROUNDING]
                used = np.flatnonzero(dense[i])
                cosine = dense[i, used] @ self.full[np.ix_(used, places)] + rest[places]
                yield places, np.round(cosine, 10)


def _frequent(x: Rows) -> np.ndarray:
    n = np.bincount(x.term, minlength=x.width)
    return np.sort(np.lexsort((np.arange(len(n)), -n))[:FREQUENT])


def _alike(x: Rows) -> np.ndarray:
    """An order in which neighbours use the frequent terms alike: halves along the widest direction."""
    dense, todo, out = x.dense(_frequent(x)), [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK:
            out.append(rows)
            continue
        part = dense[rows] - dense[rows].mean(axis=0)
        way = 1 + np.arange(part.shape[1]) / part.shape[1]
        for _ in range(8):
            way = part.T @ (part @ way)
            way /= np.sqrt((way**2).sum()) + 1e-30
        rows = rows[np.argsort(np.round(part @ way, 8), kind="stable")]
        half = max(1, round(len(rows) / 2 / BLOCK)) * BLOCK
        todo += [rows[half:], rows[:half]]
    return np.concatenate([np.zeros(0, np.int64), *out])


@dataclass
class Index:
    """Examples with their terms and labels, and the calibration; the lists are made when first used."""

    names: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    x: Rows
    share: float
    curve: tuple[float, float]
    k: int = NEIGHBOURS[0]
    made: tuple | None = None

    def __getstate__(self) -> dict:
        """Counts go instead of weights, packed to less than half of the rows."""
        x = self.x
        return self.__dict__ | {"made": None, "x": zlib.compress(pickle.dumps((x.bounds, x.term, x.count)), 1)}

    def __setstate__(self, state: dict):
        self.__dict__.update(state)
        self.x = weighted(*pickle.loads(zlib.decompress(state["x"])), self.idf)

    def lists(self) -> tuple[Lists, Finder]:
        if self.made is None or self.made[0] is not self.x:
            self.made = self.x, Lists(self.x if isinstance(self.x, Rows) else sparse(self.x)), Finder(self.names)
        return self.made[1:]

    def vectors(self, texts: list) -> Rows:
        return vectors(texts, self.lists()[1], self.idf)

    def nearest(self, q: Rows | np.ndarray, k: int | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a positive cosine (else -1, 0).

        ``own`` names for each query an example to leave out.
        """
        q, lists, k = q if isinstance(q, Rows) else sparse(q), self.lists()[0], k or self.k
        place, best = np.full((len(q), k), -1), np.zeros((len(q), k))
        if not lists.size:
            return place, best
        for i, (at, cosine) in enumerate(lists.cosines(q, k, own)):
            if len(at) > k:
                near = np.flatnonzero(cosine >= np.partition(cosine, -k)[-k])
                at, cosine = at[near], cosine[near]
            order = np.argsort(-cosine, kind="stable")[:k]
            best[i, : len(order)] = np.maximum(cosine[order], 0)
            place[i, : len(order)] = np.where(cosine[order] > 0, at[order], -1)
        return place, best

    def votes(self, place: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Label share of the neighbours; weights fall with the angular distance."""
        weight = np.where(place >= 0, 1 / (0.05 + np.arccos(np.clip(cosine, 0, 1))), 0)
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[place]).sum(axis=1) / np.where(total > 0, total, 1), self.share) if len(self.labels) else np.full(len(place), 0.5)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * (votes - 0.5) + self.curve[1], -500, 500)))


def build(ids: np.ndarray, texts: list, labels: np.ndarray, names: np.ndarray, idf: np.ndarray, seen: np.ndarray | None = None) -> Index:
    """An index over the examples; ``seen`` weighs classes back to their shares in the data."""
    x = vectors(texts, Finder(names), idf)
    seen = np.ones(len(texts)) if seen is None else seen
    filled = np.diff(x.bounds) > 0
    empty = ~filled
    of = empty if seen[empty].sum() else filled
    share = float((labels * seen)[of].sum() / seen[of].sum()) if seen[of].sum() else 0.5
    order = np.flatnonzero(filled)
    order = order[_alike(x.taken(order))]
    x_in = x.taken(order)
    index = Index(names, idf, ids[order], labels[order].astype(float), x_in, share, (4.0, 0.0))
    if len(np.unique(labels)) == 2:
        place, cosine = index.nearest(x_in, max(NEIGHBOURS), np.arange(len(order)))
        y, w = np.concatenate((labels[order], labels[empty])), np.concatenate((seen[order], seen[empty]))
        losses = []
        for k in NEIGHBOURS:
            z = np.concatenate((index.votes(place[:, :k], cosine[:, :k]), np.full(empty.sum(), share))) - 0.5
            curve = _curve(z, y, w)
            p = np.clip(1 / (1 + np.exp(-(curve[0] * z + curve[1]))), 1e-9, 1 - 1e-9)
            losses.append((float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()), k, curve))
        _, index.k, index.curve = min(losses)
    return index


def _curve(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and level of the logistic curve over centred votes: Newton steps on the loss with a weak prior."""
    a, b = 4.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = w * (p - y), w * p * (1 - p)
        grad = np.array([(g * z).sum() + 0.01 * a, g.sum() + 0.01 * b])
        hess = np.array([[(h * z * z).sum() + 0.01, (h * z).sum()], [(h * z).sum(), h.sum() + 0.01]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    return float(max(a, 0.1)), float(b)


def _document_counts(names: np.ndarray):
    """Documents of a partition that have each term, and their number under -1."""
    def run(batches):
        total, count, find = 0, np.zeros(len(names), np.int64), Finder(names)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            total += len(texts)
            for a, b in slices(texts):
                count += np.bincount(terms(texts[a:b], find)[1], minlength=len(names))
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, met), pa.int32()), pa.array(np.append(total, count[met]), pa.int64())], ["term", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", most: int = EXAMPLES) -> Index:
    """An index of at most ``most`` examples of each label, with frequencies over all documents."""
    is_one = F.col(label) == 1
    sample = labelled_sample(docs, labels, usable & is_one, label, most).union(labelled_sample(docs, labels, usable & ~is_one, label, most))
    sample = stored(sample.select("doc_id", "text", "label").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * most), "examples")
    examples = sample.coalesce(1)
    names = np.frombuffer(examples.mapInArrow(_in_task(lambda ids, texts, y: vocabulary(texts).tobytes()), "made binary").first()[0], np.uint64)
    # At most one row per term of the examples.
    counts = docs.select("text").mapInArrow(_document_counts(names), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    having = np.zeros(len(names) + 1)
    having[counts.column("term").to_numpy() + 1] = counts.column("n").to_numpy()
    shared = having[1:] >= 2
    names, idf = names[shared], (np.log((1 + having[0]) / (1 + having[1:])) + 1)[shared]
    shares = {r.y: r.n for r in labels.filter(usable & F.col(label).isNotNull()).groupBy((is_one).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}

    def indexed(ids: np.ndarray, texts: list, y: np.ndarray) -> bytes:
        weight = np.array([shares.get(int(v), 1) / max((y == v).sum(), 1) for v in y])
        return pickle.dumps(build(ids, texts, y, names, idf, weight / weight.mean() if len(weight) else weight))

    return pickle.loads(examples.mapInArrow(_in_task(indexed), "made binary").first()[0])


def _in_task(make):
    """Runs ``make(ids, texts, labels)`` on all rows of the only partition, in the order of ids."""
    def run(batches):
        rows = sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: (r[0], r[1] or ""))
        made = make(np.array([r[0] for r in rows], np.int64), [r[1] for r in rows], np.array([r[2] for r in rows], float))
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["made"])

    return run


_SCORES = "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,label:int>>"
_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """``(doc_id, score, evidence)`` of every row; the index has at most 2 * EXAMPLES rows."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                place, cosine = model.nearest(model.vectors(part.column(1).to_pylist()))
                proof = [[{"doc_id": int(model.ids[p]), "cosine": float(c), "label": int(model.labels[p])} for p, c in zip(ps, cs, strict=True) if p >= 0]
                         for ps, cs in zip(place[:, :evidence], cosine[:, :evidence], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(model.calibrated(model.votes(place, cosine))), pa.array(proof, _EVIDENCE)], ["doc_id", "score", "evidence"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _SCORES)


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", most: int = EXAMPLES,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, evidence; ``held_out`` bars labels from the examples."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    index = fit(rows, labels, ~held_out, label, most)
    return score(rows, index).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
