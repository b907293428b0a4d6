"""Trees and perceptrons that are trained together, against plain versions of one model."""

import numpy as np
import pytest

from strideline.models import perceptron as pe
from strideline.models import trees as tr
from strideline.models.trees import TreeSettings


def rows(spark, x, y, fold=None):
    fold = np.zeros(len(x), int) if fold is None else fold
    return spark.createDataFrame([([float(v) for v in r], int(c), int(f), i) for i, (r, c, f) in enumerate(zip(x, y, fold))], "x array<double>, label int, fold int, row long").repartition(3)


def plain_tree(x, y, s, depth=0):
    """Leaf label, or (feature, cut, left, right), by trying all cuts."""
    counts = np.bincount(y, minlength=2)
    if depth >= s.max_depth or len(y) < s.min_samples_split or counts.min() == 0:
        return int(counts.argmax())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for c in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= c
            if min(left.sum(), (~left).sum()) < s.min_samples_leaf:
                continue
            parts = [np.bincount(y[m], minlength=2) for m in (left, ~left)]
            gain = tr.impurity(counts, s.criterion) - sum(p.sum() / len(y) * tr.impurity(p, s.criterion) for p in parts)
            if best is None or round(float(gain), 12) > best[0]:
                best = (round(float(gain), 12), f, c, left)
    if best is None:
        return int(counts.argmax())
    _, f, c, left = best
    return f, c, plain_tree(x[left], y[left], s, depth + 1), plain_tree(x[~left], y[~left], s, depth + 1)


def followed(node, row):
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def data(seed, n=160):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 4)).astype(float)
    y = ((x[:, 0] + x[:, 1] > 11) ^ (rng.random(n) < 0.15)).astype(int)
    return x, y


def test_trees_equal_plain_ones(spark):
    x, y = data(0)
    fold = np.arange(len(x)) % 3
    df = rows(spark, x, y, fold)
    edges = tr.bin_edges(df, 4)
    table = tr.binned(df, edges).cache()
    plans = [(TreeSettings(max_depth=d, criterion=c, min_samples_leaf=leaf, min_samples_split=split), f)
             for d, c, leaf, split in ((30, "gini", 1, 2), (3, "entropy", 1, 2), (30, "gini", 7, 2), (30, "entropy", 2, 25)) for f in (None, 0, 2)]
    grown = tr.grow(table, plans, 4, 2)
    for (s, held), tree in zip(plans, grown):
        own = np.ones(len(x), bool) if held is None else fold != held
        want = plain_tree(x[own], y[own], s)
        cuts = np.array([edges[f][c] if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut)])
        got = tr._labels(tree)[tr.nodes_of(x, np.array(tree.feature), cuts, np.array(tree.left))]
        assert got.tolist() == [followed(want, r) for r in x]
        assert max(tree.depth) <= s.max_depth
        for f, c, d in zip(tree.feature, tree.counts, tree.depth):
            assert f < 0 or sum(c) >= s.min_samples_split
            assert sum(c) >= s.min_samples_leaf
    hits = tr.held_out_hits(table, grown, plans, 4)
    assert [n for _, n in hits] == [0 if f is None else int((fold == f).sum()) for _, f in plans]


def test_every_tree_parameter_has_an_effect(spark):
    x, y = data(1)
    table = tr.binned(rows(spark, x, y), tr.bin_edges(rows(spark, x, y), 4)).cache()
    base = TreeSettings(max_depth=6)
    changes = [{}, {"max_depth": 2}, {"criterion": "entropy"}, {"splitter": "random"}, {"min_samples_split": 40}, {"min_samples_leaf": 15}, {"max_features": 1},
               {"splitter": "random", "seed": 5}, {"max_features": 1, "seed": 5}]
    plans = [(TreeSettings(**{**base.__dict__, **c}), None) for c in changes]
    shapes = [(t.feature, t.cut) for t in tr.grow(table, plans, 4, 2)]
    assert shapes == [(t.feature, t.cut) for t in tr.grow(table, plans, 4, 2)]
    for i in range(1, 7):
        assert shapes[i] != shapes[0], changes[i]
    assert shapes[7] != shapes[3] and shapes[8] != shapes[6]
    with pytest.raises(ValueError):
        tr.best_split(np.ones((2, tr.BINS, 2)), TreeSettings(splitter="other"), 0)


def spiral(n=240, seed=0):
    rng = np.random.default_rng(seed)
    t = rng.random(n) * 1.6 + 0.2
    y = rng.integers(0, 2, n)
    angle = 3.2 * t + np.pi * y
    return np.stack((t * np.cos(angle), t * np.sin(angle)), axis=1) * 2 + rng.normal(0, 0.05, (n, 2)), y


@pytest.mark.parametrize("activation", ["logistic", "relu", "tanh"])
def test_gradient(activation):
    rng = np.random.default_rng(2)
    x, y, layers = rng.normal(size=(9, 3)), rng.integers(0, 2, 9), (3, 5, 4, 2)
    w = pe.first_weights(layers, 1) + rng.normal(0, 0.1, sum(a * b + b for a, b in zip(layers, layers[1:])))
    _, g = pe.loss_and_gradient(x, y, w, layers, activation)
    for i in range(0, len(w), 7):
        step = np.zeros_like(w)
        step[i] = 1e-6
        numeric = (pe.loss_and_gradient(x, y, w + step, layers, activation)[0] - pe.loss_and_gradient(x, y, w - step, layers, activation)[0]) / 2e-6
        assert g[i] == pytest.approx(numeric, abs=1e-4)


def test_nets_learn_a_spiral_and_parameters_matter(spark):
    x, y = spiral()
    df = rows(spark, x, y).selectExpr("x", "label", "fold", "row % 10 = 0 AS back").repartition(2, "back").cache()
    base = dict(hidden=(16, 8), activation="tanh", learning_rate=0.02, batch_size=8, max_iter=60, seed=3)
    changes = [{"solver": "lbfgs", "max_iter": 150}, {}, {"alpha": 100.0}, {"batch_size": 2}, {"solver": "sgd"}, {"solver": "sgd", "schedule": "invscaling"},
               {"solver": "sgd", "schedule": "adaptive", "learning_rate": 0.5}, {"shuffle": False}, {"early_stopping": True}, {"activation": "relu"}, {"activation": "logistic"},
               {"learning_rate": 1e9}, {"hidden": (8, 4)}, {"max_iter": 3}]
    nets = pe.train(df, [(pe.NetSettings(**{**base, **c}), None) for c in changes], 2, 2)
    right = [float((pe.outputs(x, n.weights, n.layers, n.settings.activation)[-1].argmax(axis=1) == y).mean()) for n in nets]
    assert right[0] > 0.95 and right[1] > 0.95, right
    assert all(np.isfinite(n.weights).all() for n in nets)
    size = [float((n.weights**2).sum()) for n in nets]
    assert size[2] < 0.5 * size[1]
    assert len({round(v, 9) for i, v in enumerate(size)}) == len(size)
    assert nets[13].epoch == 3 and nets[8].epoch <= 60
    again = pe.train(df, [(pe.NetSettings(**base), None)], 2, 2)[0]
    assert np.allclose(again.weights, nets[1].weights)


def test_search_keeps_the_best(spark):
    x, _ = data(4, 240)
    y = (x[:, 0] + x[:, 1] > 11).astype(int)
    df = rows(spark, x, y, np.arange(240) % 4)
    best, mean, model = tr.search(df, [TreeSettings(max_depth=1), TreeSettings(max_depth=4), TreeSettings(max_depth=4, min_samples_leaf=50)], 4, 4, 2)
    assert best == 1 and mean > 0.6 and model.getOrDefault(model.nodes)
    best, mean, model = pe.search(df, [pe.NetSettings(learning_rate=1e-9, max_iter=2), pe.NetSettings(hidden=(8, 4), solver="lbfgs", max_iter=40)], 4, 4, 2)
    assert best == 1 and mean > 0.6


def test_small_nodes_travel_as_rows():
    rng = np.random.default_rng(3)
    width, classes = 12, 3
    size = width * tr.BINS * classes
    own = np.concatenate([np.zeros(3000, int), rng.integers(1, 40, 200)])
    x, label = rng.integers(0, tr.BINS, (3200, width)).astype(np.uint8), rng.integers(0, classes, 3200)
    cell = own[:, None] * size + np.arange(width) * tr.BINS * classes + x.astype(np.int64) * classes + label[:, None]
    chosen, packed = tr._smaller_rows(own, np.unique(cell), size, 40, x, label)
    assert not chosen[0] and chosen[1:].any()
    for node in range(40):
        rows = np.frombuffer(packed[node].as_py(), np.uint8).reshape(-1, width + 4)
        want = np.flatnonzero(own == node) if chosen[node] else []
        assert np.array_equal(rows[:, :width], x[want]) and np.array_equal(np.ascontiguousarray(rows[:, width:]).view("<i4").ravel(), label[want])
    # Before, a cell of a node took twelve bytes.
    assert sum(len(v.as_py()) for v in packed) < 12 * len(np.unique(cell[np.isin(own, np.flatnonzero(chosen))])) / 6


def test_nets_that_step_together_equal_nets_alone():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(203, 4))
    y, fold, layers = (x[:, 0] > 0).astype(int), rng.integers(0, 3, 203), (4, 8, 4, 2)
    first = pe.first_weights(layers, 1)
    for solver, schedule, size in (("adam", "constant", 5), ("sgd", "invscaling", 1), ("sgd", "adaptive", 300)):
        s = pe.NetSettings((8, 4), "tanh", solver, schedule=schedule, batch_size=size, seed=2)
        nets = [pe.Net(layers, s, f, first, 1e-3 * (f + 1), steps=3 * f) for f in range(3)]
        rows = [np.flatnonzero(fold != f) for f in range(3)]
        together = pe._descended(nets, x, y, rows)
        for net, own, found in zip(nets, rows, together, strict=True):
            assert np.array_equal(pe._descended([net], x, y, [own])[0], found)
            # Plain mini-batches.
            w, m, v, t = first.copy(), np.zeros(len(first)), np.zeros(len(first)), net.steps
            order = own[np.random.default_rng([2, 0]).permutation(len(own))]
            for at in range(0, len(order), size):
                part, t = order[at : at + size], t + 1
                g = pe.loss_and_gradient(x[part], y[part], w, layers, "tanh")[1] / len(part) + s.alpha * w / len(own)
                if solver == "adam":
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    w = w - net.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                else:
                    m = 0.9 * m - (net.rate / np.sqrt(t) if schedule == "invscaling" else net.rate) * g
                    w = w + m
            assert np.allclose(found[: len(w)], w, rtol=1e-12, atol=1e-15)
    overflow = pe.Net(layers, pe.NetSettings((8, 4), "relu", "sgd", learning_rate=1e200), None, first, 1e200)
    with np.errstate(all="ignore"):
        assert np.isnan(pe._descended([overflow], x, y, [np.arange(203)])[0]).all()
