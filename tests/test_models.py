import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.models import isolation as iso
from strideline.models import metrics as me
from strideline.models import neighbours as nn
from strideline.models import search as se
from strideline.models import svm
from strideline.operators import splits as sp


def naive_dtw(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return np.sqrt(d[-1, -1])


def test_dtw_of_all_pairs():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(4, 9)), rng.normal(size=(3, 9))
    got = nn.distances(a, b, "dtw")
    assert np.allclose(got, [[naive_dtw(u, v) for v in b] for u in a])
    assert (nn.distances(a, b, "softdtw") <= got**2 + 1e-9).all()
    assert np.allclose(nn.distances(a, b, "dtw", band=0), nn.distances(a, b, "euclidean"))


def test_neighbours_over_many_tiles(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r], float(i % 3)) for i, r in enumerate(x)], "id bigint, s array<double>, y double")
    got = nn.nearest_neighbours(df.where("id < 45"), df.where("id >= 45"), "id", "s", "y", 4, "euclidean", tile_rows=7).toPandas()
    for i in range(45, 60):
        want = np.argsort(np.linalg.norm(x[:45] - x[i], axis=1))[:4]
        assert list(got[got.id == i].sort_values("place").neighbour) == list(want)


def test_isolation_finds_the_far_row(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    x[7] = [40.0, -40.0]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id bigint, a double, b double")
    kept = iso.isolation_filter(df, ["a", "b"], ["id"], contamination=0.01, trees=200)
    ids = {r["id"] for r in kept.select("id").collect()}
    assert 7 not in ids and len(ids) == 297


def test_isolation_paths_are_complete():
    model = iso.IsolationModel(np.zeros((1, 7), dtype=int), np.full((1, 7), np.inf), np.zeros((1, 8)), 3, 5)
    iso._grow(np.array([[0.0], [1.0], [2.0], [3.0], [50.0]]), 3, np.random.default_rng(0), 0, model)
    assert (model.paths > 0).all()
    scores = model.scores(np.array([[0.0], [50.0]]))
    assert ((scores < 0) & (scores > -1)).all()


def test_report_guards_empty_classes(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0), (1.0, 0.0)], "a double, p double")
    rows = {r["entry"]: r for r in me.classification_report(df, "a", "p").collect()}
    assert rows["1.0"]["precision"] == 0.0 and rows["1.0"]["support"] == 1 and np.isclose(rows["accuracy"]["f1"], 2 / 3)
    matrix = {(r["actual"], r["predicted"]): r["rows"] for r in me.confusion_matrix(df, "a", "p").collect()}
    assert matrix == {(0.0, 0.0): 2, (0.0, 1.0): 0, (1.0, 0.0): 1, (1.0, 1.0): 0}


def test_best_model_ties(spark):
    rows = [(2, "svc", 0.8), (1, "mlp_classifier", 0.9), (1, "cart_tree", 0.9), (3, "svc", 0.9)]
    assert me.best_model(spark.createDataFrame(rows, "combo int, model string, score double")).first()["model"] == "cart_tree"


@pytest.mark.parametrize("model_type", ["cart_tree", "random_forrest", "svc", "mlp_classifier"])
def test_drawn_parameters_build(model_type, spark):
    drawn = se.draw_parameters(model_type, 5, 4, seed=1)
    assert drawn == se.draw_parameters(model_type, 5, 4, seed=1)
    for params in drawn:
        assert se.setting_of(model_type, params) if model_type in se.TOGETHER else se.build_stages(model_type, params, 4, 2, 100, "label")


def test_search_and_store(spark, tmp_path):
    from strideline.sources import store

    df = spark.range(60).select("id", (F.col("id") % 2).cast("double").alias("y"), ((F.col("id") % 2) * 3.0 + F.rand(1)).alias("v"))
    found = se.random_search(df, ["v"], "y", "id", "cart_tree", draws=1, folds=2)
    assert found.cv_score == 1.0
    store.write_model(found.model, str(tmp_path / "m"))
    assert se.predict(store.load_model(str(tmp_path / "m")), df, ["v"], ["id", "y"]).where("y != prediction").count() == 0


def test_features_approximate_the_kernels(monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 3))
    monkeypatch.setattr(svm, "SIZE", 8192)
    z = svm.kernel_features(x, svm.SvmSettings(kernel="rbf", gamma=0.5))[:, :-1]
    assert np.abs(z @ z.T - np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))).max() < 0.1
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    z = svm.kernel_features(x, svm.SvmSettings(kernel="poly", degree=3, gamma=1.0))[:, :-1]
    assert np.abs(z @ z.T - (x @ x.T) ** 3).max() < 0.15


def test_support_vectors_of_all_kernels(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 2))
    y = ((x**2).sum(axis=1) > 1.4).astype(int)
    df = spark.createDataFrame([([float(v) for v in r], int(c), i % 4, i) for i, (r, c) in enumerate(zip(x, y))], "x array<double>, label int, fold int, row long").repartition(3).cache()
    settings = [svm.SvmSettings("linear", C=10.0), svm.SvmSettings("rbf", gamma=0.5, C=100.0), svm.SvmSettings("poly", degree=2, C=100.0), svm.SvmSettings("rbf", gamma=1e9, C=2.0), svm.SvmSettings("rbf", gamma=0.5, C=100.0, max_iter=2)]
    best, mean, model = svm.search(df, settings, 4, 2, 2)
    assert best in (1, 2) and mean > 0.9 and model.getOrDefault(model.machine)
    machines = svm.train(df, [(s, None) for s in settings], 2)
    assert [m.steps for m in machines][4] == 2 and all(np.isfinite(m.weights).all() for m in machines)
    # At the least of the penalised loss its slope is close to zero.
    z, side = svm.kernel_features(x, settings[0]), np.where(y == 1, 1.0, -1.0)
    _, g = svm.loss_and_gradient(z, side, machines[0].weights)
    g = g / len(y) + np.append(machines[0].weights[:-1], 0.0) / (10.0 * len(y))
    assert np.abs(g).max() < 1e-2


def test_balanced_split_is_accepted(spark):
    counts = spark.createDataFrame([(i, 40 + i % 7, 100) for i in range(40)], "s bigint, hits bigint, rows bigint")
    found = sp.find_balanced_split(counts, "s", "hits", "rows")
    assert found and abs(found["train_share"] - 0.43) < 0.2
    parts = sp.assign_parts(counts.select("s"), "s", found["seed"]).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 20, "test": 10, "valid": 10}


def aligned(a, b, soft, band):
    """Alignment cost of two series, cell by cell."""
    n, m = len(a), len(b)
    width = max(n, m) if band is None else max(band, abs(n - m))
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - width), min(m, i + width) + 1):
            ways = [cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1]]
            low = min(ways)
            least = low - np.log(sum(np.exp(low - w) for w in ways)) if soft else low
            cost[i, j] = (a[i - 1] - b[j - 1]) ** 2 + least
    return cost[n, m]


@pytest.mark.parametrize("metric,band", [("dtw", None), ("dtw", 2), ("softdtw", None), ("softdtw", 1), ("sqeuclidean", None), ("cityblock", None)])
def test_bounds_lose_no_neighbour(spark, metric, band):
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 3, (6, 9))
    x = np.concatenate([c + rng.normal(0, 0.3, (20, 9)) for c in centres] + [np.repeat(centres[:1], 4, axis=0)])
    rng.shuffle(x)
    y = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(i, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(x, y))], "id int, s array<double>, y double")
    computed = spark.sparkContext.accumulator(0)
    got = nn.nearest_neighbours(df.where("id >= 30"), df.where("id < 30"), "id", "s", "y", 3, metric, band, tile_rows=8, computed=computed).toPandas()
    for i in range(30):
        if metric in nn.ALIGNED:
            d = np.array([aligned(x[i], x[j], metric == "softdtw", band) for j in range(30, len(x))])
            d = np.sqrt(d) if metric == "dtw" else d
        else:
            d = (np.abs(x[30:] - x[i]) if metric == "cityblock" else (x[30:] - x[i]) ** 2).sum(axis=1)
        mine = got[got.id == i].sort_values("place")
        assert np.allclose(mine.distance, np.sort(d)[:3])
        assert np.allclose(d[mine.neighbour - 30], np.sort(d)[:3])
    print(metric, band, computed.value / (30 * (len(x) - 30)))


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1.0), (2, [1.0, 2.5], 0.0), (3, [9.0, 9.0], 1.0)], "id int, s array<double>, y double")
    got = nn.nearest_neighbours(df.where("id < 3"), df.where("id = 3"), "id", "s", "y", 5, "dtw")
    assert [(r["neighbour"], r["place"]) for r in got.orderBy("place").collect()] == [(2, 1), (1, 2)]
    assert nn.nearest_neighbours(df.where("false"), df, "id", "s", "y", 5, "dtw").count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "cityblock"])
@pytest.mark.parametrize("limited", [False, True])
def test_cheap_comparison_loses_no_pair(metric, limited, monkeypatch):
    monkeypatch.setattr(nn, "LEFT", 7)
    monkeypatch.setattr(nn, "RIGHT", 13)
    monkeypatch.setattr(nn, "NARROW", 11)
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(40, 5)) + 1e6, rng.normal(size=(90, 5)) + 1e6
    b[::3], a[5] = b[1], b[1]  # many equal rows: smaller ids win
    b[4, 2], a[9, 0] = np.nan, np.inf
    ids = rng.permutation(90)
    d = nn.distances(a, b, metric)
    kth = np.sort(np.where(np.isnan(d), np.inf, d), axis=1)[:, 3]
    i, j, got, _ = nn._nearest_pairs(a, kth if limited else np.full(40, np.inf), b, ids, 4, metric)
    for r in range(40):
        own = np.flatnonzero(i == r)
        order = [c for c in np.lexsort((ids, d[r])) if np.isfinite(d[r, c])][:4]
        assert sorted(j[own]) == sorted(order) and np.array_equal(np.sort(got[own]), np.sort(d[r, order]))


def test_alignments_by_rows():
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(6, 8)), rng.normal(size=(6, 8))
    for soft, band in ((False, None), (True, None), (True, 2), (False, 2)):
        want = []
        for x, y in zip(a, b, strict=True):
            c = np.full((9, 9), np.inf)
            c[0, 0] = 0
            for i in range(1, 9):
                for j in range(1, 9):
                    if band is None or abs(i - j) <= band:
                        o = np.array([c[i - 1, j], c[i - 1, j - 1], c[i, j - 1]])
                        c[i, j] = (x[i - 1] - y[j - 1]) ** 2 + (o.min() - np.log(np.exp(o.min() - o).sum()) if soft else o.min())
            want.append(c[8, 8])
        assert np.allclose(nn._alignment_costs(a, b, soft, band), want)


@pytest.mark.parametrize("metric", ["dtw", "softdtw"])
@pytest.mark.parametrize("band", [None, 0, 3])
@pytest.mark.parametrize("stretch", [1e-3, 0.1, 40.0, 1e8])
def test_alignments_in_small_numbers(metric, band, stretch, monkeypatch):
    """Values in less precision rule out most pairs before they are aligned in full, and none of the nearest."""
    rng = np.random.default_rng(3)
    a, b = (np.cumsum(rng.normal(size=(size, 24)), axis=1) * stretch + 5 * stretch for size in (30, 700))
    b[5], b[6, 3], b[7] = a[2], np.nan, a[2]
    full, slow = 0, nn._alignment_costs

    def counted(x, *rest):
        nonlocal full
        full += len(x)
        return slow(x, *rest)

    d = nn.distances(a, b, metric, band)
    monkeypatch.setattr(nn, "_alignment_costs", counted)
    kth = np.sort(np.where(np.isfinite(d), d, np.inf), axis=1)[:, [3]]
    for limit in (np.full(30, np.inf), kth[:, 0]):
        full = 0
        got, done = nn._compared(a, limit, b, 4, metric, band)
        assert np.array_equal(np.where(d <= kth, got, 0.0), np.where(d <= kth, d, 0.0))
        if metric == "dtw" and band != 0:
            assert full < 0.6 * done or done < 30 * 40


def test_ranges_bound_alignments():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(20, 9)) + 1000, rng.normal(size=(15, 9)) * 3 + 1000
    want = nn.outside(a, *nn.envelope(b, None), "dtw")
    got = nn._outside_ranges(a, b)
    assert (got <= want).all() and np.allclose(got, want, atol=1e-4)


@pytest.mark.parametrize("band", [None, 2])
def test_sums_over_ways_bound_soft_costs(band):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(40, 33)) / 8, rng.normal(size=(40, 33)) / 8
    want = nn._alignment_costs(a, b, True, band)
    x, y = (np.ascontiguousarray(v.T, np.float32) for v in (a, b))
    assert np.allclose(nn._quick_sums(x, y, band, True), want, atol=1e-3)
    assert (nn._quick_sums(x, y, band, False) <= want + 1e-3).all()
