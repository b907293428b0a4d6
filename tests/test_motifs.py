import numpy as np
import pyarrow as pa
import pytest

from strideline.functions import motifs as mt

M = 6


def z(v):
    return (v - v.mean()) / v.std()


def brute_profile(x, m, zone):
    w = [z(x[i : i + m]) for i in range(len(x) - m + 1)]
    d = np.array([[np.linalg.norm(a - b) for b in w] for a in w])
    i = np.arange(len(w))
    p = d.copy()
    p[np.abs(i[:, None] - i[None, :]) <= zone] = np.inf
    return d, p.min(axis=1), p.argmin(axis=1)


def brute_motifs(x, m, radius, count):
    d, best, partner = brute_profile(x, m, mt.profile_zone(m))
    zone, n = mt.motif_zone(m), len(best)
    open_, found = np.ones(n, bool), []
    for tag in range(1, count + 1):
        seed = min((i for i in range(n) if open_[i]), key=lambda i: (best[i], i))
        chosen = [seed, partner[seed]]
        free = open_.copy()
        for c in chosen:
            free[max(0, c - zone) : c + zone + 1] = False
        for i in sorted((i for i in range(n) if free[i] and d[seed, i] <= radius * best[seed]), key=lambda i: (d[seed, i], i)):
            if free[i]:
                chosen.append(i)
                free[max(0, i - zone) : i + zone + 1] = False
        found += [(tag, int(c)) for c in chosen]
        for c in chosen:
            open_[max(0, c - zone) : c + zone + 1] = False
    return sorted(found)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=160)
    x[20:30], x[100:110] = np.sin(np.arange(10)), np.sin(np.arange(10)) + rng.normal(0, 0.05, 10)
    return x, spark.createDataFrame([(i, float(v), 1.0 if i < 80 else 3.0) for i, v in enumerate(x)], "pos bigint, x double, y double").cache()


@pytest.mark.parametrize("tile_rows", [16, 1024])
def test_profile_of_one_long_series(series, tile_rows):
    x, df = series
    _d, best, _partner = brute_profile(x, M, mt.profile_zone(M))
    got = mt.matrix_profile(df, [], "pos", "x", M, tile_rows=tile_rows).toPandas().sort_values("pos")
    assert list(got.pos) == list(range(len(best))) and np.allclose(got.distance, best, atol=1e-6)


@pytest.mark.parametrize("m", [8, 50, 200])
def test_profile_of_any_window_length_over_slices(spark, m):
    rng = np.random.default_rng(m)
    x = np.round(np.cumsum(rng.normal(size=900)), 2) + 1e4
    x[300:310] = x[300]
    holes = {450, 451}
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x) if i not in holes], "pos bigint, x double")
    starts = [i for i in range(len(x) - m + 1) if x[i : i + m].std() > 0 and not holes & set(range(i, i + m))]
    w = np.array([z(x[i : i + m]) for i in starts])
    d = np.sqrt(np.maximum(0, 2 * m - 2 * w @ w.T))
    at = np.array(starts)
    d[np.abs(at[:, None] - at[None, :]) <= mt.profile_zone(m)] = np.inf
    got = mt.matrix_profile(df, [], "pos", "x", m, tile_rows=128).toPandas().sort_values("pos")
    want = d.min(axis=1)
    assert list(got.pos) == [s for s, b in zip(starts, want) if np.isfinite(b)]
    assert np.allclose(got.distance, want[np.isfinite(want)], atol=1e-5)


def greedy(rows, zone):
    chosen = []
    for d, p in sorted((d, p) for p, d in rows):
        if all(abs(p - c) > zone for c in chosen):
            chosen.append(p)
    return sorted(chosen)


@pytest.mark.parametrize("kind", ["equal", "falling", "rising", "random", "few"])
def test_greedy_choice_across_slices(spark, kind):
    rng = np.random.default_rng(3)
    made = {"equal": lambda i: 1.0, "falling": lambda i: -i, "rising": lambda i: i, "random": lambda i: rng.random(), "few": lambda i: float(rng.integers(3))}[kind]
    rows = [(k, i, float(made(i))) for k in (1, 2) for i in range(400) if kind != "few" or rng.random() < 0.4]
    df = spark.createDataFrame(rows, "k int, pos bigint, distance double")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    got = mt.suppress_neighbours(df, ["k"], 4, slice_rows=32)
    used = len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(jobs))
    for k in (1, 2):
        assert sorted(r["pos"] for r in got.where(f"k = {k}").collect()) == greedy([(p, d) for q, p, d in rows if q == k], 4)
    assert used <= 24  # three passes and two questions, whatever the number of slices


@pytest.mark.parametrize("radius,slice_rows", [(1.5, 1 << 20), (4.0, 16)])
def test_motifs_match_the_greedy_order(series, radius, slice_rows):
    x, df = series
    got = mt.top_motifs(df, [], "pos", "x", M, radius, 2, slice_rows=slice_rows).collect()
    assert sorted((r["tag"], r["pos"]) for r in got) == brute_motifs(x, M, radius, 2)


def test_motif_features_and_labels(spark, series):
    x, df = series
    occ = spark.createDataFrame([(1, 78, 0.5), (2, 3, 0.7)], "tag int, pos bigint, distance double")
    row = mt.motif_features(df, [], "pos", "x", occ, M).where("motif = 1").first()
    assert np.allclose([row[c] for c in mt.MOTIF_COLUMNS], [x[78:84].mean(), 1, x[78:84].std(), x[78:84].min(), x[78:84].max(), 0.5])
    labels = {r["occurrence"]: r["label"] for r in mt.motif_labels(df, [], "pos", "y", occ).collect()}
    assert labels == {78: 1.0, 3: 1.0}
    assert mt.motif_features(df, [], "pos", "x", occ, M, 2).columns == ["motif", "occurrence", "mean", "tag"]


def test_products_of_short_windows_find_what_running_sums_find(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.round(np.cumsum(rng.normal(size=700)), 2)
    x[200:230], x[400] = 5.0, np.nan
    left, right = mt._Windows(x[:400], 9, 1.0), mt._Windows(x[250:], 9, 1.0)
    got = mt._nearest_short(left, right, 3, 170)
    monkeypatch.setattr(mt, "SHORT", 0)
    for a, b in zip(got, mt._nearest(left, right, 3, 170), strict=True):
        assert (a == b).mean() > 0.99 and ((a >= 0) == (b >= 0)).all()


@pytest.mark.parametrize("side", [16, 48, 1024])
def test_slices_that_share_a_task(spark, monkeypatch, side):
    monkeypatch.setattr(mt, "TILE_ROWS", side)  # one, three and all slices of a side
    x = np.random.default_rng(8).normal(size=230)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x) if not 90 <= i < 130], "pos bigint, x double")
    starts = [i for i in range(225) if i + M <= 90 or 130 <= i]
    w = np.array([z(x[i : i + M]) for i in starts])
    d = np.sqrt(np.maximum(0, 2 * M - 2 * w @ w.T))
    d[np.abs(np.subtract.outer(starts, starts)) <= mt.profile_zone(M)] = np.inf
    got = mt.matrix_profile(df, [], "pos", "x", M, tile_rows=16).toPandas().sort_values("pos")
    assert list(got.pos) == starts and np.allclose(got.distance, d.min(axis=1), atol=1e-6)
    assert list(got.partner) == [starts[i] for i in d.argmin(axis=1)]


def test_sides_that_grow_are_never_broadcast(spark, series):
    x, df = series
    occ = spark.createDataFrame([(1, 78, 0.5), (2, 3, 0.7)], "tag int, pos bigint, distance double")
    for made in (mt.motif_features(df, [], "pos", "x", occ, M), mt.motif_labels(df, [], "pos", "y", occ), mt._away(df, occ, [], 3)):
        made.collect()
        assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["pos"] for r in mt._away(df, occ, [], 3).collect()) == [i for i in range(160) if abs(i - 78) > 3 and i > 6]


@pytest.mark.parametrize("group_rows", [96, 1 << 18])
def test_boxes_lose_no_partner(spark, group_rows, monkeypatch):
    """Most pairs of short windows are left out, and every window still finds its nearest and first partner."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=150), np.zeros(20), np.tile([0.0, 1.0, 4.0, 2.0, 5.0, 3.0], 20), np.cumsum(rng.normal(size=110))]).round(2)
    z = mt._Windows(x, M, x.mean())
    at = np.flatnonzero(z.ok)
    a = z.standard(at)
    d = ((a[:, None] - a[None]) ** 2).sum(axis=2)
    d[np.abs(at[:, None] - at[None, :]) <= mt.profile_zone(M)] = np.inf
    monkeypatch.setattr(mt, "BOX", 8)
    got = mt._nearest_boxed(a, at, a, at, mt.profile_zone(M))
    assert np.array_equal(got, at[(d <= d.min(axis=1, keepdims=True) + 1e-10).argmax(axis=1)])
    for name, value in (("GROUP_ROWS", group_rows), ("PLAIN", 0)):
        monkeypatch.setattr(mt, name, value)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "pos long, x double")
    rows = mt.matrix_profile(df, [], "pos", "x", M, tile_rows=32).toPandas().sort_values("pos")
    assert np.array_equal(rows.pos, at) and np.allclose(rows.distance, np.sqrt(d.min(axis=1)), atol=1e-6)
    assert np.allclose(d[np.arange(len(at)), np.searchsorted(at, rows.partner)], d.min(axis=1), atol=1e-10)


def test_boxes_leave_out_most_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    x = np.tile(rng.normal(size=1500), 4)[: 4096 + M - 1] + rng.normal(size=4096 + M - 1) * 1e-3
    z = mt._Windows(x, M, x.mean())
    at, pairs = np.arange(4096), 0
    a = z.standard(at)

    class Counted(np.ndarray):
        def __matmul__(self, other):
            nonlocal pairs
            pairs += self.shape[0] * other.shape[-1] * (self.shape[1] == other.shape[0] == M != other.shape[-1])
            return np.asarray(self) @ np.asarray(other)

    got = mt._nearest_boxed(a.view(Counted), at, a.view(Counted), at, mt.profile_zone(M))
    right, left = mt._nearest(z, z, mt.profile_zone(M) + 1, 4096)
    one, two = (np.where(p >= 0, mt._distances(z, at, z, np.maximum(p, 0)), np.inf) for p in (right, left))
    assert np.allclose(mt._distances(z, at, z, got), np.minimum(one, two))
    assert 0 < pairs < 4096 * 4096 / 3


def test_slices_are_settled_together():
    """Slices of several series in one table are decided as each of them alone."""
    rng = np.random.default_rng(9)
    parts = []
    for key, at in ((None, 0), ("a", 0), ("a", 1), ("b", 5)):
        pos = np.unique(rng.integers(at * 50 - 6, at * 50 + 56, 30))
        parts.append(pa.table({
            "k": pa.array([key] * len(pos), pa.string()), "_slice": np.full(len(pos), at), "pos": pos, "distance": rng.integers(0, 6, len(pos)) / 2,
            "state": np.zeros(len(pos), np.int32), "_core": (pos >= at * 50) & (pos < at * 50 + 50)}))
    whole = pa.concat_tables(parts).combine_chunks()
    starts = mt._starts(whole, ["k", "_slice"])
    assert starts.tolist() == np.cumsum([0, *(len(p) for p in parts[:-1])]).tolist()
    kept, done = mt._settled_groups(whole, starts, 6, 50, 0)
    want = []
    for p in parts:
        low = p["_slice"][0].as_py() * 50
        want.append(mt._settle(p["pos"].to_numpy(), p["distance"].to_numpy(), p["state"].to_numpy(), low - 6, low + 49 + 6, 6))
    assert np.array_equal(done, np.concatenate(want))
    assert np.array_equal(kept, whole["_core"].to_numpy() & (done != mt.GONE))


def test_windows_near_seeds_of_many_radii(spark):
    """Radii with one seed and radii with seeds of their own, in slices with and without gaps."""
    rng = np.random.default_rng(10)
    rows = [(k, i, float(v)) for k in ("a", "b") for i, v in enumerate(rng.normal(size=60)) if k == "a" or i % 13]
    df = spark.createDataFrame(rows, "k string, pos long, x double")
    slices = mt.series_slices(df, ["k"], "pos", "x", M, 40)
    seeds = [("a", 1.0, 3, 0.9), ("a", 2.0, 3, 0.9), ("a", 3.0, 44, 0.9), ("b", 1.0, 14, 0.9), ("b", 2.0, 2, 0.9), ("b", 3.0, 14, 1.1)]
    got = mt.windows_near(slices, ["k"], spark.createDataFrame(seeds, "k string, radius double, pos long, distance double"), M, 40).collect()
    want = set()
    for k, radius, pos, distance in seeds:
        x = {i: v for key, i, v in rows if key == k}
        for i in x:
            if all(i + j in x for j in range(M)):
                gap = np.sqrt(((z(np.array([x[i + j] for j in range(M)])) - z(np.array([x[pos + j] for j in range(M)]))) ** 2).sum())
                if gap <= radius * distance:
                    want.add((k, radius, i, round(gap, 6)))
    assert len(want) > len(seeds) and {(r["k"], r["radius"], r["pos"], round(r["distance"], 6)) for r in got} == want and len(got) == len(want)


def test_distances_from_a_seed():
    x = np.arange(20.0) % 7
    whole, found = mt._seed_distances(x, x[3 : 3 + M], M)
    assert found[whole == 3] == 0 and len(whole) == 20 - M + 1
    assert not len(mt._seed_distances(x, np.ones(M), M)[0])
