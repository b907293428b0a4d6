import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.functions import features as ft
from strideline.functions import relevance as rl
from strideline.functions.block_kernels import ARRAY_CALCULATORS


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(3)
    data = {b: rng.normal(5, 2, n).round(2) for b, n in enumerate((30, 30, 17))}
    rows = [(b, i, float(v)) for b, x in data.items() for i, v in enumerate(x)]
    return data, spark.createDataFrame(rows, "b int, i int, x double").cache()


def extract(df, catalogue):
    return {r["b"]: r for r in ft.extract_features(df, ["b"], "i", "x", catalogue).collect()}


def test_fourier_matches_numpy(blocks):
    data, df = blocks
    got = extract(df, {"fft_coefficient": [{"attr": a, "coeff": k} for a in ("real", "imag") for k in (0, 3, 8, 15)]})
    for b, x in data.items():
        want = np.fft.rfft(x)
        for k in (0, 3, 8, 15):
            real, imag = got[b][f'x__fft_coefficient__attr_"real"__coeff_{k}'], got[b][f'x__fft_coefficient__attr_"imag"__coeff_{k}']
            if k < len(want):
                assert np.isclose(real, want[k].real) and np.isclose(imag, want[k].imag, atol=1e-9)
            else:
                assert real is None and imag is None


def levinson(x, lags):
    n, c = len(x), x - x.mean()
    r = [(c[: n - j] * c[j:]).mean() / x.var() for j in range(lags + 1)]
    return [np.linalg.solve([[r[abs(i - j)] for j in range(k)] for i in range(k)], r[1 : k + 1])[-1] for k in range(1, lags + 1)]


def test_partial_autocorrelation_matches_the_linear_system(blocks):
    data, df = blocks
    got = extract(df, {"partial_autocorrelation": [{"lag": j} for j in range(10)]})
    for b, x in data.items():
        assert got[b]["x__partial_autocorrelation__lag_0"] == 1.0
        for j, want in enumerate(levinson(x, min(9, len(x) // 2 - 1)), start=1):
            assert np.isclose(got[b][f"x__partial_autocorrelation__lag_{j}"], want)


def test_array_kernels_match_plain_loops(blocks):
    data, df = blocks
    got = extract(df, {"sample_entropy": [{}], "approximate_entropy": [{"m": 2, "r": 0.5}], "ar_coefficient": [{"coeff": 1, "k": 2}],
                       "matrix_profile": [{"feature": "min", "m": 4}], "query_similarity_count": [{"query": (1.0, 2.0, 1.0), "threshold": 1.0}]})
    for b, x in data.items():
        def near(m, tol):
            w = [x[i : i + m] for i in range(len(x) - m + 1)]
            return [sum(np.abs(u - v).max() <= tol for v in w) for u in w]

        s2, s3 = sum(near(2, 0.2 * x.std())) - (len(x) - 1), sum(near(3, 0.2 * x.std())) - (len(x) - 2)
        want = -np.log(s3 / s2) if s2 and s3 else None
        assert got[b]["x__sample_entropy"] == (pytest.approx(want) if want is not None else None)
        phi = [np.mean(np.log(np.array(near(m, 0.5 * x.std())) / (len(x) - m + 1))) for m in (2, 3)]
        assert np.isclose(got[b]["x__approximate_entropy__m_2__r_0.5"], abs(phi[0] - phi[1]))
        design = np.column_stack([np.ones(len(x) - 2), x[1:-1], x[:-2]])
        assert np.isclose(got[b]["x__ar_coefficient__coeff_1__k_2"], np.linalg.lstsq(design, x[2:], rcond=None)[0][1])

        def z(v):
            return (v - v.mean()) / v.std()

        w = [z(x[i : i + 4]) for i in range(len(x) - 3)]
        best = min(np.linalg.norm(w[i] - w[j]) for i in range(len(w)) for j in range(len(w)) if abs(i - j) > 2)
        assert np.isclose(got[b]['x__matrix_profile__feature_"min"__m_4'], best)
        hits = sum(np.linalg.norm(z(x[i : i + 3]) - z(np.array([1.0, 2.0, 1.0]))) <= 1.0 for i in range(len(x) - 2))
        assert hits in {v for k, v in got[b].asDict().items() if "query_similarity" in k}


def test_default_names_parse_back():
    catalogue = ft.default_catalogue(True)
    assert all(n in ft.CALCULATORS or n in ARRAY_CALCULATORS for n in catalogue)
    names = [ft.feature_name("x", c, p) for c, grid in catalogue.items() for p in grid]
    assert len(names) == len(set(names)) > 700
    parsed = ft.parse_feature_names(names)["x"]
    assert {c: sorted(map(str, g)) for c, g in parsed.items()} == {
        c: sorted(str(dict(sorted(p.items()))) for p in g) for c, g in catalogue.items()}


def test_missing_values_are_left_out(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, float("nan")), (0, 3, 4.0)], "b int, i int, x double")
    got = extract(df, {"length": [{}], "mean_abs_change": [{}]})[0]
    assert (got["x__length"], got["x__mean_abs_change"]) == (2.0, 3.0)


def test_one_row_block(spark):
    df = spark.createDataFrame([(0, 0, 2.5)], "b int, i int, x double")
    catalogue = {k: v for k, v in ft.default_catalogue().items() if k not in ("fft_coefficient", "cwt_coefficients", "change_quantiles", "agg_linear_trend")}
    assert extract(df, catalogue)[0]["x__mean"] == 2.5


def test_feature_plan_shuffles_once(blocks):
    _data, df = blocks
    plan = ft.extract_features(df, ["b"], "i", "x", {"mean": [{}], "autocorrelation": [{"lag": 2}], "has_duplicate": [{}], "number_peaks": [{"n": 3}]})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_value_ranks(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=500).round(1), [1e9, -1e7], np.zeros(300)])
    counts = spark.createDataFrame([("f", float(v)) for v in x], "feature string, value double").groupBy("feature", "value").agg(F.count("*").alias("rows"))
    for r in rl.value_ranks(counts, ["feature"], "value", "rows").collect():
        assert r["below"] == (x < r["value"]).sum()


def test_fisher_and_constant_features(spark):
    rows = [("b", float(i % 2), int(i % 2 == 0 or i > 30)) for i in range(40)] + [("c", 1.0, i % 2) for i in range(40)]
    table = {r["feature"]: r for r in rl.relevance_table(spark.createDataFrame(rows, "feature string, value double, y int"), "y", 0.05).collect()}
    from math import comb

    k = sum(1 for f, v, y in rows if f == "b" and v == 1 and y == 1)
    c = sum(y for f, _v, y in rows if f == "b")
    probs = {x: comb(20, x) * comb(20, c - x) / comb(40, c) for x in range(max(0, c - 20), min(20, c) + 1)}
    want = sum(p for p in probs.values() if p <= probs[k] * (1 + 1e-7))
    assert np.isclose(table["b"]["p_value"], want) and table["b"]["relevant"]
    assert table["c"]["kind"] == "constant" and table["c"]["p_value"] is None and not table["c"]["relevant"]


def test_impute(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("a", inf), ("a", -inf), ("b", None)], "feature string, value double")
    got = sorted((r["feature"], r["value"]) for r in rl.impute(df).collect())
    assert got == [("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 3.0), ("b", 0.0)]


def test_blocks_of_any_length(spark):
    """Short, usual and long blocks in one call; nothing is cut at a size given beforehand."""
    rng = np.random.default_rng(8)
    data = {b: rng.normal(0, 1, n) for b, n in enumerate((20, 120, 600))}
    df = spark.createDataFrame([(b, i, float(v)) for b, x in data.items() for i, v in enumerate(x)], "b int, i int, x double")
    got = extract(df, {
        "fft_coefficient": [{"attr": "real", "coeff": 50}], "fft_aggregated": [{"aggtype": "centroid"}],
        "spkt_welch_density": [{"coeff": 8}], "fourier_entropy": [{"bins": 10}], "agg_autocorrelation": [{"f_agg": "mean", "maxlag": 150}],
        "partial_autocorrelation": [{"lag": 12}], "change_quantiles": [{"f_agg": "mean", "isabs": True, "qh": 0.7, "ql": 0.1}]})
    for b, x in data.items():
        n, c = len(x), x - x.mean()
        f, r = np.fft.rfft(x), got[b]
        amplitude = np.abs(f)
        size = min(n, 256)
        taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        starts = range(0, n - size + 1, size - size // 2)
        density = np.mean([np.abs(np.fft.rfft((x[s : s + size] - x[s : s + size].mean()) * taper)) ** 2 for s in starts], axis=0) / (taper**2).sum()
        density[1:-1] *= 2
        share = np.histogram(density, bins=10, range=(density.min(), density.max()))[0] / len(density)
        acf = [(c[: n - j] * c[j:]).mean() / x.var() for j in range(1, min(150, n - 1) + 1)]
        low, high = np.quantile(x, 0.1), np.quantile(x, 0.7)
        inside = (x >= low) & (x <= high)
        assert (r['x__fft_coefficient__attr_"real"__coeff_50'] is None) == (n < 100)
        if n >= 100:
            assert np.isclose(r['x__fft_coefficient__attr_"real"__coeff_50'], f[50].real)
        want = {
            'x__fft_aggregated__aggtype_"centroid"': (amplitude * np.arange(len(f))).sum() / amplitude.sum(),
            "x__spkt_welch_density__coeff_8": density[8], "x__fourier_entropy__bins_10": -(share[share > 0] * np.log(share[share > 0])).sum(),
            'x__agg_autocorrelation__f_agg_"mean"__maxlag_150': np.mean(acf),
            'x__change_quantiles__f_agg_"mean"__isabs_True__qh_0.7__ql_0.1': np.abs(np.diff(x))[inside[1:] & inside[:-1]].mean(),
        }
        for name, value in want.items():
            assert np.isclose(r[name], value), (n, name)
        if n // 2 > 12:
            assert np.isclose(r["x__partial_autocorrelation__lag_12"], levinson(x, 12)[-1])


def test_wide_plans_deal_blocks_by_rows(spark, monkeypatch):
    rows = [(b, i, float((i * 7 + b) % 5)) for b in range(40) for i in range(10 + b % 3)]
    df = spark.createDataFrame(rows, "b long, i long, x double")
    wanted = {"mean": [{}], "autocorrelation": [{"lag": 2}], "has_duplicate": [{}], "number_peaks": [{"n": 3}], "sample_entropy": [{}]}
    want = sorted(ft.extract_features(df, ["b"], "i", "x", wanted).collect())
    monkeypatch.setattr(ft, "WIDE", 0)
    wide = ft.extract_features(df, ["b"], "i", "x", wanted)
    assert sorted(wide.collect()) == want
    assert wide._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 1
    known = df.withColumnRenamed("x", "_x")
    # 440 rows of 600 columns: tasks follow the rows, not the bytes that are shuffled.
    tasks = [ft.dealt(known.where(f"b < {n}"), ["b"], 600, cells=6000).rdd.getNumPartitions() for n in (20, 40)]
    assert tasks == [22, 44]
