"""Hand-computed small cases."""

import math

import pytest
from pyspark.sql import functions as F

from strideline.operators import cleaning as cl
from strideline.operators import combine as cb
from strideline.operators import segments as sm
from strideline.operators import signal as sg

NAN = float("nan")


def column(df, name, by):
    return [r[name] for r in df.orderBy(by).collect()]


def test_resample_gap(spark):
    df = spark.createDataFrame([(1, 200_000, 1.0), (1, 3_100_000, 2.0)], "s int, t bigint, x double")
    assert column(sm.resample(df, ["s"], "t", "1s", ["x"]), "x", "bin_us") == [1.0, None, None, 2.0]
    assert column(sm.resample(df, ["s"], "t", "1s", ["x"], "sum"), "x", "bin_us") == [1.0, 0.0, 0.0, 2.0]
    with pytest.raises(NotImplementedError):
        sm.resample(df, ["s"], "t", "1s", ["x"], "max")
    with pytest.raises(ValueError):
        sm.freq_micros("7s")


def test_resample_gap_longer_than_a_block_of_bins(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 200_000_000_000, 2.0)], "s int, t bigint, x double")
    bins = sm.resample(df, ["s"], "t", "1s", ["x"])
    assert bins.count() == 200_001 and bins.where("x is not null").count() == 2


@pytest.mark.parametrize("n,sizes", [(60, [20] * 3), (61, [21, 20, 20]), (89, [30, 30, 29]), (90, [23, 23, 22, 22])])
def test_chunk_sizes(spark, n, sizes):
    df = spark.range(n).select(F.lit(1).alias("s"), F.col("id").alias("i"))
    out = sm.chunk_evenly(df, ["s"], "i", 30)
    counts = [r["count"] for r in out.groupBy("chunk").count().orderBy("chunk").collect()]
    assert counts == sizes
    assert out.where("chunk_size = 30").count() == 30 * sizes.count(30)


def test_norms_with_missing_axes(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, None, NAN), (2, -3.0, 4.0)], "i int, a double, b double")
    assert column(sg.l2_norm(df, ["a", "b"]), sg.REDUCED, "i") == [1.0, 0.0, 5.0]
    assert column(sg.l1_norm(df, ["a", "b"]), sg.REDUCED, "i") == [1.0, 0.0, 7.0]
    assert column(sg.l1_norm(df, ["a", "b"], signed=True), sg.REDUCED, "i") == [1.0, 0.0, 1.0]


def test_encode_and_drop_labels(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, None), (3, NAN)], "i int, y double")
    assert column(cl.encode(df, ["y"]), "y", "i") == [0, 1, 0, 0]
    labels = spark.createDataFrame([(0, 2.0), (1, 5.0), (2, None)], "i int, y double")
    assert column(cl.drop_labels(labels, {"y": [2.0]}), "i", "i") == [1, 2]


def test_remove_missing_modes(spark):
    df = spark.createDataFrame([(0, 1.0), (1, NAN), (2, None), (3, 3.0)], "i int, x double")
    assert column(cl.remove_missing(df, "del_row"), "i", "i") == [0, 3]
    assert column(cl.remove_missing(df, "mean"), "x", "i") == [1.0, 2.0, 2.0, 3.0]
    assert column(cl.remove_missing(df, "replacement_val", value=7.0), "x", "i") == [1.0, 7.0, 7.0, 3.0]
    with pytest.raises(ValueError):
        cl.remove_missing(df, "other")


def test_label_runs(spark):
    df = spark.createDataFrame([(0, p, float(v)) for p, v in enumerate([5, 5, 2, 5, 1])], "s int, p bigint, y double")
    assert column(sm.segment_by_label(df, ["s"], "p", "y", [5.0]), "run_start", "p") == [0, 0, 3]


def test_majority_tie_goes_to_the_first_seen(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 3.0, 3.0, 1.0])], "b int, i int, y double")
    assert sm.majority_label(df, ["b"], "y", "i").first()["label"] == 1.0


@pytest.mark.parametrize("ranked_rows", [1, 20, 1_000_000])
def test_quantile_trim(spark, ranked_rows):
    df = spark.range(1, 102).select(F.col("id").cast("double").alias("x"))
    q = sg.exact_quantiles(df, "x", [0.01, 0.99, 0.5], ranked_rows=ranked_rows).first()
    assert (q["q0"], q["q1"], q["q2"]) == (2.0, 100.0, 51.0)
    kept = sg.trim_quantile(df, ["x"], 0.99).agg(F.min("x"), F.max("x"), F.count("x")).first()
    # 1 - 0.99 is a hair above 0.01 in binary, so the lower quantile is a hair above 2 (pandas agrees).
    assert tuple(kept) == (3.0, 100.0, 98)


def test_quantiles_of_one_repeated_value(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 1.0).otherwise(F.col("id").cast("double")).alias("x"))
    q = sg.exact_quantiles(df, "x", [0.5, 0.9], ranked_rows=200).first()
    import numpy as np

    data = np.where(np.arange(5000) < 4000, 1.0, np.arange(5000))
    assert (q["q0"], q["q1"]) == tuple(np.quantile(data, [0.5, 0.9]))


def test_quantiles_by_counts_alone(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1e-300, -3.0]
    groups = {0: rng.normal(size=500).tolist(), 1: odd * 9, 2: [7.0], 3: np.exp(rng.normal(0, 90, 400)).tolist(), 4: (1 + rng.integers(0, 50, 300) * 2.0**-52).tolist()}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [(5, None), (0, float("nan"))], "k int, x double")
    chances = [0.0, 0.01, 0.5, 0.77, 1.0]
    got = {r["k"]: tuple(r)[1:] for r in sg.exact_quantiles(df, "x", chances, ["k"], ranked_rows=3).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    for k, vs in groups.items():
        v, at = np.sort(vs), np.array(chances) * (len(vs) - 1)
        low, high = v[np.floor(at).astype(int)], v[np.ceil(at).astype(int)]
        assert got[k] == tuple(low + (high - low) * (at - np.floor(at))), k


@pytest.mark.parametrize("n", [4, 5, 8])
def test_direction_of_any_number_of_axes(spark, n):
    import numpy as np

    rng = np.random.default_rng(n)
    x = rng.normal(size=(300, n)) @ rng.normal(size=(n, n))
    x[:, 1] *= 3
    names = [f"a{i}" for i in range(n)]
    df = spark.createDataFrame([(1, *map(float, r)) for r in x] + [(2, *([float(i)] * n)) for i in range(9)] + [(3, *([1.0] * n))] * 2, ["k", *names])
    got = {r["k"]: np.array(r[1:]) for r in sg.principal_direction(df, names, ["k"]).collect()}
    cov = np.cov(x.T)
    want = np.linalg.eigh(cov)[1][:, -1]
    want = want * np.sign(want[np.abs(want).argmax()])
    assert np.allclose(got[1], want, atol=1e-9) and np.allclose(cov @ got[1], np.linalg.eigvalsh(cov)[-1] * got[1])
    assert np.allclose(got[2], 1 / np.sqrt(n)) and np.isclose((got[3] ** 2).sum(), 1)


def test_sax_alphabets():
    import numpy as np

    assert sg.sax_breakpoints(3) == [-0.43, 0.43] and sg.sax_breakpoints(4) == [-0.67, 0.0, 0.67]
    assert len(sg.sax_breakpoints(20, None)) == 19 and np.allclose(sg.sax_breakpoints(20, None), -np.array(sg.sax_breakpoints(20, None))[::-1])
    with pytest.raises(ValueError):
        sg.sax_breakpoints(40)


def test_scaling(spark):
    df = spark.range(50).select((F.col("id") * 1.5).alias("x"), F.lit(4.0).alias("c"))
    z, stats = sg.znormalize(df, ["x", "c"])
    got = z.agg(F.avg("x"), F.stddev_samp("x"), F.count("c")).first()
    assert abs(got[0]) < 1e-10 and math.isclose(got[1], 1.0) and got[2] == 0
    assert stats.first()["mean_c"] == 4.0
    scaled = sg.min_max_scale(df, ["x"]).agg(F.min("x"), F.max("x")).first()
    assert tuple(scaled) == (0.0, 1.0)


def test_label_join_needs_equal_length(spark):
    left = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "series_id int, pos bigint, y double")
    right = spark.createDataFrame([(0, 0, 2.0)], "series_id int, pos bigint, x double")
    assert cb.label_readings(left, right, check=False).count() == 1
    with pytest.raises(Exception, match="differ in length"):
        cb.label_readings(left, right).collect()


def test_three_axis_direction_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) @ np.array([[2, 0.3, 0], [0, 1, 0.5], [0.1, 0, 0.7]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = np.array(sg.principal_direction(df, ["a", "b", "c"]).first())
    want = np.linalg.eigh(np.cov(x.T))[1][:, -1]
    want = want * np.sign(want[np.abs(want).argmax()])
    assert np.allclose(got, want, atol=1e-9)


def test_epoch_units(spark):
    df = spark.createDataFrame([(1_500_000_000_123,)], "t bigint")
    ms = cl.epoch_to_timestamp(df, "t", "ms").first()[0]
    assert (ms.year, ms.microsecond) == (2017, 123_000)
    ns = cl.epoch_to_timestamp(df.select((F.col("t") * 1_000_000).alias("t")), "t", "ns").first()[0]
    assert ns == ms
    with pytest.raises(ValueError):
        cl.epoch_to_timestamp(df, "t", "fortnight")


def test_sax_alphabets_share_their_frames(spark):
    rows = [(s, p, float((p * 7 + s) % 11)) for s in range(3) for p in range(43)] + [(3, p, None) for p in range(5)]
    df = spark.createDataFrame(rows, "series_id long, pos long, value double")
    words = lambda n: sg.sax_words(df, ["series_id"], "pos", "value", 5, 4, n, digits=None)
    every = words(range(2, 21))
    for n in range(2, 21):
        own = every.where(f"alphabet = {n}").select("series_id", "word_no", "word").collect()
        assert sorted(own) == sorted(words(n).collect()) and len(own) == 9
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan(every) and plan(every).count("Aggregate") == plan(words(4)).count("Aggregate")
