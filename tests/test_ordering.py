"""Slices much shorter than a series must not change any result."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideline import ordering as od
from strideline.operators import combine as cb
from strideline.operators import segments as sm
from strideline.operators import signal as sg
from strideline.operators.cleaning import remove_mean_gravity


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for series, n in ((0, 200), (1, 3), (5000, 41)):
        kept = [p for p in range(n) if rng.random() > 0.1]
        label = 5.0
        for p in kept:
            if rng.random() < 0.2:
                label = rng.choice([5.0, 2.0, 1.0])
            out.append((series, p, 1000 * p + rng.randrange(900), label, round(rng.uniform(0, 9), 1)))
    return pd.DataFrame(out, columns=["s", "p", "t", "label", "x"])


def local(df, by):
    return df.toPandas().sort_values(by).reset_index(drop=True)


@pytest.mark.parametrize("slice_rows", [4, 7, 1 << 20])
def test_dense_index(spark, rows, slice_rows):
    got = local(od.dense_index(spark.createDataFrame(rows), ["s"], "p", "i", slice_rows), ["s", "p"])
    assert list(got.i) == list(rows.sort_values(["s", "p"]).groupby("s").cumcount())


def test_dense_index_without_keys(spark, rows):
    one = rows[rows.s == 0]
    got = local(od.dense_index(spark.createDataFrame(one), [], "p", "i", 5), ["p"])
    assert list(got.i) == list(range(len(one)))


@pytest.mark.parametrize("slice_rows", [3, 1 << 20])
def test_positions_by_time_of_hot_series(spark, rows, slice_rows):
    got = local(od.positions_by_time(spark.createDataFrame(rows), ["s"], "t", ["p"], "i", slice_rows), ["s", "t"])
    assert list(got.i) == list(rows.sort_values(["s", "t"]).groupby("s").cumcount())


def brute_runs(frame):
    starts = []
    for _, g in frame.sort_values("p").groupby("s"):
        start = prev = prev_label = None
        for p, label in zip(g.p, g.label):
            if prev is None or p != prev + 1 or label != prev_label:
                start = p
            prev, prev_label = p, label
            starts.append(start)
    return starts


@pytest.mark.parametrize("slice_rows", [2, 5, 64, 1 << 20])
def test_run_starts(spark, rows, slice_rows):
    got = local(od.run_starts(spark.createDataFrame(rows), ["s"], "p", {"start": ["label"]}, slice_rows), ["s", "p"])
    assert list(got.start) == brute_runs(rows)


def test_long_run_over_many_slices(spark):
    one = spark.range(0, 100).select(F.lit(1).alias("s"), F.col("id").alias("p"), F.lit(5.0).alias("label"))
    assert od.run_starts(one, ["s"], "p", {"start": ["label"]}, 4).select("start").distinct().count() == 1


def test_head_and_tail(spark, rows):
    df = spark.createDataFrame(rows)
    assert len(local(cb.head_rows(df, ["s"], "p", 10, 4), ["s", "p"])) == 10 + 3 - (3 - len(rows[rows.s == 1])) + 10
    tail = local(cb.tail_rows(df, ["s"], "p", 10, 4), ["s", "p"])
    assert list(tail[tail.s == 0].p) == list(rows[rows.s == 0].p.tail(10))


def test_halo_operators_do_not_depend_on_slices(spark, rows):
    df = spark.createDataFrame(rows)
    a = local(sg.gaussian_rolling_sum(df, ["s"], "p", "x", "y", slice_rows=6), ["s", "p"])
    b = local(sg.gaussian_rolling_sum(df, ["s"], "p", "x", "y"), ["s", "p"])
    full = rows.groupby("s").p.diff().fillna(1).eq(1)
    assert full.any()
    dense = od.dense_index(df, ["s"], "p", "i", 4)
    a = local(sg.gaussian_rolling_sum(dense, ["s"], "i", "x", "y", slice_rows=6), ["s", "i"])
    b = local(sg.gaussian_rolling_sum(dense, ["s"], "i", "x", "y"), ["s", "i"])
    pd.testing.assert_frame_equal(a, b)
    a = local(remove_mean_gravity(dense, ["s"], "i", ["x"], 4, slice_rows=6), ["s", "i"])
    b = local(remove_mean_gravity(dense, ["s"], "i", ["x"], 4), ["s", "i"])
    pd.testing.assert_frame_equal(a, b)


def test_offsets_follow_the_order_of_the_levels(spark):
    sizes = spark.createDataFrame([(0, 1, 5), (0, 0, 2), (1, 0, 3), (1, 4, 4)], "a int, b int, n bigint")
    got = local(od.hierarchical_offsets(sizes, [["a"], ["b"]], "n", "o"), ["a", "b"])
    assert list(got.o) == [0, 2, 7, 10]


def test_nested_segments_keep_the_requested_order(spark):
    data = [(0, p, 5.0, r, float(p)) for p, r in enumerate([3.0, 3.0, 1.0, 1.0, 3.0])]
    df = spark.createDataFrame(data, "s int, p bigint, coarse double, road double, x double")
    out = sm.segment_nested(df, ["s"], "p", "coarse", [5.0], "road", [1.0, 3.0], slice_rows=2)
    laid = sm.desegment(out, ["s"], [["outer_start"], ["inner_rank"], ["inner_start"]], "p", ["x"], "new")
    assert list(local(laid, ["new"]).x) == [2.0, 3.0, 0.0, 1.0, 4.0]


@pytest.mark.parametrize("slice_rows", [4, 7, 1 << 20])
def test_rolling_sum_over_holes_does_not_show_slices(spark, rows, slice_rows):
    df = spark.createDataFrame(rows)
    got = local(sg.gaussian_rolling_sum(df, ["s"], "p", "x", "sum", window=5, slice_rows=slice_rows), ["s", "p"])
    want = local(sg.gaussian_rolling_sum(df.withColumn("p", F.col("p").cast("bigint")), ["s"], "p", "x", "sum", window=5), ["s", "p"])
    assert got["sum"].round(9).tolist() == want["sum"].round(9).tolist()


def test_desegment_of_many_short_runs_uses_small_windows(spark, monkeypatch):
    """One series of 4,000 one-row runs: no window of the plan gets more than a range of starts."""
    monkeypatch.setattr(sm, "LEVEL_RANGE", 64)
    seen = []
    whole = sm.hierarchical_offsets

    def spy(sizes, levels, size, out, within=()):
        seen.append((sizes, levels))
        return whole(sizes, levels, size, out, within=within)

    monkeypatch.setattr(sm, "hierarchical_offsets", spy)
    df = spark.range(4000).selectExpr("1 AS s", "id AS start", "id AS p", "id * 2.0 AS x")
    got = sm.desegment(df, ["s"], [["start"]], "p", ["x"]).orderBy("start").toPandas()
    assert got.pos.tolist() == list(range(4000))
    sizes, levels = seen[0]
    assert len(levels) == 2
    assert sizes.groupBy("s", *levels[0]).count().agg(F.max("count")).first()[0] <= 64
