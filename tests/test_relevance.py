"""Relevance tests at sizes that no listing of tables or ranks could hold."""

from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.functions import relevance as rl


def plain(k, r, c, n):
    weights = [comb(c, x) * comb(n - c, r - x) for x in range(max(0, r + c - n), min(r, c) + 1)]
    own = comb(c, k) * comb(n - c, r - k)
    return sum(w for w in weights if w * 10**7 <= own * (10**7 + 1)) / sum(weights)


def test_fisher_equals_all_tables():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        r, c = (int(v) for v in rng.integers(0, n + 1, 2))
        k = int(rng.integers(max(0, r + c - n), min(r, c) + 1))
        assert rl.fisher_two_sided(k, r, c, n) == pytest.approx(plain(k, r, c, n), rel=1e-9), (k, r, c, n)


def test_fisher_of_many_rows():
    # 10^8 rows: near the middle the normal approximation holds, far out nothing is left.
    n, r, c = 10**8, 3 * 10**7, 5 * 10**7
    sd = (r * c / n * (n - r) / n * (n - c) / (n - 1)) ** 0.5
    p = rl.fisher_two_sided(int(r * c / n + 1.959964 * sd), r, c, n)
    assert p == pytest.approx(0.05, abs=2e-4)
    assert rl.fisher_two_sided(int(r * c / n - 100 * sd), r, c, n) == 0.0
    assert rl.fisher_two_sided(r * c // n, r, c, n) == 1.0


def test_rank_sums_of_many_rows(spark):
    rng = np.random.default_rng(1)
    rows, made = [], {}
    for f in ("a", "b", "c"):
        values = np.arange(2000 if f != "c" else 3)
        count = rng.integers(1, 100_000, len(values)) if f != "a" else np.full(len(values), 50_000)
        ones = (count * rng.random(len(values))).astype(int)
        made[f] = (count.astype(object), ones.astype(object))
        rows += [(f, float(v), int(o), int(n), int(n - o)) for v, o, n in zip(values, ones, count)]
    counts = spark.createDataFrame(rows, "feature string, value double, n1 bigint, rows bigint, n0 bigint").repartition(7)
    got = {r["feature"]: r for r in rl.rank_sums(counts).collect()}
    for f, (count, ones) in made.items():
        twice = sum(o * (2 * b + n + 1) for o, n, b in zip(ones, count, np.cumsum(count) - count))
        assert got[f]["_r1"] == pytest.approx(twice / 2, rel=1e-14)
        assert (got[f]["_n1"], got[f]["_n0"], got[f]["_ties"]) == (sum(ones), sum(count) - sum(ones), pytest.approx(float(sum(n**3 - n for n in count)), rel=1e-12))
    assert sum(made["a"][0]) == 10**8
    assert rl.real_feature_pvalues(counts).where(F.col("p_value").isNull()).count() == 0
    assert rl.real_feature_pvalues(counts.where("false")).count() == 0
