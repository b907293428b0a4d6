"""Queries over axis reduction, normalisation, outliers and smoothing."""

from math import exp

from pyspark.sql import functions as F

from strideline.operators import signal as sg
from workload.base import AXES_SQL, AXIS_KEYS, SERIES_SQL, axes, events_series, query, r6, table

KEY_SQL = ", ".join(AXIS_KEYS)
HOLE_AXES_SQL = AXES_SQL + f""",
g AS (SELECT {KEY_SQL}, CASE WHEN l_orderkey % 7 <> 0 THEN ax END AS ax, ay, az FROM a)"""


def hole_axes(spark, sf):
    a = axes(spark, sf)
    return a.select(*AXIS_KEYS, F.when(F.col("l_orderkey") % 7 != 0, F.col("ax")).otherwise(float("nan")).alias("ax"), "ay", "az")


def series(spark, sf):
    return events_series(spark, sf).select("series_id", "pos", "value", "k")


@query("c1_l2_norm", f"WITH {HOLE_AXES_SQL} SELECT {KEY_SQL}, round(sqrt(coalesce(ax * ax, 0) + ay * ay + az * az), 6) AS acceleration_abs FROM g")
def _(spark, sf):
    out = sg.reduce_axes(hole_axes(spark, sf), "euclidean", ["ax", "ay", "az"])
    return out.select(*AXIS_KEYS, r6("acceleration_abs"))


@query("c2_l1_norm", f"""WITH {HOLE_AXES_SQL} SELECT {KEY_SQL}, round(coalesce(abs(ax), 0) + abs(ay) + abs(az), 6) AS acceleration_abs,
round(abs(coalesce(ax, 0) + ay + az), 6) AS signed_abs FROM g""")
def _(spark, sf):
    out = sg.reduce_axes(hole_axes(spark, sf), "manhatten", ["ax", "ay", "az"])
    out = sg.l1_norm(out, ["ax", "ay", "az"], "signed_abs", signed=True)
    return out.select(*AXIS_KEYS, r6("acceleration_abs"), r6("signed_abs"))


def pca2_sql(group: str) -> str:
    by = f"GROUP BY {group}" if group else ""
    sel = f"{group}," if group else ""
    return f"""
c AS (SELECT {sel} covar_samp(value, value) AS a, covar_samp(value, k) AS b, covar_samp(k, k) AS d FROM s {by}),
e AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS top FROM c),
v AS (SELECT {sel} CASE WHEN b = 0 THEN CASE WHEN a >= d THEN 1.0 ELSE 0.0 END ELSE b END AS x,
             CASE WHEN b = 0 THEN CASE WHEN a >= d THEN 0.0 ELSE 1.0 END ELSE top - a END AS y FROM e),
l AS (SELECT {sel} x / sqrt(x * x + y * y) * CASE WHEN CASE WHEN abs(x) >= abs(y) THEN x ELSE y END < 0 THEN -1 ELSE 1 END AS w0,
             y / sqrt(x * x + y * y) * CASE WHEN CASE WHEN abs(x) >= abs(y) THEN x ELSE y END < 0 THEN -1 ELSE 1 END AS w1 FROM v)"""


@query("c3_pca_reduce", f"WITH {SERIES_SQL}, {pca2_sql('')} SELECT series_id, pos, round(value * w0 + k * w1, 6) AS acceleration_abs FROM s, l")
def _(spark, sf):
    return sg.reduce_axes(series(spark, sf), "pca", ["value", "k"]).select("series_id", "pos", r6("acceleration_abs"))


@query("c3_pca_reduce_per_series", f"""WITH {SERIES_SQL}, {pca2_sql('series_id')}
SELECT series_id, pos, round(value * w0 + k * w1, 6) AS acceleration_abs FROM s JOIN l USING (series_id)""")
def _(spark, sf):
    out = sg.reduce_axes(series(spark, sf), "pca", ["value", "k"], keys=["series_id"])
    return out.select("series_id", "pos", r6("acceleration_abs"))


# Three axes have no short SQL form: power iteration in SQL reaches the same direction.
@query("c3_pca_direction_three_axes", f"""WITH RECURSIVE {AXES_SQL},
c AS (SELECT series_id, covar_samp(ax, ax) AS c00, covar_samp(ax, ay) AS c01, covar_samp(ax, az) AS c02,
             covar_samp(ay, ay) AS c11, covar_samp(ay, az) AS c12, covar_samp(az, az) AS c22 FROM a GROUP BY series_id),
p AS (
  SELECT c.*, 0 AS step, 1.0::DOUBLE AS x, 1.0::DOUBLE AS y, 1.0::DOUBLE AS z FROM c
  UNION ALL
  SELECT q.series_id, c00, c01, c02, c11, c12, c22, step + 1, nx / s, ny / s, nz / s
  FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS s FROM (
        SELECT *, c00 * x + c01 * y + c02 * z AS nx, c01 * x + c11 * y + c12 * z AS ny, c02 * x + c12 * y + c22 * z AS nz
        FROM p WHERE step < 400)) q
)
SELECT series_id, round(x * sg, 6) AS w0, round(y * sg, 6) AS w1, round(z * sg, 6) AS w2 FROM (
  SELECT *, CASE WHEN CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN x WHEN abs(y) >= abs(z) THEN y ELSE z END < 0
                 THEN -1 ELSE 1 END AS sg FROM p WHERE step = 400)""")
def _(spark, sf):
    d = sg.principal_direction(axes(spark, sf), ["ax", "ay", "az"], ["series_id"])
    return d.select("series_id", r6("_w0", "w0"), r6("_w1", "w1"), r6("_w2", "w2"))


_FIVE = ["ax", "ay", "az", "w", "l_linenumber"]


def _power_sql(n: int, steps: int) -> str:
    """Power iteration over the covariances of n axes, whose limit is the direction with the largest eigenvalue."""
    name = lambda i, j: f"c{min(i, j)}{max(i, j)}"
    cov = ", ".join(f"covar_samp({_FIVE[i]}, {_FIVE[j]}) AS {name(i, j)}" for i in range(n) for j in range(i, n))
    kept = ", ".join(name(i, j) for i in range(n) for j in range(i, n))
    product = ", ".join(" + ".join(f"{name(i, j)} * x{j}" for j in range(n)) + f" AS n{i}" for i in range(n))
    length = " + ".join(f"n{i} * n{i}" for i in range(n))
    top = "greatest(" + ", ".join(f"abs(x{i})" for i in range(n)) + ")"
    sign = "CASE " + " ".join(f"WHEN abs(x{i}) = {top} THEN sign(x{i})" for i in range(n)) + " END"
    return f"""c AS (SELECT series_id, {cov} FROM a GROUP BY series_id),
p AS (SELECT c.*, 0 AS step, {', '.join(f'1.0::DOUBLE AS x{i}' for i in range(n))} FROM c
  UNION ALL SELECT series_id, {kept}, step + 1, {', '.join(f'n{i} / sqrt({length})' for i in range(n))}
  FROM (SELECT *, {product} FROM p WHERE step < {steps}))
SELECT series_id, {', '.join(f'round(x{i} * {sign}, 6) AS w{i}' for i in range(n))} FROM p WHERE step = {steps}"""


@query("c3_pca_direction_five_axes", f"WITH RECURSIVE {AXES_SQL}, {_power_sql(5, 300)}")
def _(spark, sf):
    d = sg.principal_direction(axes(spark, sf), _FIVE, ["series_id"])
    return d.select("series_id", *[r6(f"_w{i}", f"w{i}") for i in range(5)])


@query("c4_znormalize", f"""WITH {SERIES_SQL}, m AS (SELECT avg(value) AS mv, stddev_samp(value) AS sv, avg(k) AS mk, stddev_samp(k) AS sk FROM s)
SELECT series_id, pos, round((value - mv) / sv, 6) AS value, round((k - mk) / sk, 6) AS k FROM s, m""")
def _(spark, sf):
    out, _stats = sg.znormalize(series(spark, sf), ["value", "k"])
    return out.select("series_id", "pos", r6("value"), r6("k"))


@query("c4_znormalize_per_series", f"""WITH {SERIES_SQL} SELECT series_id, pos,
round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS value FROM s WINDOW w AS (PARTITION BY series_id)""")
def _(spark, sf):
    out, _stats = sg.znormalize(series(spark, sf), ["value"], ["series_id"])
    return out.select("series_id", "pos", r6("value"))


@query("c5_znormalize_apply", f"""WITH {SERIES_SQL}, m AS (SELECT avg(value) AS mv, stddev_samp(value) AS sv FROM s WHERE series_id % 2 = 0)
SELECT series_id, pos, round((value - mv) / sv, 6) AS value FROM s, m WHERE series_id % 2 = 1""")
def _(spark, sf):
    s = series(spark, sf)
    stats = sg.normal_stats(s.where("series_id % 2 = 0"), ["value"])
    out, _stats = sg.znormalize(s.where("series_id % 2 = 1"), ["value"], stats=stats)
    return out.select("series_id", "pos", r6("value"))


@query("c6_min_max_scale", f"""WITH {SERIES_SQL}, m AS (SELECT min(value) AS lo, max(value) AS hi, min(k) AS lk, max(k) AS hk FROM s)
SELECT series_id, pos, round((value - lo) / (hi - lo), 6) AS value, round((k - lk) / (hk - lk), 6) AS k FROM s, m""")
def _(spark, sf):
    return sg.min_max_scale(series(spark, sf), ["value", "k"]).select("series_id", "pos", r6("value"), r6("k"))


@query("c7_trim_quantile", f"""WITH {SERIES_SQL},
q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM s),
f AS (SELECT s.* FROM s, q WHERE value BETWEEN lo AND hi),
q2 AS (SELECT quantile_cont(k, 0.01) AS lo, quantile_cont(k, 0.99) AS hi FROM f)
SELECT series_id, pos, value, k FROM f, q2 WHERE k BETWEEN lo AND hi""")
def _(spark, sf):
    return sg.remove_outliers(series(spark, sf), "quantile", ["value", "k"], quantile=0.99)


@query("c7_trim_quantile_per_series", f"""WITH {SERIES_SQL},
q AS (SELECT series_id, quantile_cont(value, 0.0625) AS lo, quantile_cont(value, 0.9375) AS hi FROM s GROUP BY series_id)
SELECT series_id, pos, value, k FROM s JOIN q USING (series_id) WHERE value BETWEEN lo AND hi""")
def _(spark, sf):
    return sg.remove_outliers(series(spark, sf), "quantile", ["value"], quantile=0.9375, keys=["series_id"])


@query("c7_exact_quantiles", """SELECT round(quantile_cont(l_extendedprice, 0.01), 6) AS q0, round(quantile_cont(l_extendedprice, 0.5), 6) AS q1,
round(quantile_cont(l_extendedprice, 0.99), 6) AS q2 FROM lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    # Ranges of few rows on purpose: several passes are taken even at this size.
    q = sg.exact_quantiles(li, "l_extendedprice", [0.01, 0.5, 0.99], ranked_rows=50)
    return q.select(r6("q0"), r6("q1"), r6("q2"))


@query("c8_trim_threshold", f"WITH {SERIES_SQL} SELECT series_id, pos, value, k FROM s WHERE abs(value) <= 20 AND abs(k) <= 80")
def _(spark, sf):
    return sg.trim_threshold(sg.remove_outliers(series(spark, sf), "threshold", ["value"], threshold=20.0), ["k"], 80.0)


@query("c9_drop_tail", f"""WITH {SERIES_SQL} SELECT series_id, pos, value FROM
(SELECT *, max(pos) OVER (PARTITION BY series_id) AS last FROM s) WHERE pos <= last - 2""")
def _(spark, sf):
    return sg.drop_tail(series(spark, sf).select("series_id", "pos", "value"), ["series_id"], "pos", 2)


_W = [exp(-0.5 * ((j - 2) / 3.0) ** 2) for j in range(5)]


@query("c10_gaussian_rolling_sum", f"""WITH {SERIES_SQL} SELECT series_id, pos, round(
{' + '.join(f'coalesce(lag(value, {j}) OVER w * {_W[j]!r}, 0)' for j in range(5))}, 6) AS smooth
FROM s WINDOW w AS (PARTITION BY series_id ORDER BY pos)""")
def _(spark, sf):
    out = sg.gaussian_rolling_sum(series(spark, sf), ["series_id"], "pos", "value", "smooth")
    return out.select("series_id", "pos", r6("smooth"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def pair_sql(fn: str, digits: int) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round({fn}({a}, {b}), {digits}) AS value FROM lineitem"
        for a in _COLS for b in _COLS
    )


@query("c11_correlation_matrix", pair_sql("corr", 6))
def _(spark, sf):
    return sg.correlation_matrix(table(spark, sf, "lineitem"), _COLS).select("column_a", "column_b", r6("value"))


@query("c12_covariance_matrix", pair_sql("covar_samp", 3))
def _(spark, sf):
    out = sg.covariance_matrix(table(spark, sf, "lineitem"), _COLS)
    return out.select("column_a", "column_b", F.round("value", 3).alias("value"))


@query("c13_histogram", f"""WITH {SERIES_SQL}, m AS (SELECT min(value) AS lo, max(value) AS hi FROM s)
SELECT CAST(least(floor((value - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bin, count(*) AS rows FROM s, m GROUP BY 1""")
def _(spark, sf):
    return sg.histogram(series(spark, sf), "value", 10)


@query("c14_sax_words", f"""WITH {SERIES_SQL},
z AS (SELECT series_id, pos, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM s WINDOW w AS (PARTITION BY series_id)),
p AS (SELECT series_id, pos // 5 AS f, avg(z) AS paa FROM z GROUP BY 1, 2),
l AS (SELECT series_id, f, CASE WHEN paa < -0.67 THEN 'a' WHEN paa < 0 THEN 'b' WHEN paa < 0.67 THEN 'c' ELSE 'd' END AS c FROM p)
SELECT series_id, f // 4 AS word_no, string_agg(c, '' ORDER BY f) AS word FROM l GROUP BY 1, 2""")
def _(spark, sf):
    return sg.rerepresent(series(spark, sf), "SAX", keys=["series_id"], pos="pos", column="value", frame=5, word=4)


_ALPHABETS = range(2, 21)


def _letter_sql(n: int) -> str:
    cuts = " ".join(f"WHEN paa < {c!r} THEN '{sg.LETTERS[i]}'" for i, c in enumerate(sg.sax_breakpoints(n, None)))
    return f"SELECT {n} AS alphabet, series_id, f, CASE {cuts} ELSE '{sg.LETTERS[n - 1]}' END AS c FROM p"


@query("c14_sax_alphabets", f"""WITH {SERIES_SQL},
z AS (SELECT series_id, pos, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM s WINDOW w AS (PARTITION BY series_id)),
p AS (SELECT series_id, pos // 5 AS f, avg(z) AS paa FROM z GROUP BY 1, 2),
l AS ({' UNION ALL '.join(map(_letter_sql, _ALPHABETS))})
SELECT alphabet, series_id, f // 4 AS word_no, string_agg(c, '' ORDER BY f) AS word FROM l GROUP BY 1, 2, 3""")
def _(spark, sf):
    """Words of all alphabets from 2 to 20 letters, break points of full precision."""
    s = series(spark, sf)
    out = sg.sax_words(s, ["series_id"], "pos", "value", 5, 4, _ALPHABETS, digits=None)
    return out.select("alphabet", "series_id", "word_no", "word")
