"""Queries over the feature catalogue, one per calculator or small family.

The SQL side is written against ``r``: the block rows with every window column the
calculators need.
"""

from pyspark.sql import functions as F

from strideline.functions.features import extract_features, feature_name
from workload.base import BLOCK_KEYS, BLOCKS_SQL, event_blocks, query

LEADS = ",\n  ".join(f"lead(x, {j}) OVER o AS lead{j}" for j in range(1, 30))
ROWS_SQL = BLOCKS_SQL + f""",
r AS (SELECT *, avg(x) OVER w AS mu, stddev_pop(x) OVER w AS sd, var_pop(x) OVER w AS va, min(x) OVER w AS lo, max(x) OVER w AS hi,
  lag(x) OVER o AS lag1, {LEADS},
  sum(abs(x)) OVER (PARTITION BY series_id, block_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS mass, sum(abs(x)) OVER w AS mass_all,
  count(*) OVER (PARTITION BY series_id, block_id, x) AS times,
  row_number() OVER (PARTITION BY series_id, block_id, x ORDER BY i) AS nth,
  row_number() OVER (PARTITION BY series_id, block_id ORDER BY abs(x) DESC, i) AS place,
  min(t_us) OVER w AS t0
  FROM b WINDOW w AS (PARTITION BY series_id, block_id), o AS (PARTITION BY series_id, block_id ORDER BY i))"""


def ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def col(name: str):
    return F.col(f"`{name}`")


def features(name: str, wanted: list[tuple[str, dict, str | None]], ctes: str = "", source: str = "r",
             digits: int = 6, where: str = "") -> None:
    """Register one query for ``[(calculator, params, SQL aggregate), ...]``."""
    catalogue: dict[str, list[dict]] = {}
    parts = []
    for calc, params, sql in wanted:
        catalogue.setdefault(calc, []).append(params)
        if sql is not None:
            parts.append(f"round(CAST({sql} AS DOUBLE), {digits}) AS {ident(feature_name('x', calc, params))}")

    sql_text = None
    if len(parts) == len(wanted):
        listed = ",\n  ".join(parts)
        extra = f",\n{ctes}" if ctes else ""
        sql_text = f"WITH {ROWS_SQL}{extra}\nSELECT series_id, block_id,\n  {listed}\nFROM {source} {where} GROUP BY series_id, block_id"

    def run(spark, sf):
        blocks = event_blocks(spark, sf)
        wide = extract_features(blocks, BLOCK_KEYS, "i", "x", catalogue, time="t_us")
        return wide.select(*BLOCK_KEYS, *[F.round(col(c), digits).alias(c) for c in wide.columns if c not in BLOCK_KEYS])

    query(name, sql_text)(run)


N = "count(*)"

features("g1_sum_values", [("sum_values", {}, "sum(x)")])
features("g2_mean", [("mean", {}, "avg(x)")])
features("g3_median", [("median", {}, "median(x)")])
features("g4_minimum", [("minimum", {}, "min(x)")])
features("g5_maximum", [("maximum", {}, "max(x)"), ("absolute_maximum", {}, "max(abs(x))")])
features("g6_length", [("length", {}, N)])
features("g7_standard_deviation", [("standard_deviation", {}, "stddev_pop(x)")])
features("g8_variance", [("variance", {}, "var_pop(x)")])
features("g9_energy", [("abs_energy", {}, "sum(x * x)"), ("root_mean_square", {}, "sqrt(sum(x * x) / count(*))")])
features("g10_skewness", [("skewness", {}, "CASE WHEN count(*) > 2 THEN CASE WHEN min(x) = max(x) THEN 0 ELSE skewness(x) END END")])
features("g11_kurtosis", [("kurtosis", {}, "CASE WHEN count(*) > 3 THEN CASE WHEN min(x) = max(x) THEN 0 ELSE kurtosis(x) END END")])
features("g12_variance_larger_than_std", [("variance_larger_than_standard_deviation", {}, "var_pop(x) > stddev_pop(x)")])
features("g13_large_standard_deviation", [
    ("large_standard_deviation", {"r": r}, f"stddev_pop(x) > {r} * (max(x) - min(x))") for r in (0.05, 0.2, 0.25, 0.35)])
features("g14_quantile", [("quantile", {"q": q}, f"quantile_cont(x, {q})") for q in (0.1, 0.25, 0.75, 0.9)])
features("g15_value_count", [("value_count", {"value": v}, f"count(*) FILTER (x = {v})") for v in (5.5, 0, 1)])
features("g16_range_count", [("range_count", {"min": a, "max": b}, f"count(*) FILTER (x >= {a} AND x < {b})") for a, b in ((-1, 1), (5, 20))])
features("g17_count_above_below", [
    ("count_above", {"t": 10}, "count(*) FILTER (x >= 10)::DOUBLE / count(*)"),
    ("count_below", {"t": 10}, "count(*) FILTER (x <= 10)::DOUBLE / count(*)")])
features("g18_has_duplicate_extreme", [
    ("has_duplicate_max", {}, "count(*) FILTER (x = hi) > 1"), ("has_duplicate_min", {}, "count(*) FILTER (x = lo) > 1")])
features("g19_has_duplicate", [("has_duplicate", {}, "count(DISTINCT x) < count(*)")])
features("g20_ratio_value_number", [("ratio_value_number_to_time_series_length", {}, "count(DISTINCT x)::DOUBLE / count(*)")])
features("g21_reoccurring_share", [
    ("percentage_of_reoccurring_values_to_all_values", {}, "count(DISTINCT x) FILTER (times > 1)::DOUBLE / count(DISTINCT x)"),
    ("percentage_of_reoccurring_datapoints_to_all_datapoints", {}, "count(*) FILTER (times > 1)::DOUBLE / count(*)")])
features("g22_reoccurring_sum", [
    ("sum_of_reoccurring_values", {}, "coalesce(sum(x) FILTER (times > 1 AND nth = 1), 0)"),
    ("sum_of_reoccurring_data_points", {}, "coalesce(sum(x) FILTER (times > 1), 0)")])
features("g23_symmetry_looking", [
    ("symmetry_looking", {"r": r}, f"abs(avg(x) - median(x)) < {r} * (max(x) - min(x))") for r in (0.0, 0.05, 0.1, 0.15)])
features("g24_variation_coefficient", [("variation_coefficient", {}, "stddev_pop(x) / nullif(avg(x), 0)")])

features("g25_binned_entropy", [("binned_entropy", {"max_bins": 10}, "-sum(p * ln(p))")], ctes="""
bins AS (SELECT series_id, block_id, CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 10)), 9) ELSE 0 END AS bin, count(*)::DOUBLE AS m, any_value(n) AS n
  FROM r GROUP BY 1, 2, 3),
shares AS (SELECT series_id, block_id, m / n AS p FROM bins)""", source="shares")

features("g26_benford_correlation", [("benford_correlation", {}, "corr(p, log10(1 + 1.0 / d))")], ctes="""
digits AS (SELECT series_id, block_id, n, CASE WHEN x <> 0 THEN floor(abs(x) / power(10.0, floor(log10(abs(x))))) END AS d FROM r),
grid AS (SELECT DISTINCT series_id, block_id, n, unnest(range(1, 10)) AS d FROM digits),
shares AS (SELECT series_id, block_id, grid.d, count(digits.d)::DOUBLE / grid.n AS p FROM grid LEFT JOIN digits USING (series_id, block_id, d) GROUP BY 1, 2, 3, grid.n)""",
         source="shares")

features("g27_count_above_below_mean", [
    ("count_above_mean", {}, "count(*) FILTER (x > mu)"), ("count_below_mean", {}, "count(*) FILTER (x < mu)")])
features("g28_ratio_beyond_r_sigma", [
    ("ratio_beyond_r_sigma", {"r": r}, f"count(*) FILTER (abs(x - mu) > {r} * sd)::DOUBLE / count(*)") for r in (0.5, 1.5, 2, 3)])
features("g29_location_of_extreme", [
    ("first_location_of_maximum", {}, "min(i) FILTER (x = hi)::DOUBLE / count(*)"),
    ("first_location_of_minimum", {}, "min(i) FILTER (x = lo)::DOUBLE / count(*)"),
    ("last_location_of_maximum", {}, "(max(i) FILTER (x = hi) + 1)::DOUBLE / count(*)"),
    ("last_location_of_minimum", {}, "(max(i) FILTER (x = lo) + 1)::DOUBLE / count(*)")])
features("g30_longest_strike", [
    ("longest_strike_above_mean", {}, "coalesce(max(m) FILTER (side = 1), 0)"),
    ("longest_strike_below_mean", {}, "coalesce(max(m) FILTER (side = -1), 0)")], ctes="""
sides AS (SELECT series_id, block_id, i, CASE WHEN x > mu THEN 1 WHEN x < mu THEN -1 ELSE 0 END AS side FROM r),
isles AS (SELECT *, i - row_number() OVER (PARTITION BY series_id, block_id, side ORDER BY i) AS isle FROM sides),
strikes AS (SELECT series_id, block_id, side, count(*) AS m FROM isles GROUP BY series_id, block_id, side, isle)""", source="strikes")
features("g31_energy_ratio_by_chunks", [
    ("energy_ratio_by_chunks", {"num_segments": 10, "segment_focus": f},
     f"coalesce(sum(x * x) FILTER (c = {f}), 0) / nullif(sum(x * x), 0)") for f in (0, 4, 9)], ctes="""
chunked AS (SELECT *, CASE WHEN i < (n % 10) * (n // 10 + 1) THEN i // (n // 10 + 1)
  ELSE n % 10 + (i - (n % 10) * (n // 10 + 1)) // greatest(n // 10, 1) END AS c FROM r)""", source="chunked")
features("g32_index_mass_quantile", [
    ("index_mass_quantile", {"q": q}, f"(min(i) FILTER (mass >= {q} * mass_all) + 1)::DOUBLE / count(*)") for q in (0.1, 0.5, 0.9)])
features("g33_mean_n_absolute_max", [
    ("mean_n_absolute_max", {"number_of_maxima": m}, f"CASE WHEN count(*) >= {m} THEN avg(abs(x)) FILTER (place <= {m}) END") for m in (3, 7)])
features("g34_mean_change", [("mean_change", {}, "(arg_max(x, i) - arg_min(x, i)) / nullif(count(*) - 1, 0)")])
features("g35_mean_abs_change", [("mean_abs_change", {}, "avg(abs(x - lag1))")])
features("g36_absolute_sum_of_changes", [("absolute_sum_of_changes", {}, "coalesce(sum(abs(x - lag1)), 0)")])
features("g37_second_derivative", [("mean_second_derivative_central", {}, "avg((lead1 - 2 * x + lag1) / 2)")])
_CID = "sqrt(coalesce(sum((x - lag1) * (x - lag1)), 0))"
features("g38_cid_ce", [("cid_ce", {"normalize": False}, _CID), ("cid_ce", {"normalize": True}, f"coalesce({_CID} / nullif(stddev_pop(x), 0), 0)")])
features("g39_c3", [("c3", {"lag": j}, f"coalesce(avg(x * lead{j} * lead{2 * j}), 0)") for j in (1, 2, 3)], digits=4)
features("g40_time_reversal_asymmetry", [
    ("time_reversal_asymmetry_statistic", {"lag": j},
     f"coalesce(avg(lead{2 * j} * lead{2 * j} * lead{j} - lead{j} * x * x), 0)") for j in (1, 2, 3)], digits=4)


def acf_sql(j: int) -> str:
    ahead = "x" if j == 0 else f"lead{j}"
    return f"CASE WHEN var_pop(x) > 0 THEN avg((x - mu) * ({ahead} - mu)) / nullif(var_pop(x), 0) END"


features("g41_autocorrelation", [("autocorrelation", {"lag": j}, acf_sql(j)) for j in (0, 1, 2, 5, 9)])

_LAGGED = """
acf AS (SELECT a.series_id, a.block_id, z.i - a.i AS lag, avg((a.x - a.mu) * (z.x - z.mu)) / nullif(any_value(a.va), 0) AS v
  FROM r a JOIN r z ON a.series_id = z.series_id AND a.block_id = z.block_id AND z.i > a.i GROUP BY 1, 2, 3),
every AS (SELECT DISTINCT series_id, block_id FROM r),
acfs AS (SELECT series_id, block_id, coalesce(v, 0) AS v FROM every LEFT JOIN acf USING (series_id, block_id))"""
features("g42_agg_autocorrelation", [
    ("agg_autocorrelation", {"f_agg": f, "maxlag": 40}, s) for f, s in
    (("mean", "avg(v)"), ("median", "median(v)"), ("var", "var_pop(v)"))], ctes=_LAGGED, source="acfs")
features("g43_number_crossing_m", [
    ("number_crossing_m", {"m": m}, f"count(*) FILTER ((x > {m}) <> (lag1 > {m}))") for m in (5, 10, 0)])
features("g44_number_peaks", [
    ("number_peaks", {"n": n}, "count(*) FILTER (x > l{0} AND x > h{0} AND i >= {0} AND i < n - {0})".format(n)) for n in (1, 3, 5)],
    ctes="peaks AS (SELECT *, " + ", ".join(
        f"max(x) OVER (PARTITION BY series_id, block_id ORDER BY i ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS l{n}, "
        f"max(x) OVER (PARTITION BY series_id, block_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) AS h{n}" for n in (1, 3, 5)) + " FROM r)",
    source="peaks")
_CORR = [(0.0, 0.8), (0.2, 0.6), (0.2, 1.0)]
features("g45_change_quantiles", [
    ("change_quantiles", {"f_agg": f, "isabs": a, "qh": h, "ql": lo},
     "coalesce({fn}({d}) FILTER (x BETWEEN q{l} AND q{h} AND lag1 BETWEEN q{l} AND q{h}), 0)".format(
         fn={"mean": "avg", "var": "var_pop"}[f], d="abs(x - lag1)" if a else "x - lag1", l=int(lo * 10), h=int(h * 10)))
    for lo, h in _CORR for f in ("mean", "var") for a in (True, False)],
    ctes="""q AS (SELECT series_id, block_id, """ + ", ".join(f"quantile_cont(x, {v / 10}) AS q{v}" for v in (0, 2, 6, 8, 10)) + """ FROM r GROUP BY 1, 2),
rq AS (SELECT * FROM r JOIN q USING (series_id, block_id))""", source="rq")


def trend_sql(y: str, x: str) -> dict[str, str]:
    n = f"count(CASE WHEN {y} IS NOT NULL AND {x} IS NOT NULL THEN 1 END)"
    r = f"(regr_sxy({y}, {x}) / nullif(sqrt(regr_syy({y}, {x}) * regr_sxx({y}, {x})), 0))"
    return {
        "slope": f"regr_slope({y}, {x})",
        "intercept": f"regr_intercept({y}, {x})",
        "rvalue": f"CASE WHEN {n} > 1 THEN coalesce({r}, 0) END",
        "stderr": f"""CASE WHEN {n} > 2 THEN sqrt(greatest(0, (1 - coalesce({r}, 0) * coalesce({r}, 0)) * regr_syy({y}, {x})
            / (regr_sxx({y}, {x}) * ({n} - 2)))) WHEN {n} = 2 THEN 0 END""",
    }


_LT = trend_sql("x", "i::DOUBLE")
features("g46_linear_trend", [("linear_trend", {"attr": a}, _LT[a]) for a in ("slope", "intercept", "rvalue", "stderr")], digits=5)


def alt_ctes(c: int) -> str:
    return f"""
ch AS (SELECT series_id, block_id, (i // {c})::DOUBLE AS c, max(x) AS v_max, min(x) AS v_min, avg(x) AS v_mean, var_pop(x) AS v_var FROM r GROUP BY 1, 2, 3)"""


features("g47_agg_linear_trend", [
    ("agg_linear_trend", {"attr": a, "chunk_len": 5, "f_agg": f}, trend_sql(f"v_{f}", "c")[a])
    for f in ("max", "min", "mean") for a in ("slope", "intercept", "rvalue", "stderr")],
    ctes=alt_ctes(5), source="ch")
features("g47_agg_linear_trend_var", [
    ("agg_linear_trend", {"attr": a, "chunk_len": 5, "f_agg": "var"}, trend_sql("v_var", "c")[a])
    for a in ("slope", "intercept", "rvalue", "stderr")],
    ctes=alt_ctes(5), source="ch", digits=3)
_LTT = trend_sql("x", "((t_us - t0) / 3600000000.0)")
features("g48_linear_trend_timewise", [("linear_trend_timewise", {"attr": a}, _LTT[a]) for a in ("slope", "intercept", "rvalue", "stderr")], digits=5)


def dft_sql(k: int, value: str = "x") -> tuple[str, str]:
    return (f"sum({value} * cos(2 * pi() * {k} * i / n))", f"-sum({value} * sin(2 * pi() * {k} * i / n))")


def fft_sql(attr: str, k: int) -> str:
    re_, im = dft_sql(k)
    v = {"real": re_, "imag": im, "abs": f"sqrt(power({re_}, 2) + power({im}, 2))", "angle": f"degrees(atan2({im}, {re_}))"}[attr]
    return f"CASE WHEN {k} <= count(*) // 2 THEN {v} END"


features("g49_fft_coefficient", [
    ("fft_coefficient", {"attr": a, "coeff": k}, fft_sql(a, k)) for a in ("real", "imag", "abs") for k in (0, 1, 2, 7, 15)])
# The last coefficient of an even block is real, so its angle is rounding noise around 0 or
# 180 degrees; both sides blank it.
_ANGLE = {k: feature_name("x", "fft_coefficient", {"attr": "angle", "coeff": k}) for k in (1, 2, 3)}


@query("g49_fft_angle", f"WITH {ROWS_SQL} SELECT series_id, block_id, " + ", ".join(
    f"round(CASE WHEN {2 * k} < count(*) THEN degrees(atan2({dft_sql(k)[1]}, {dft_sql(k)[0]})) END, 4) AS {ident(n)}" for k, n in _ANGLE.items())
    + " FROM r GROUP BY 1, 2")
def _(spark, sf):
    wanted = {"length": [{}], "fft_coefficient": [{"attr": "angle", "coeff": k} for k in _ANGLE]}
    wide = extract_features(event_blocks(spark, sf), BLOCK_KEYS, "i", "x", wanted)
    return wide.select(*BLOCK_KEYS, *[F.round(F.when(col("x__length") > 2 * k, col(n)), 4).alias(n) for k, n in _ANGLE.items()])


_SPECTRUM = """
amps AS (SELECT series_id, block_id, f, sqrt(power(sum(x * cos(2 * pi() * f * i / n)), 2) + power(sum(x * sin(2 * pi() * f * i / n)), 2)) AS a
  FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS f FROM r) GROUP BY 1, 2, 3),
mom AS (SELECT series_id, block_id, sum(f * a) / nullif(sum(a), 0) AS c, sum(f * f * a) / nullif(sum(a), 0) AS m2,
  sum(f * f * f * a) / nullif(sum(a), 0) AS m3, sum(f * f * f * f * a) / nullif(sum(a), 0) AS m4 FROM amps GROUP BY 1, 2)"""
features("g50_fft_aggregated", [
    ("fft_aggregated", {"aggtype": "centroid"}, "any_value(c)"),
    ("fft_aggregated", {"aggtype": "variance"}, "any_value(m2 - c * c)"),
    ("fft_aggregated", {"aggtype": "skew"}, "any_value(CASE WHEN m2 - c * c >= 0.5 THEN (m3 - 3 * c * (m2 - c * c) - c * c * c) / power(m2 - c * c, 1.5) END)"),
    ("fft_aggregated", {"aggtype": "kurtosis"}, "any_value(CASE WHEN m2 - c * c >= 0.5 THEN (m4 - 4 * c * m3 + 6 * m2 * c * c - 3 * c) / power(m2 - c * c, 2) END)"),
], ctes=_SPECTRUM, source="mom", digits=5)

_WELCH = """
tap AS (SELECT *, 0.5 - 0.5 * cos(2 * pi() * i / n) AS w FROM r),
psd AS (SELECT series_id, block_id, f, (power(sum((x - mu) * w * cos(2 * pi() * f * i / n)), 2) + power(sum((x - mu) * w * sin(2 * pi() * f * i / n)), 2))
    / nullif(sum(w * w), 0) * CASE WHEN f = 0 OR 2 * f = any_value(n) THEN 1 ELSE 2 END AS d
  FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS f FROM tap) GROUP BY 1, 2, 3)"""
features("g51_fourier_entropy", [("fourier_entropy", {"bins": b}, f"max(e{b})") for b in (2, 5, 10)], ctes=_WELCH + """,
ends AS (SELECT *, min(d) OVER w AS dl, max(d) OVER w AS dh, count(d) OVER w AS m FROM psd WINDOW w AS (PARTITION BY series_id, block_id)),
""" + ",\n".join(f"""s{b} AS (SELECT series_id, block_id, any_value(dh) AS dh, any_value(dl) AS dl, least(floor((d - dl) / nullif(dh - dl, 0) * {b}), {b - 1}) AS bin,
  count(d)::DOUBLE / nullif(any_value(m), 0) AS p FROM ends WHERE d IS NOT NULL GROUP BY series_id, block_id, bin),
f{b} AS (SELECT series_id, block_id, CASE WHEN max(dh) > max(dl) THEN -sum(p * ln(p)) WHEN max(dh) IS NOT NULL THEN 0 END AS e{b} FROM s{b} GROUP BY 1, 2)""" for b in (2, 5, 10)) + """,
keys AS (SELECT DISTINCT series_id, block_id FROM r),
ent AS (SELECT * FROM keys LEFT JOIN f2 USING (series_id, block_id) LEFT JOIN f5 USING (series_id, block_id) LEFT JOIN f10 USING (series_id, block_id))""",
    source="ent")
features("g52_spkt_welch_density", [("spkt_welch_density", {"coeff": k}, f"max(d) FILTER (f = {k})") for k in (2, 5, 8)], ctes=_WELCH, source="psd")


def cwt_sql(w: int, c: int) -> str:
    points = f"least({10 * w}, n)"
    tap = f"({c} - i + ({points} - 1) // 2)"
    v2 = f"power(({tap} - ({points} - 1) / 2.0) / {w}.0, 2)"
    scale = 2.0 / ((3.0 * w) ** 0.5 * 3.141592653589793 ** 0.25)
    return (f"CASE WHEN count(*) > {c} THEN sum(CASE WHEN {tap} >= 0 AND {tap} < {points} "
            f"THEN x * {scale!r} * (1 - {v2}) * exp(-{v2} / 2) ELSE 0 END) END")


features("g53_cwt_coefficients", [
    ("cwt_coefficients", {"coeff": c, "w": w, "widths": (2, 5, 10, 20)}, cwt_sql(w, c)) for w in (2, 5, 20) for c in (0, 3, 14)])


def order_cte(d: int) -> str:
    values = ["x", *[f"lead{j}" for j in range(1, d)]]
    pattern = " || ".join(f"CASE WHEN {values[a]} > {values[b]} THEN '1' ELSE '0' END" for a in range(d) for b in range(a + 1, d))
    return f"""
o{d} AS (SELECT series_id, block_id, {pattern} AS pattern, count(*)::DOUBLE AS m FROM r WHERE lead{d - 1} IS NOT NULL GROUP BY 1, 2, 3),
h{d} AS (SELECT series_id, block_id, ln(sum(m)) - sum(m * ln(m)) / sum(m) AS h{d} FROM o{d} GROUP BY 1, 2)"""


features("g54_permutation_entropy", [("permutation_entropy", {"dimension": d, "tau": 1}, f"max(h{d})") for d in (3, 5)],
         ctes=order_cte(3) + "," + order_cte(5) + """,
keys AS (SELECT DISTINCT series_id, block_id FROM r),
ent AS (SELECT * FROM keys LEFT JOIN h3 USING (series_id, block_id) LEFT JOIN h5 USING (series_id, block_id))""", source="ent")


def close_cte(name: str, m: int, tolerance: str) -> str:
    gap = "greatest(" + ", ".join(f"abs(a.{v} - z.{v})" for v in ["x", "lead1", "lead2"][:m]) + ")"
    last = "x" if m == 1 else f"lead{m - 1}"
    return f"""
{name} AS (SELECT a.series_id, a.block_id, a.i, count(*) FILTER ({gap} <= {tolerance} * a.sd)::DOUBLE AS c, count(*)::DOUBLE AS m
  FROM r a JOIN r z ON a.series_id = z.series_id AND a.block_id = z.block_id
  WHERE a.{last} IS NOT NULL AND z.{last} IS NOT NULL GROUP BY 1, 2, 3)"""


features("g55_sample_entropy", [("sample_entropy", {}, "max(CASE WHEN n > 3 AND l > 0 AND s > 0 THEN -ln(l / s) END)")],
         ctes=close_cte("c2", 2, "0.2") + "," + close_cte("c3", 3, "0.2") + """,
s2 AS (SELECT series_id, block_id, sum(c - 1) AS s FROM c2 GROUP BY 1, 2), s3 AS (SELECT series_id, block_id, sum(c - 1) AS l FROM c3 GROUP BY 1, 2),
keys AS (SELECT DISTINCT series_id, block_id, n FROM r),
ent AS (SELECT * FROM keys LEFT JOIN s2 USING (series_id, block_id) LEFT JOIN s3 USING (series_id, block_id))""", source="ent")
features("g56_approximate_entropy", [
    ("approximate_entropy", {"m": 2, "r": r}, f"max(CASE WHEN n <= 3 THEN 0 ELSE abs(p2_{int(r * 10)} - p3_{int(r * 10)}) END)") for r in (0.1, 0.5, 0.9)],
    ctes=",".join(close_cte(f"a{m}_{int(r * 10)}", m, str(r)) + f""",
f{m}_{int(r * 10)} AS (SELECT series_id, block_id, avg(ln(c / m)) AS p{m}_{int(r * 10)} FROM a{m}_{int(r * 10)} GROUP BY 1, 2)""" for r in (0.1, 0.5, 0.9) for m in (2, 3)) + """,
keys AS (SELECT DISTINCT series_id, block_id, n FROM r),
ent AS (SELECT * FROM keys """ + " ".join(f"LEFT JOIN f{m}_{r} USING (series_id, block_id)" for r in (1, 5, 9) for m in (2, 3)) + ")", source="ent")

# Levinson-Durbin for the first three lags, written out.
_PACF = """
rho AS (SELECT series_id, block_id, any_value(n) AS n, """ + ", ".join(f"{acf_sql(j)} AS r{j}" for j in (1, 2, 3)) + """ FROM r GROUP BY 1, 2),
l1 AS (SELECT *, r1 AS p11, 1 - r1 * r1 AS e1 FROM rho),
l2 AS (SELECT *, (r2 - p11 * r1) / nullif(e1, 0) AS p22 FROM l1),
l2b AS (SELECT *, p11 - p22 * p11 AS p21, e1 * (1 - p22 * p22) AS e2 FROM l2),
l3 AS (SELECT *, (r3 - p21 * r2 - p22 * r1) / nullif(e2, 0) AS p33 FROM l2b)"""
features("g57_partial_autocorrelation", [
    ("partial_autocorrelation", {"lag": 0}, "1.0"),
    *[("partial_autocorrelation", {"lag": j}, f"max(CASE WHEN n // 2 > {j} THEN p{j}{j} END)") for j in (1, 2, 3)]], ctes=_PACF, source="l3")


def t_tail_sql(source: str, y: str, x: str) -> str:
    r = f"(regr_sxy({y}, {x}) / nullif(sqrt(regr_syy({y}, {x}) * regr_sxx({y}, {x})), 0))"
    return f"""
tt AS (SELECT series_id, block_id, count(*) AS m, count(*) - 2 AS v, coalesce({r}, 0) AS rr FROM {source} GROUP BY 1, 2),
th AS (SELECT *, CASE WHEN v > 0 THEN atan(abs(rr) * sqrt(v / greatest(1e-20, 1 - rr * rr)) / sqrt(v)) END AS a FROM tt),
pv AS (SELECT series_id, block_id, CASE WHEN v < 1 THEN NULL
  WHEN v = 1 THEN 1 - 2 * a / pi()
  WHEN v % 2 = 1 THEN 1 - 2 / pi() * (a + sin(a) * list_sum(list_transform(range(0, (v - 1) // 2), lambda k: power(cos(a), 2 * k + 1) * sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)))))
  ELSE 1 - sin(a) * list_sum(list_transform(range(0, v // 2), lambda k: power(cos(a), 2 * k) * exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()))) END AS p FROM th)"""


features("g57b_linear_trend_pvalue", [("linear_trend", {"attr": "pvalue"}, "max(p)")], ctes=t_tail_sql("r", "x", "i::DOUBLE"), source="pv")

QUERY_SHAPE = (1.0, 5.0, 2.0, 8.0)
features("g58_block_profile", [
    *[("matrix_profile", {"feature": f, "m": 5}, None) for f in ("min", "max", "mean", "median", "25", "75")],
    ("query_similarity_count", {"query": QUERY_SHAPE, "threshold": 1.5}, None)])
features("g59_ar_coefficient", [("ar_coefficient", {"coeff": c, "k": 3}, None) for c in range(4)])


@query("g_default_catalogue")
def _(spark, sf):
    """The whole default catalogue in one plan."""
    from strideline.functions.features import default_catalogue

    blocks = event_blocks(spark, sf)
    return extract_features(blocks, BLOCK_KEYS, "i", "x", default_catalogue(True), time="t_us")
