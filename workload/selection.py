"""Queries over feature tables: impute, relevance tests, selection, replay and pivot."""

from pyspark.sql import functions as F

from strideline.functions import relevance as rl
from strideline.functions.features import extract_features
from strideline.functions.scalar import ERFC_FIT
from workload.base import BLOCK_KEYS, BLOCKS_SQL, event_blocks, query, r6, table

LONG_SQL = """
lng AS (SELECT vec_id, feature, value, CAST(label >= 5 AS INTEGER) AS y FROM (
  SELECT vec_id, label, 'e' || lpad(CAST(p - 1 AS VARCHAR), 2, '0') AS feature, CAST(embedding[p] AS DOUBLE) AS value
  FROM (SELECT *, unnest(range(1, 65)) AS p FROM embeddings))
UNION ALL SELECT vec_id, 'sign', CAST(embedding[1] > 0 AS INTEGER)::DOUBLE, CAST(label >= 5 AS INTEGER) FROM embeddings
UNION ALL SELECT vec_id, 'even', CAST(label % 2 = 0 AS INTEGER)::DOUBLE, CAST(label >= 5 AS INTEGER) FROM embeddings
UNION ALL SELECT vec_id, 'constant', 4.0, CAST(label >= 5 AS INTEGER) FROM embeddings
UNION ALL SELECT vec_id, 'tenths', round(embedding[2]::DOUBLE * 10), CAST(label >= 5 AS INTEGER) FROM embeddings
UNION ALL SELECT vec_id, 'shifted', embedding[3]::DOUBLE + 0.04 * (label >= 5)::INTEGER, CAST(label >= 5 AS INTEGER) FROM embeddings)"""


def long_features(spark, sf):
    """Embedding components plus a binary, a constant, a tied and a class-shifted feature."""
    e = table(spark, sf, "embeddings").withColumn("y", (F.col("label") >= 5).cast("int"))
    parts = e.select("vec_id", "y", F.posexplode("embedding").alias("p", "v")).select(
        "vec_id", F.concat(F.lit("e"), F.lpad(F.col("p").cast("string"), 2, "0")).alias("feature"), F.col("v").cast("double").alias("value"), "y"
    )
    made = {
        "sign": (F.col("embedding")[0] > 0).cast("double"),
        "even": (F.col("label") % 2 == 0).cast("double"),
        "constant": F.lit(4.0),
        "tenths": F.round(F.col("embedding")[1].cast("double") * 10),
        "shifted": F.col("embedding")[2].cast("double") + 0.04 * F.col("y"),
    }
    extra = e.select("vec_id", "y", F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in made.items()])).alias("f"))
    return parts.unionByName(extra.select("vec_id", "f.feature", "f.value", "y"))


@query("g60_impute", f"""WITH {LONG_SQL},
h AS (SELECT vec_id, feature, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN 'inf'::DOUBLE WHEN vec_id % 17 = 0 THEN '-inf'::DOUBLE ELSE value END AS value FROM lng),
s AS (SELECT feature, median(value) FILTER (isfinite(value)) AS md, max(value) FILTER (isfinite(value)) AS hi, min(value) FILTER (isfinite(value)) AS lo FROM h GROUP BY 1)
SELECT vec_id, feature, round(coalesce(CASE WHEN value IS NULL THEN md WHEN value = 'inf'::DOUBLE THEN hi WHEN value = '-inf'::DOUBLE THEN lo ELSE value END, 0), 6) AS value
FROM h JOIN s USING (feature)""")
def _(spark, sf):
    v = F.col("vec_id")
    holes = long_features(spark, sf).select("vec_id", "feature", F.when(v % 11 == 0, F.when(v % 2 == 0, float("nan")))
                                            .when(v % 13 == 0, float("inf")).when(v % 17 == 0, float("-inf")).otherwise(F.col("value")).alias("value"))
    return rl.impute(holes).select("vec_id", "feature", r6("value"))


def erfc_sql(z: str) -> str:
    t = f"(1 / (1 + ({z}) / sqrt(2.0) / 2))"
    poly = repr(ERFC_FIT[-1])
    for c in reversed(ERFC_FIT[:-1]):
        poly = f"({c!r} + {t} * {poly})"
    return f"{t} * exp(-(({z}) / sqrt(2.0)) * (({z}) / sqrt(2.0)) + {poly})"


MW_SQL = """
vals AS (SELECT feature, count(DISTINCT value) AS v FROM lng GROUP BY 1),
rk AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r,
  count(*) OVER (PARTITION BY feature, value) AS t FROM lng),
mw AS (SELECT feature, sum(r) FILTER (y = 1) AS r1, count(*) FILTER (y = 1)::DOUBLE AS n1, count(*) FILTER (y = 0)::DOUBLE AS n0, sum(t * t - 1.0) AS ties FROM rk GROUP BY 1),
mz AS (SELECT feature, r1 - n1 * (n1 + 1) / 2 AS u, greatest(0, (abs(r1 - n1 * (n1 + 1) / 2 - n1 * n0 / 2) - 0.5)
  / nullif(sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))), 0)) AS z FROM mw),
mp AS (SELECT feature, u, least(1.0, """ + erfc_sql("z") + """) AS p_value FROM mz)"""


@query("g61_real_feature_pvalues", f"WITH {LONG_SQL}, {MW_SQL} SELECT feature, u AS statistic, round(p_value, 6) AS p_value FROM mp JOIN vals USING (feature) WHERE v > 2")
def _(spark, sf):
    counts = rl.class_counts(long_features(spark, sf).where("feature NOT IN ('sign', 'even', 'constant')"), "y")
    return rl.real_feature_pvalues(counts).select("feature", "statistic", r6("p_value"))


FISHER_SQL = """
bn AS (SELECT feature, count(*) FILTER (value = 1 AND y = 1) AS k, count(*) FILTER (value = 1) AS r, count(*) FILTER (y = 1) AS c, count(*) AS n
  FROM lng WHERE feature IN ('sign', 'even') GROUP BY 1),
tb AS (SELECT *, unnest(range(greatest(0, r + c - n), least(r, c) + 1)) AS x FROM bn),
pr AS (SELECT feature, x, k, lgamma(r + 1) + lgamma(n - r + 1) + lgamma(c + 1) + lgamma(n - c + 1) - lgamma(n + 1)
  - lgamma(x + 1) - lgamma(r - x + 1) - lgamma(c - x + 1) - lgamma(n - r - c + x + 1) AS lp FROM tb),
ob AS (SELECT feature, lp AS lo FROM pr WHERE x = k),
fp AS (SELECT feature, least(1.0, sum(exp(lp)) FILTER (lp <= lo + 1e-7)) AS p_value FROM pr JOIN ob USING (feature) GROUP BY 1)"""


@query("g62_binary_feature_pvalues", f"WITH {LONG_SQL}, {FISHER_SQL} SELECT feature, round(p_value, 6) AS p_value FROM fp")
def _(spark, sf):
    counts = rl.class_counts(long_features(spark, sf).where("feature IN ('sign', 'even')"), "y")
    return rl.binary_feature_pvalues(counts).select("feature", r6("p_value"))


FDR_SQL = f"""{LONG_SQL}, {MW_SQL}, {FISHER_SQL},
pv AS (SELECT feature, CASE WHEN v = 1 THEN NULL WHEN v = 2 THEN fp.p_value ELSE mp.p_value END AS p_value,
  CASE WHEN v = 1 THEN 'constant' WHEN v = 2 THEN 'binary' ELSE 'real' END AS kind FROM vals LEFT JOIN mp USING (feature) LEFT JOIN fp USING (feature)),
rkd AS (SELECT *, row_number() OVER (ORDER BY p_value, feature) AS k, count(*) OVER () AS m FROM pv WHERE p_value IS NOT NULL),
hm AS (SELECT *, sum(1.0 / k) OVER () AS h FROM rkd),
lst AS (SELECT coalesce(max(k) FILTER (p_value <= k * 0.01 / (m * h)), 0) AS last FROM hm)"""


@query("g63_select_fdr", f"WITH {FDR_SQL} SELECT pv.feature, pv.kind, round(pv.p_value, 6) AS p_value, coalesce(k <= last, false) AS relevant FROM pv LEFT JOIN hm USING (feature), lst")
def _(spark, sf):
    out = rl.relevance_table(long_features(spark, sf), "y", 0.01)
    return out.select("feature", "kind", r6("p_value"), "relevant")


@query("g64_replay_selected", f"""WITH {BLOCKS_SQL} SELECT series_id, block_id, round(quantile_cont(x, 0.9), 6) AS "x__quantile__q_0.9",
count(*) FILTER (x >= -1 AND x < 1)::DOUBLE AS "x__range_count__max_1__min_-1", round(sum(x * x), 6) AS "x__abs_energy" FROM b GROUP BY 1, 2""")
def _(spark, sf):
    names = ["x__quantile__q_0.9", "x__range_count__max_1__min_-1", "x__abs_energy"]
    wanted = rl.replay_catalogue(names)["x"]
    wide = extract_features(event_blocks(spark, sf), BLOCK_KEYS, "i", "x", wanted)
    return wide.select(*BLOCK_KEYS, *[F.round(F.col(f"`{n}`"), 6).alias(n) for n in names])


@query("g65_pivot_features", f"""WITH {LONG_SQL} SELECT vec_id, round(max(value) FILTER (feature = 'e00'), 6) AS e00, round(max(value) FILTER (feature = 'shifted'), 6) AS shifted,
max(value) FILTER (feature = 'sign') AS sign FROM lng GROUP BY 1""")
def _(spark, sf):
    wide = rl.pivot_features(long_features(spark, sf), ["vec_id"], ["e00", "shifted", "sign"])
    return wide.select("vec_id", r6("e00"), r6("shifted"), "sign")


@query("g65_melt_features", f"""WITH {BLOCKS_SQL} SELECT series_id, block_id, 'x__maximum' AS feature, max(x) AS value FROM b GROUP BY 1, 2
UNION ALL SELECT series_id, block_id, 'x__minimum', min(x) FROM b GROUP BY 1, 2""")
def _(spark, sf):
    wide = extract_features(event_blocks(spark, sf), BLOCK_KEYS, "i", "x", {"maximum": [{}], "minimum": [{}]})
    return rl.melt_features(wide, BLOCK_KEYS)
