"""The flagship query: hourly means of every series, normalised, trimmed, described per block."""

from pyspark.sql import functions as F

from strideline.functions.manual import manual_features
from strideline.materialise import cut
from strideline.operators import segments as sm
from strideline.operators import signal as sg
from strideline.ordering import int_div
from workload.base import SERIES_SQL, events_series, query, r6

HOUR_US = 3_600_000_000
ROWS = 15


@query("flagship_block_features", f"""WITH {SERIES_SQL},
h AS (SELECT series_id, t_us // {HOUR_US} AS bin, avg(value) AS x, avg(road_label) AS road_label FROM s GROUP BY 1, 2),
m AS (SELECT avg(x) AS mu, stddev_samp(x) AS sd FROM h),
z AS (SELECT series_id, bin, (x - mu) / sd AS x, road_label FROM h, m),
q AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM z),
t AS (SELECT series_id, x, road_label, row_number() OVER (PARTITION BY series_id ORDER BY bin) - 1 AS idx FROM z, q WHERE x BETWEEN lo AND hi),
f AS (SELECT series_id, idx // {ROWS} AS block_id, avg(x) AS mean, stddev_samp(x) AS std, var_samp(x) AS var, max(x) AS max FROM t GROUP BY 1, 2),
c AS (SELECT series_id, idx // {ROWS} AS block_id, road_label AS label, count(*) AS n, min(idx) AS first FROM t GROUP BY 1, 2, 3),
y AS (SELECT series_id, block_id, label FROM c QUALIFY row_number() OVER (PARTITION BY series_id, block_id ORDER BY n DESC, first) = 1)
SELECT series_id, block_id, round(mean, 6) AS mean, round(std, 6) AS std, round(var, 6) AS var, round(max, 6) AS max, label
FROM f JOIN y USING (series_id, block_id)""")
def block_features(spark, sf):
    s = events_series(spark, sf).select("series_id", "t_us", F.col("value").alias("x"), "road_label")
    bins = cut(sm.resample(s, ["series_id"], "t_us", "1h", ["x", "road_label"], fill=False))
    normal, _stats = sg.znormalize(bins, ["x"])
    kept = cut(sg.trim_quantile(normal, ["x"], 0.99)).withColumn("hour", int_div("bin_us", HOUR_US))
    blocks = cut(sm.number_blocks(kept, ["series_id"], "hour", ROWS))
    keys = ["series_id", "block_id"]
    described = manual_features(blocks, keys, "x")
    labels = sm.majority_label(blocks, keys, "road_label", "idx")
    joined = described.join(labels, on=keys, how="inner")
    return joined.select(*keys, r6("mean"), r6("std"), r6("var"), r6("max"), "label")
