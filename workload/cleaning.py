"""Queries over projections, missing values, labels and axis corrections."""

from pyspark.sql import functions as F

from strideline.operators import cleaning as cl
from workload.base import AXES_SQL, AXIS_KEYS, SERIES_SQL, axes, events_series, query, r6, table

HOLES_SQL = SERIES_SQL + """,
h AS (
  SELECT series_id, pos, CASE WHEN event_id % 7 <> 0 THEN value END AS value,
         CASE WHEN event_id % 5 <> 0 THEN k END AS k
  FROM s
)"""


def with_holes(spark, sf):
    """Values with nulls and NaNs put in by key."""
    nan = F.lit(float("nan"))
    return events_series(spark, sf).select(
        "series_id", "pos",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).otherwise(F.when(F.col("event_id") % 2 == 0, nan)).alias("value"),
        F.when(F.col("event_id") % 5 != 0, F.col("k")).alias("k"),
    )


@query("b1_select_named", "SELECT event_id AS id, value AS reading, event_type AS kind FROM events")
def _(spark, sf):
    return cl.select_named(table(spark, sf, "events"), ["event_id", "value", "event_type"], ["id", "reading", "kind"])


@query("b2_epoch_to_timestamp", f"WITH {SERIES_SQL} SELECT series_id, pos, make_timestamp((t_us // 1000) * 1000) AS time FROM s")
def _(spark, sf):
    s = events_series(spark, sf).select("series_id", "pos", F.expr("t_us div 1000").alias("time"))
    return cl.epoch_to_timestamp(s, "time", "ms")


@query("b3_drop_missing", f"WITH {HOLES_SQL} SELECT * FROM h WHERE value IS NOT NULL AND k IS NOT NULL")
def _(spark, sf):
    return cl.remove_missing(with_holes(spark, sf), "del_row")


@query("b4_fill_mean", f"""WITH {HOLES_SQL}
SELECT series_id, pos, round(coalesce(value, (SELECT avg(value) FROM h)), 6) AS value,
       round(coalesce(k, (SELECT avg(k) FROM h)), 6) AS k FROM h""")
def _(spark, sf):
    return cl.remove_missing(with_holes(spark, sf), "mean").select("series_id", "pos", r6("value"), r6("k"))


@query("b4_fill_mean_per_series", f"""WITH {HOLES_SQL}
SELECT series_id, pos, round(coalesce(value, avg(value) OVER (PARTITION BY series_id)), 6) AS value, k FROM h""")
def _(spark, sf):
    return cl.fill_mean(with_holes(spark, sf), ["value"], ["series_id"]).select("series_id", "pos", r6("value"), "k")


@query("b5_fill_value", f"WITH {HOLES_SQL} SELECT series_id, pos, coalesce(value, -1.0) AS value, coalesce(k, -1.0) AS k FROM h")
def _(spark, sf):
    return cl.remove_missing(with_holes(spark, sf), "replacement_val", value=-1.0)


@query("b6_drop_labels", f"""WITH {SERIES_SQL} SELECT series_id, pos, coarse_label, road_label FROM s
WHERE (coarse_label IS NULL OR coarse_label NOT IN (2, 6)) AND road_label NOT IN (3)""")
def _(spark, sf):
    s = events_series(spark, sf).select("series_id", "pos", "coarse_label", "road_label")
    return cl.drop_labels(s, {"coarse_label": [2.0, 6.0], "road_label": [3.0]})


@query("b7_keep_labels", f"""WITH {SERIES_SQL} SELECT series_id, pos, coarse_label, road_label FROM s
WHERE coarse_label IN (5) AND road_label IN (1, 3)""")
def _(spark, sf):
    s = events_series(spark, sf).select("series_id", "pos", "coarse_label", "road_label")
    return cl.keep_labels(s, {"coarse_label": [5.0], "road_label": [1.0, 3.0]})


@query("b8_encode", f"""WITH {SERIES_SQL} SELECT series_id, pos,
CAST(CASE WHEN coarse_label > 2 THEN 1 ELSE 0 END AS INTEGER) AS coarse_label,
CAST(CASE WHEN road_label > 2 THEN 1 ELSE 0 END AS INTEGER) AS road_label FROM s""")
def _(spark, sf):
    s = events_series(spark, sf).select("series_id", "pos", "coarse_label", "road_label")
    return cl.encode(s, ["coarse_label", "road_label"])


KEY_SQL = ", ".join(AXIS_KEYS)


@query("b9_remove_gravity", f"WITH {AXES_SQL} SELECT {KEY_SQL}, round(ax - w, 6) AS ax, round(ay - az, 6) AS ay FROM a")
def _(spark, sf):
    out = cl.project_to_global(axes(spark, sf), "gravity", ["ax", "ay"], ["w", "az"])
    return out.select(*AXIS_KEYS, r6("ax"), r6("ay"))


@query("b10_project_orientation", f"""WITH {AXES_SQL} SELECT {KEY_SQL}, round(ax * (ay / nullif(w, 0)), 4) AS ax,
round(az * (az / nullif(w, 0)), 4) AS az FROM a""")
def _(spark, sf):
    out = cl.project_to_global(axes(spark, sf), "orientation", ["ax", "az"], ["ay", "az", "w"])
    return out.select(*AXIS_KEYS, F.round("ax", 4).alias("ax"), F.round("az", 4).alias("az"))


@query("b11_mean_gravity", f"""WITH {SERIES_SQL} SELECT series_id, pos,
round(value - avg(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS value FROM s""")
def _(spark, sf):
    s = events_series(spark, sf).select("series_id", "pos", "value")
    out = cl.project_to_global(s, "mean_estimate_gravity", ["value"], keys=["series_id"], pos="pos", rows=9)
    return out.select("series_id", "pos", r6("value"))


@query("b12_first_of_equal_names", "SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return cl.first_of_equal_names(o.join(c, o.o_custkey == c.o_custkey, "inner"))


@query("b13_constant_id", "SELECT event_id, CAST(7 AS INTEGER) AS series_id FROM events")
def _(spark, sf):
    return cl.with_series_id(table(spark, sf, "events").select("event_id"), 7)


@query("b14_select_features", f"""WITH {SERIES_SQL} SELECT series_id, avg(value)::DECIMAL(18,4)::DOUBLE AS value__mean,
avg(k)::DECIMAL(18,4)::DOUBLE AS k__mean FROM s GROUP BY series_id""")
def _(spark, sf):
    wide = events_series(spark, sf).groupBy("series_id").agg(
        F.avg("value").cast("decimal(18,4)").cast("double").alias("value__mean"), F.max("value").alias("value__maximum"),
        F.avg("k").cast("decimal(18,4)").cast("double").alias("k__mean"), F.max("k").alias("k__maximum"),
    )
    return cl.select_features(wide, ["__mean"], ["series_id"])


@query("b15_sample_series", f"""WITH {SERIES_SQL},
u AS (SELECT *, (series_id * 48271 + 3 * 69621 + 12345) % 2147483647 AS m FROM s)
SELECT series_id, pos, value FROM u WHERE (m * m) % 2147483647 % 100 < 50""")
def _(spark, sf):
    s = events_series(spark, sf).select("series_id", "pos", "value")
    return cl.sample_series(s, "series_id", 50, seed=3)
