"""End-to-end runs over the event series."""

from pyspark.sql import functions as F

from strideline.plans.preparation import prepare_inference, prepare_training
from strideline.plans.runs import experiment_grid, inference_run, train_run
from strideline.plans.settings import Settings
from workload.base import SERIES_SQL, events_series, query, r6
from workload.models import SHORT
from workload.sources import scratch

HOURS = 3_600_000_000
AXES = ["value", "k"]

SPLIT_SQL = SERIES_SQL + """,
o AS (SELECT *, row_number() OVER (ORDER BY series_id, pos) - 1 AS row, count(*) OVER () AS n FROM s WHERE coarse_label IS NOT NULL),
parts AS (SELECT *, CASE WHEN row >= n - floor(n * 0.25) THEN 'valid' WHEN row >= n - floor(n * 0.25) - floor(n * 0.25) THEN 'test'
  WHEN row < floor(n * 0.5) THEN 'train' END AS part FROM o),
oc AS (SELECT *, pos - row_number() OVER (PARTITION BY part, series_id ORDER BY pos) AS g FROM parts WHERE part IS NOT NULL AND coarse_label = 5),
oc2 AS (SELECT *, min(pos) OVER (PARTITION BY part, series_id, g) AS outer_start FROM oc),
nc AS (SELECT *, pos - row_number() OVER (PARTITION BY part, series_id, outer_start, road_label ORDER BY pos) AS g2,
  CASE road_label WHEN 1 THEN 0 ELSE 1 END AS inner_rank FROM oc2 WHERE road_label IN (1, 3)),
sg AS (SELECT *, min(pos) OVER (PARTITION BY part, series_id, outer_start, road_label, g2) AS inner_start FROM nc)"""


def split_frames(spark, sf):
    s = events_series(spark, sf)
    return s.select("series_id", "pos", "t_us", *AXES), s.select("series_id", "pos", "coarse_label", "road_label")


PREPARED_SQL = SPLIT_SQL + f""",
bn AS (SELECT part, series_id, outer_start, inner_rank, inner_start, t_us // {6 * HOURS} AS bin, avg(value) AS a, avg(k) AS b, avg(road_label) AS road_label
  FROM sg GROUP BY 1, 2, 3, 4, 5, 6),
sp AS (SELECT part, series_id, outer_start, inner_rank, inner_start, unnest(range(min(bin), max(bin) + 1)) AS bin FROM bn GROUP BY 1, 2, 3, 4, 5),
rs AS (SELECT part, series_id, row_number() OVER (PARTITION BY part ORDER BY series_id, outer_start, inner_rank, inner_start, bin) AS cell,
  sqrt(coalesce(a * a, 0) + coalesce(b * b, 0)) AS x, road_label FROM sp LEFT JOIN bn USING (part, series_id, outer_start, inner_rank, inner_start, bin)),
st AS (SELECT avg(x) AS mu, stddev_samp(x) AS sd FROM rs WHERE part = 'train'),
zn AS (SELECT rs.*, (x - mu) / sd AS z FROM rs, st),
qt AS (SELECT part, quantile_cont(z, 0.01) AS lo, quantile_cont(z, 0.99) AS hi FROM zn GROUP BY 1),
tr AS (SELECT zn.*, row_number() OVER (PARTITION BY part ORDER BY cell) - 1 AS idx, count(*) OVER (PARTITION BY part) AS m
  FROM zn JOIN qt USING (part) WHERE z BETWEEN lo AND hi)"""


@query("j1_prepare_training", f"WITH {PREPARED_SQL} SELECT part, series_id, idx, round(z, 6) AS acceleration_abs, road_label FROM tr WHERE idx < m - 2")
def _(spark, sf):
    readings, labels = split_frames(spark, sf)
    signal, _stats = prepare_training(readings, labels, Settings(axes=AXES, freq="6h"))
    return signal.select("part", "series_id", "idx", r6("acceleration_abs"), "road_label")


@query("j2_prepare_inference", f"""WITH {SERIES_SQL},
bn AS (SELECT series_id, t_us // {6 * HOURS} AS bin, avg(value) AS a, avg(k) AS b FROM s GROUP BY 1, 2),
sp AS (SELECT series_id, unnest(range(min(bin), max(bin) + 1)) AS bin FROM bn GROUP BY 1),
rs AS (SELECT series_id, bin, (sqrt(coalesce(a * a, 0) + coalesce(b * b, 0)) - 40.0) / 25.0 AS z FROM sp LEFT JOIN bn USING (series_id, bin)),
qt AS (SELECT quantile_cont(z, 0.01) AS lo, quantile_cont(z, 0.99) AS hi FROM rs),
tr AS (SELECT *, row_number() OVER (ORDER BY series_id, bin) - 1 AS idx, count(*) OVER () AS m FROM rs, qt WHERE z BETWEEN lo AND hi)
SELECT series_id, idx, round(z, 6) AS acceleration_abs FROM tr WHERE idx < m - 1""")
def _(spark, sf):
    readings, _labels = split_frames(spark, sf)
    stats = {"mean_acceleration_abs": 40.0, "std_acceleration_abs": 25.0}
    out = prepare_inference(readings, stats, Settings(axes=AXES, freq="6h"))
    return out.select("series_id", "idx", r6("acceleration_abs"))


def run_frames(spark, sf):
    """Whole trips carry one road label; the signal of one class is stretched."""
    s = events_series(spark, sf)
    far = F.col("series_id") % 2 == 1
    readings = s.select("series_id", "pos", "t_us", F.when(far, F.col("value") * 1.8 + 20).otherwise(F.col("value")).alias("value"), (F.col("k") / 20).alias("k"))
    labels = s.select("series_id", "pos", F.lit(5.0).alias("coarse_label"), F.when(far, 3.0).otherwise(1.0).alias("road_label"))
    return readings, labels


CATALOGUE = {"mean": [{}], "median": [{}], "maximum": [{}], "abs_energy": [{}], "standard_deviation": [{}], "has_duplicate": [{}],
             "quantile": [{"q": 0.1}, {"q": 0.9}], "autocorrelation": [{"lag": 1}], "mean_abs_change": [{}]}


def quick(**changes) -> Settings:
    base = dict(axes=AXES, freq="1D", block_rows=10, catalogue=CATALOGUE, fdr_level=0.05, models=["cart_tree", "random_forrest"],
                space=SHORT, draws=1, folds=2, trees=100, radii=[2], lengths=[8], class_bounds=(0.1, 0.9))
    return Settings(**{**base, **changes})


@query("j3_training_run")
def _(spark, sf):
    readings, labels = run_frames(spark, sf)
    return train_run(spark, readings, labels, quick(), scratch(spark)).drop("run_tag")


@query("j4_inference_run")
def _(spark, sf):
    readings, labels = run_frames(spark, sf)
    settings, root = quick(models=["cart_tree"]), scratch(spark)
    train_run(spark, readings, labels, settings, root)
    return inference_run(spark, readings, settings, root)


@query("j5_experiment_grid")
def _(spark, sf):
    """Two settings that share a preparation."""
    readings, labels = run_frames(spark, sf)
    grid = [quick(models=["cart_tree"], block_rows=b, reduction=r) for b, r in ((10, "euclidean"), (15, "euclidean"))]
    return experiment_grid(spark, readings, labels, grid, scratch(spark))


@query("j3_motif_training_run")
def _(spark, sf):
    readings, labels = run_frames(spark, sf)
    settings = quick(models=["cart_tree"], extractor="motif", radii=[5], class_bounds=(-0.01, 1.01))
    return train_run(spark, readings, labels, settings, scratch(spark)).drop("run_tag")
