"""Queries over matrix profiles and motifs, per series."""

from pyspark.sql import functions as F

from strideline.functions import motifs as mt
from strideline.plans.settings import Settings
from workload.base import SERIES_SQL, events_series, query, r6

M = 8


def series(spark, sf):
    return events_series(spark, sf).select("series_id", "pos", "value", "road_label")


PROFILE_SQL = f"""{SERIES_SQL},
win AS (SELECT series_id, pos, list(value) OVER o AS w, avg(value) OVER o AS mu, stddev_pop(value) OVER o AS sd, count(*) OVER o AS c FROM s
  WINDOW o AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {M - 1} FOLLOWING)),
ok AS (SELECT * FROM win WHERE c = {M} AND sd > 0),
prs AS (SELECT a.series_id, a.pos, z.pos AS partner, sqrt(greatest(0, 2.0 * {M} * (1 - (list_dot_product(a.w, z.w) - {M} * a.mu * z.mu) / ({M} * a.sd * z.sd)))) AS d
  FROM ok a JOIN ok z ON a.series_id = z.series_id AND abs(a.pos - z.pos) > {M // 4}),
prof AS (SELECT series_id, pos, min(d) AS distance, arg_min(partner, d) AS partner FROM prs GROUP BY 1, 2)"""


@query("h1_matrix_profile", f"WITH {PROFILE_SQL} SELECT series_id, pos, round(distance, 5) AS distance, partner FROM prof")
def _(spark, sf):
    out = mt.matrix_profile(series(spark, sf), ["series_id"], "pos", "value", M)
    return out.select("series_id", "pos", F.round("distance", 5).alias("distance"), "partner")


@query("h1_matrix_profile_tiled", f"WITH {PROFILE_SQL} SELECT series_id, pos, round(distance, 5) AS distance, partner FROM prof")
def _(spark, sf):
    """Same result from tiles shorter than a series."""
    out = mt.matrix_profile(series(spark, sf), ["series_id"], "pos", "value", M, tile_rows=20)
    return out.select("series_id", "pos", F.round("distance", 5).alias("distance"), "partner")


def profile_sql(m: int) -> str:
    return PROFILE_SQL.replace(f"{M - 1} FOLLOWING", f"{m - 1} FOLLOWING").replace(f"c = {M} AND", f"c = {m} AND").replace(f"2.0 * {M} *", f"2.0 * {m} *").replace(
        f"- {M} * a.mu", f"- {m} * a.mu").replace(f"({M} * a.sd", f"({m} * a.sd").replace(f"> {M // 4})", f"> {m // 4})")


@query("h1_matrix_profile_long_windows", f"WITH {profile_sql(24)} SELECT series_id, pos, round(distance, 5) AS distance, partner FROM prof")
def _(spark, sf):
    """Windows of 24 values over slices of 32."""
    out = mt.matrix_profile(series(spark, sf), ["series_id"], "pos", "value", 24, tile_rows=32)
    return out.select("series_id", "pos", F.round("distance", 5).alias("distance"), "partner")


@query("h2_motif_seed", f"""WITH {PROFILE_SQL} SELECT series_id, round(min(distance), 5) AS distance, min(least(pos, partner)) AS pos, max(greatest(pos, partner)) AS partner
FROM (SELECT *, min(distance) OVER (PARTITION BY series_id) AS best FROM prof) WHERE distance <= best + 1e-9 GROUP BY 1""")
def _(spark, sf):
    profile = mt.matrix_profile(series(spark, sf), ["series_id"], "pos", "value", M)
    seed = mt.motif_seed(profile, ["series_id"])
    return seed.select("series_id", F.round("distance", 5).alias("distance"), F.least("pos", "partner").alias("pos"), F.greatest("pos", "partner").alias("partner"))


def _motif_sql(n: int, taken: str) -> str:
    """The n-th motif: its pair, the windows near the first of it, and the greedy choice window by window.

    ``taken`` tells whether a window stands near an occurrence of an earlier motif.
    """
    zone, found = M // 2, "sqrt(greatest(0, 2.0 * {M} * (1 - (list_dot_product(a.w, z.w) - {M} * a.mu * z.mu) / ({M} * a.sd * z.sd))))".replace("{M}", str(M))
    return f"""
seed{n} AS (SELECT DISTINCT ON (series_id) series_id, pos, partner, distance FROM prof p WHERE NOT {taken.format(x='p')} ORDER BY series_id, round(distance, 9), pos),
ends{n} AS (SELECT series_id, unnest([pos, partner]) AS pos FROM seed{n}),
near{n} AS (SELECT series_id, pos, row_number() OVER (PARTITION BY series_id ORDER BY d, pos) AS r FROM (
  SELECT z.series_id, z.pos, {found} AS d, e.distance FROM seed{n} e JOIN ok a USING (series_id, pos) JOIN ok z ON z.series_id = a.series_id) q
  WHERE d <= 2.0 * distance AND NOT {taken.format(x='q')} AND NOT EXISTS (SELECT 1 FROM ends{n} e WHERE e.series_id = q.series_id AND abs(e.pos - q.pos) <= {zone})),
pick{n} AS (SELECT series_id, 0::BIGINT AS r, []::BIGINT[] AS chosen FROM seed{n}
  UNION ALL SELECT p.series_id, n.r, CASE WHEN len(list_filter(p.chosen, lambda c: abs(c - n.pos) <= {zone})) > 0 THEN p.chosen ELSE list_append(p.chosen, n.pos) END
  FROM pick{n} p JOIN near{n} n ON n.series_id = p.series_id AND n.r = p.r + 1),
occ{n} AS (SELECT series_id, pos FROM ends{n} UNION ALL SELECT series_id, unnest(chosen) FROM (SELECT series_id, arg_max(chosen, r) AS chosen FROM pick{n} GROUP BY 1))"""


_FIRST_TAKEN = f"EXISTS (SELECT 1 FROM occ1 o WHERE o.series_id = {{x}}.series_id AND abs(o.pos - {{x}}.pos) <= {M // 2})"


@query("h2_top_motifs", f"""WITH RECURSIVE {PROFILE_SQL}, {_motif_sql(1, 'false')}, {_motif_sql(2, _FIRST_TAKEN)}
SELECT o.series_id, 1 AS tag, o.pos, round(s.distance, 5) AS distance FROM occ1 o JOIN seed1 s ON s.series_id = o.series_id
UNION ALL SELECT o.series_id, 2, o.pos, round(s.distance, 5) FROM occ2 o JOIN seed2 s ON s.series_id = o.series_id""")
def _(spark, sf):
    out = mt.top_motifs(series(spark, sf), ["series_id"], "pos", "value", M, radius=2.0)
    return out.select("series_id", "tag", "pos", F.round("distance", 5).alias("distance"))


GIVEN_SQL = f"""occ AS (SELECT series_id, 1 + pos % 2 AS tag, pos, 0.5 + pos AS distance FROM s WHERE event_id % 17 = 3),
lim AS (SELECT series_id, max(pos) AS last FROM s GROUP BY 1),
fit AS (SELECT occ.* FROM occ JOIN lim USING (series_id) WHERE pos + {M - 1} <= last)"""


def given(spark, sf):
    """Occurrences to describe, wherever a whole window fits."""
    s = events_series(spark, sf)
    last = s.groupBy("series_id").agg(F.max("pos").alias("last"))
    occ = s.where("event_id % 17 = 3").select("series_id", (1 + F.col("pos") % 2).alias("tag"), "pos", (0.5 + F.col("pos")).cast("double").alias("distance"))
    return occ.join(last, on="series_id").where(F.col("pos") + (M - 1) <= F.col("last")).drop("last")


@query("h3_motif_features", f"""WITH {SERIES_SQL}, {GIVEN_SQL} SELECT f.series_id, f.tag AS motif, f.pos AS occurrence, round(avg(value), 6) AS mean, f.tag::DOUBLE AS tag,
round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, any_value(f.distance)::DOUBLE AS distance
FROM fit f JOIN s ON s.series_id = f.series_id AND s.pos BETWEEN f.pos AND f.pos + {M - 1} GROUP BY 1, 2, 3""")
def _(spark, sf):
    out = mt.motif_features(series(spark, sf), ["series_id"], "pos", "value", given(spark, sf), M)
    return out.select("series_id", "motif", "occurrence", r6("mean"), "tag", r6("std"), "min", "max", "distance")


@query("h4_motif_labels", f"WITH {SERIES_SQL}, {GIVEN_SQL} SELECT series_id, tag AS motif, pos AS occurrence, road_label AS label FROM fit JOIN s USING (series_id, pos)")
def _(spark, sf):
    return mt.motif_labels(series(spark, sf), ["series_id"], "pos", "road_label", given(spark, sf))


@query("h5_motif_sweep")
def _(spark, sf):
    """All 36 pairs of the usual radii and lengths."""
    out = mt.sweep_motifs(series(spark, sf), ["series_id"], "pos", "value", "road_label", Settings().radii, Settings().lengths)
    return out.select("series_id", "radius", "length", "motif", "occurrence", r6("mean"), r6("std"), "min", "max", r6("distance"), "label")


@query("h6_motif_inference")
def _(spark, sf):
    out = mt.infer_motifs(series(spark, sf), ["series_id"], "pos", "value", radius=2.0, length=M)
    return out.select("series_id", "motif", "occurrence", r6("mean"), r6("std"), "min", "max", r6("distance"))
