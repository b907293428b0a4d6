"""Queries over joins, segments, chunks, resampling, splits and simple block features."""

from pyspark.sql import functions as F

from strideline.functions.manual import manual_features
from strideline.materialise import cut
from strideline.operators import combine as cb
from strideline.operators import segments as sm
from strideline.operators import splits as sp
from workload.base import BLOCK_KEYS, BLOCKS_SQL, SERIES_SQL, event_blocks, events_series, query, r6, table


def labelled(spark, sf):
    return events_series(spark, sf).select("series_id", "pos", "t_us", "value", "k", "coarse_label", "road_label")


# --- joins -----------------------------------------------------------------------------


@query("d1_label_readings", f"WITH {SERIES_SQL} SELECT series_id, pos, coarse_label, road_label, value FROM s")
def _(spark, sf):
    s = labelled(spark, sf)
    return cb.label_readings(s.select("series_id", "pos", "coarse_label", "road_label"), s.select("series_id", "pos", "value"))


@query("d2_join_complete", f"""WITH {BLOCKS_SQL},
f AS (SELECT series_id, block_id, max(x) AS peak FROM b WHERE x > 20 GROUP BY 1, 2),
y AS (SELECT series_id, block_id, max(k) AS top FROM b WHERE k > 95 GROUP BY 1, 2)
SELECT series_id, block_id, peak, top FROM f FULL OUTER JOIN y USING (series_id, block_id) WHERE peak IS NOT NULL AND top IS NOT NULL""")
def _(spark, sf):
    b = event_blocks(spark, sf)
    peak = b.where("x > 20").groupBy(*BLOCK_KEYS).agg(F.max("x").alias("peak"))
    top = b.where("k > 95").groupBy(*BLOCK_KEYS).agg(F.max("k").alias("top"))
    return cb.join_complete(peak, top, BLOCK_KEYS)


# Radii and lengths come from the data: the nations of all suppliers.
GRID_SQL = """SELECT a.radius, b.length FROM
(SELECT DISTINCT s_nationkey + 1 AS radius FROM supplier) a,
(SELECT DISTINCT (s_nationkey + 1) * 10 AS length FROM supplier) b"""


@query("d3_parameter_grid", GRID_SQL)
def _(spark, sf):
    codes = table(spark, sf, "supplier").select((F.col("s_nationkey") + 1).alias("radius")).distinct()
    return cb.parameter_grid(codes, codes.select((F.col("radius") * 10).alias("length")))


@query("d4_match_results", """
WITH tr AS (SELECT l_suppkey AS radius, l_linenumber AS length, count(*) AS train_rows FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
te AS (SELECT l_suppkey AS radius, l_linenumber AS length, count(*) AS test_rows FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT radius, length, train_rows, test_rows FROM tr JOIN te USING (radius, length)""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("radius"), F.col("l_linenumber").alias("length"), "l_returnflag")
    side = lambda flag, name: li.where(F.col("l_returnflag") == flag).groupBy("radius", "length").agg(F.count(F.lit(1)).alias(name))
    return cb.match_results(side("A", "train_rows"), side("R", "test_rows"))


@query("d5_keep_flagged", f"""WITH {SERIES_SQL}, ok AS (SELECT series_id, pos FROM s WHERE value < 15)
SELECT 'x' AS frame, series_id, pos, value AS content FROM s SEMI JOIN ok USING (series_id, pos)
UNION ALL SELECT 'y', series_id, pos, road_label FROM s SEMI JOIN ok USING (series_id, pos)""")
def _(spark, sf):
    s = labelled(spark, sf)
    ok = s.where("value < 15").select("series_id", "pos")
    x = cb.keep_flagged(s.select(F.lit("x").alias("frame"), "series_id", "pos", F.col("value").alias("content")), ok, ["series_id", "pos"])
    y = cb.keep_flagged(s.select(F.lit("y").alias("frame"), "series_id", "pos", F.col("road_label").alias("content")), ok, ["series_id", "pos"])
    return cb.union_all([x, y])


@query("d6_union_all", f"""WITH {SERIES_SQL} SELECT series_id, pos, value FROM s WHERE road_label = 1
UNION ALL SELECT series_id, pos, value FROM s WHERE coarse_label = 5 UNION ALL SELECT series_id, pos, value FROM s WHERE pos < 3""")
def _(spark, sf):
    s = labelled(spark, sf)
    cols = ["series_id", "pos", "value"]
    return cb.union_all([s.where(c).select(*cols) for c in ("road_label = 1", "coarse_label = 5", "pos < 3")])


@query("d8_head_rows", f"""WITH {SERIES_SQL} SELECT series_id, pos, value FROM s
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY pos) <= 10""")
def _(spark, sf):
    return cb.head_rows(labelled(spark, sf).select("series_id", "pos", "value"), ["series_id"], "pos", 10)


@query("d8_tail_rows", f"""WITH {SERIES_SQL} SELECT series_id, pos, value FROM s
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY pos DESC) <= 10""")
def _(spark, sf):
    return cb.tail_rows(labelled(spark, sf).select("series_id", "pos", "value"), ["series_id"], "pos", 10)


# --- segments --------------------------------------------------------------------------

RUNS_SQL = SERIES_SQL + """,
f AS (SELECT *, CASE coarse_label WHEN 5 THEN 0 WHEN 2 THEN 1 END AS label_rank FROM s WHERE coarse_label IN (5, 2)),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY series_id, coarse_label ORDER BY pos) AS island FROM f),
runs AS (SELECT series_id, pos, label_rank, min(pos) OVER (PARTITION BY series_id, coarse_label, island) AS run_start FROM g)"""


@query("e1_segment_by_label", f"WITH {RUNS_SQL} SELECT series_id, pos, CAST(label_rank AS BIGINT) AS label_rank, run_start FROM runs")
def _(spark, sf):
    out = sm.segment_by_label(labelled(spark, sf), ["series_id"], "pos", "coarse_label", [5.0, 2.0])
    return out.select("series_id", "pos", F.col("label_rank").cast("bigint").alias("label_rank"), "run_start")


@query("e1_segment_count", f"""WITH {RUNS_SQL} SELECT series_id, CAST(label_rank AS BIGINT) AS label_rank, count(DISTINCT run_start) AS segments
FROM runs GROUP BY 1, 2""")
def _(spark, sf):
    out = sm.segment_by_label(labelled(spark, sf), ["series_id"], "pos", "coarse_label", [5.0, 2.0])
    starts = out.where(F.col("pos") == F.col("run_start"))
    return starts.groupBy("series_id", F.col("label_rank").cast("bigint").alias("label_rank")).agg(F.count(F.lit(1)).alias("segments"))


NESTED_SQL = SERIES_SQL + """,
o AS (SELECT *, pos - row_number() OVER (PARTITION BY series_id ORDER BY pos) AS island FROM s WHERE coarse_label = 5),
o2 AS (SELECT *, min(pos) OVER (PARTITION BY series_id, island) AS outer_start,
              CASE road_label WHEN 3 THEN 0 WHEN 1 THEN 1 END AS inner_rank FROM o),
n AS (SELECT *, pos - row_number() OVER (PARTITION BY series_id, outer_start, road_label ORDER BY pos) AS island2 FROM o2),
nested AS (SELECT series_id, pos, t_us, value, k, road_label, outer_start, CAST(inner_rank AS BIGINT) AS inner_rank,
                  min(pos) OVER (PARTITION BY series_id, outer_start, road_label, island2) AS inner_start FROM n)"""


def nested(spark, sf):
    out = sm.segment_nested(labelled(spark, sf), ["series_id"], "pos", "coarse_label", [5.0], "road_label", [3.0, 1.0])
    return out.withColumn("inner_rank", F.col("inner_rank").cast("bigint"))


@query("e2_segment_nested", f"WITH {NESTED_SQL} SELECT series_id, pos, outer_start, inner_rank, inner_start FROM nested")
def _(spark, sf):
    return nested(spark, sf).select("series_id", "pos", "outer_start", "inner_rank", "inner_start")


def chunk_sql(length: int) -> str:
    return f"""{SERIES_SQL},
c AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM s),
c2 AS (SELECT *, n // (n // {length} + 1) AS q, n % (n // {length} + 1) AS r FROM c),
ch AS (SELECT series_id, pos, value, k, road_label, coarse_label,
  CASE WHEN pos < r * (q + 1) THEN pos // (q + 1) ELSE r + (pos - r * (q + 1)) // greatest(q, 1) END AS chunk,
  CASE WHEN pos < r * (q + 1) THEN q + 1 ELSE q END AS chunk_size FROM c2)"""


@query("e3_chunk_evenly", f"WITH {chunk_sql(15)} SELECT series_id, pos, chunk, chunk_size FROM ch")
def _(spark, sf):
    out = sm.segment_fixed(labelled(spark, sf), ["series_id"], "pos", 15)
    return out.select("series_id", "pos", "chunk", "chunk_size")


@query("e4_exact_chunks", f"""WITH {chunk_sql(15)},
z AS (SELECT *, count(*) OVER (PARTITION BY series_id, chunk) AS m FROM ch) SELECT series_id, pos, chunk FROM z WHERE m = 15""")
def _(spark, sf):
    return sm.segment_fixed(labelled(spark, sf), ["series_id"], "pos", 15, exact=True).select("series_id", "pos", "chunk")


@query("e5_chunk_means", f"""WITH {chunk_sql(15)} SELECT series_id, chunk, round(avg(value), 6) AS value, round(avg(k), 6) AS k
FROM ch WHERE chunk_size = 15 GROUP BY 1, 2""")
def _(spark, sf):
    out = sm.segment_fixed(labelled(spark, sf), ["series_id"], "pos", 15, aggregate=True, exact=True, columns=["value", "k"])
    return out.select("series_id", "chunk", r6("value"), r6("k"))


@query("e6_desegment", f"""WITH {NESTED_SQL} SELECT series_id, row_number() OVER (PARTITION BY series_id
ORDER BY outer_start, inner_rank, inner_start, pos) - 1 AS new_pos, value, road_label FROM nested""")
def _(spark, sf):
    out = sm.desegment(cut(nested(spark, sf)), ["series_id"], [["outer_start"], ["inner_rank"], ["inner_start"]], "pos", ["value", "road_label"], "new_pos")
    return out.select("series_id", "new_pos", "value", "road_label")


HOUR = 3_600_000_000


def resample_sql(fn: str, empty: str) -> str:
    return f"""{SERIES_SQL},
v AS (SELECT series_id, t_us // {6 * HOUR} AS bin, {fn}(value) AS value, {fn}(k) AS k FROM s GROUP BY 1, 2),
e AS (SELECT series_id, unnest(range(min(bin), max(bin) + 1)) AS bin FROM v GROUP BY 1)
SELECT series_id, bin * {6 * HOUR} AS bin_us, round(coalesce(value, {empty}), 6) AS value, round(coalesce(k, {empty}), 6) AS k
FROM e LEFT JOIN v USING (series_id, bin)"""


@query("e7_resample_mean", f"WITH {resample_sql('avg', 'NULL')}")
def _(spark, sf):
    out = sm.resample(labelled(spark, sf), ["series_id"], "t_us", "6h", ["value", "k"])
    return out.select("series_id", "bin_us", r6("value"), r6("k"))


@query("e7_resample_mean_per_segment", f"""WITH {NESTED_SQL},
v AS (SELECT series_id, inner_start, t_us // {2 * HOUR} AS bin, avg(value) AS value FROM nested GROUP BY 1, 2, 3),
e AS (SELECT series_id, inner_start, unnest(range(min(bin), max(bin) + 1)) AS bin FROM v GROUP BY 1, 2)
SELECT series_id, inner_start, bin * {2 * HOUR} AS bin_us, round(value, 6) AS value FROM e LEFT JOIN v USING (series_id, inner_start, bin)""")
def _(spark, sf):
    out = sm.resample(nested(spark, sf), ["series_id", "inner_start"], "t_us", "2h", ["value"])
    return out.select("series_id", "inner_start", "bin_us", r6("value"))


@query("e8_resample_sum", f"WITH {resample_sql('sum', '0')}")
def _(spark, sf):
    out = sm.resample(labelled(spark, sf), ["series_id"], "t_us", "6h", ["value", "k"], mode="sum")
    return out.select("series_id", "bin_us", r6("value"), r6("k"))


HOMOGENEOUS_SQL = chunk_sql(3) + """,
h AS (SELECT * FROM (SELECT *, min(coarse_label) OVER w AS lo, max(coarse_label) OVER w AS hi FROM ch WINDOW w AS (PARTITION BY series_id, chunk)) WHERE lo = hi)"""


def homogeneous(spark, sf):
    chunks = sm.chunk_evenly(labelled(spark, sf), ["series_id"], "pos", 3)
    return sm.homogeneous_chunks(chunks, ["series_id"], "chunk", "coarse_label")


@query("e9_homogeneous_chunks", f"WITH {HOMOGENEOUS_SQL} SELECT series_id, pos, chunk, coarse_label FROM h")
def _(spark, sf):
    return homogeneous(spark, sf).select("series_id", "pos", "chunk", "coarse_label")


NUMBERED_SQL = HOMOGENEOUS_SQL + """,
nb AS (SELECT *, idx // 5 AS block_id FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS idx FROM h))"""


def numbered(spark, sf):
    return sm.number_blocks(homogeneous(spark, sf), ["series_id"], "pos", 5)


@query("e10_number_blocks", f"WITH {NUMBERED_SQL} SELECT series_id, pos, idx, block_id FROM nb")
def _(spark, sf):
    return numbered(spark, sf).select("series_id", "pos", "idx", "block_id")


@query("e11_majority_label", f"""WITH {NUMBERED_SQL},
m AS (SELECT series_id, block_id, coarse_label, count(*) AS n, min(idx) AS f FROM nb WHERE coarse_label IS NOT NULL GROUP BY 1, 2, 3)
SELECT series_id, block_id, coarse_label AS label FROM m QUALIFY row_number() OVER (PARTITION BY series_id, block_id ORDER BY n DESC, f) = 1""")
def _(spark, sf):
    return sm.majority_label(numbered(spark, sf), BLOCK_KEYS, "coarse_label", "idx")


# --- splits ----------------------------------------------------------------------------

ROWS_SQL = SERIES_SQL + """,
o AS (SELECT *, row_number() OVER (ORDER BY series_id, pos) - 1 AS row, count(*) OVER () AS n FROM s)"""


def rowed(spark, sf):
    return sp.global_index(labelled(spark, sf), "series_id", "pos")


@query("e12_split_three", f"""WITH {ROWS_SQL} SELECT series_id, pos, CASE WHEN row >= n - floor(n * 0.25) THEN 'valid'
WHEN row >= n - floor(n * 0.25) - floor(n * 0.25) THEN 'test' WHEN row < floor(n * 0.5) THEN 'train' END AS part FROM o WHERE part IS NOT NULL""")
def _(spark, sf):
    return sp.split_three(rowed(spark, sf), "row").select("series_id", "pos", "part")


@query("e13_split_two", f"""WITH {ROWS_SQL} SELECT 'last' AS cut, series_id, pos, CASE WHEN row >= n - floor(n * 0.3) THEN 'valid' ELSE 'train' END AS part FROM o
UNION ALL SELECT 'first', series_id, pos, CASE WHEN row < floor(n * 0.1) THEN 'test' ELSE 'train' END FROM o""")
def _(spark, sf):
    rows = rowed(spark, sf).select("series_id", "pos", "row")
    last = sp.split_two(rows, "row", 0.3, True, ("valid", "train")).select(F.lit("last").alias("cut"), "series_id", "pos", "part")
    first = sp.split_two(rows, "row", 0.1, False, ("test", "train")).select(F.lit("first").alias("cut"), "series_id", "pos", "part")
    return last.unionByName(first)


@query("e14_class_shares", f"""WITH {SERIES_SQL} SELECT road_label, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM s WHERE coarse_label = 5 GROUP BY 1""")
def _(spark, sf):
    out = sp.class_shares(labelled(spark, sf).where("coarse_label = 5"), "road_label", [1.0, 3.0])
    return out.select("road_label", "rows", r6("share"))


@query("e15_balanced_split", f"""WITH {SERIES_SQL},
lc AS (SELECT series_id, count(*) FILTER (road_label = 3) AS hits, count(*) AS rows FROM s WHERE coarse_label = 5 AND road_label IN (1, 3) GROUP BY 1),
t AS (SELECT count(*) AS ns, sum(hits)::DOUBLE / sum(rows) AS second FROM lc),
u AS (SELECT lc.*, seed, (series_id * 48271 + seed * 69621 + 12345) % 2147483647 AS m FROM lc, (SELECT unnest(range(64)) AS seed)),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY (m * m) % 2147483647, series_id) - 1 AS rk FROM u),
p AS (SELECT seed, CASE WHEN rk < floor(ns * 0.5) THEN 0 WHEN rk < floor(ns * 0.75) THEN 1 ELSE 2 END AS part, hits, rows, second FROM r, t),
g AS (SELECT seed, second, sum(hits) FILTER (part = 0)::DOUBLE / sum(rows) FILTER (part = 0) AS train_share,
  sum(hits) FILTER (part = 1)::DOUBLE / sum(rows) FILTER (part = 1) AS test_share,
  sum(hits) FILTER (part = 2)::DOUBLE / sum(rows) FILTER (part = 2) AS valid_share FROM p GROUP BY 1, 2),
b AS (SELECT *, least(second, 1 - second) - (seed + 1) / 20000.0 AS lo, greatest(second, 1 - second) + (seed + 1) / 20000.0 AS hi FROM g)
SELECT seed, round(train_share, 6) AS train_share, round(test_share, 6) AS test_share, round(valid_share, 6) AS valid_share,
  train_share > lo AND train_share < hi AND test_share > lo AND test_share < hi AND valid_share > lo AND valid_share < hi AS accepted FROM b""")
def _(spark, sf):
    s = labelled(spark, sf).where("coarse_label = 5")
    counts = sp.series_label_counts(s, "series_id", "road_label", [1.0, 3.0], 3.0)
    out = sp.try_splits(counts, "series_id", "hits", "rows", 0, 64)
    return out.select("seed", r6("train_share"), r6("test_share"), r6("valid_share"), "accepted")


@query("e15_assigned_split", f"""WITH {SERIES_SQL},
lc AS (SELECT series_id, count(*) FILTER (road_label = 3) AS hits, count(*) AS rows FROM s WHERE coarse_label = 5 AND road_label IN (1, 3) GROUP BY 1),
t AS (SELECT count(*) AS ns, sum(hits)::DOUBLE / sum(rows) AS second FROM lc),
u AS (SELECT lc.*, seed, (series_id * 48271 + seed * 69621 + 12345) % 2147483647 AS m FROM lc, (SELECT unnest(range(20000)) AS seed)),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY (m * m) % 2147483647, series_id) - 1 AS rk FROM u),
p AS (SELECT seed, series_id, CASE WHEN rk < floor(ns * 0.5) THEN 0 WHEN rk < floor(ns * 0.75) THEN 1 ELSE 2 END AS part, hits, rows, second FROM r, t),
g AS (SELECT seed, part, second, sum(hits)::DOUBLE / sum(rows) AS share FROM p GROUP BY 1, 2, 3),
w AS (SELECT min(seed) AS seed FROM (SELECT seed FROM g GROUP BY seed HAVING count(*) = 3
  AND bool_and(share > least(second, 1 - second) - (seed + 1) / 20000.0 AND share < greatest(second, 1 - second) + (seed + 1) / 20000.0)))
SELECT series_id, ['train', 'test', 'valid'][part + 1] AS part, CAST(seed AS BIGINT) AS seed FROM p JOIN w USING (seed)""")
def _(spark, sf):
    """The search to its end, and the parts that the accepted shuffle gives."""
    s = labelled(spark, sf).where("coarse_label = 5")
    counts = sp.series_label_counts(s, "series_id", "road_label", [1.0, 3.0], 3.0)
    found = sp.find_balanced_split(counts, "series_id", "hits", "rows")
    parts = sp.assign_parts(counts.select("series_id"), "series_id", found["seed"] if found else 0)
    return parts.select("series_id", "part", F.lit(found["seed"] if found else 0).cast("bigint").alias("seed")).where(F.lit(found is not None))


HASHED_SQL = """hs AS (SELECT vec_id, label, ((vec_id * 48271 + {seed} * 69621 + 12345) % 2147483647) AS m FROM embeddings),
hr AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY (m * m) % 2147483647, vec_id) - 1 AS rk,
       count(*) OVER (PARTITION BY label) AS n FROM hs)"""


@query("e16_stratified_split", f"WITH {HASHED_SQL.format(seed=1)} SELECT vec_id, label, CASE WHEN rk < floor(n * 0.3) THEN 'test' ELSE 'train' END AS part FROM hr")
def _(spark, sf):
    return sp.stratified_split(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.3, seed=1)


@query("e17_stratified_folds", f"WITH {HASHED_SQL.format(seed=2)} SELECT vec_id, label, CAST(rk % 5 AS INTEGER) AS fold FROM hr")
def _(spark, sf):
    return sp.stratified_folds(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 5, seed=2)


# --- simple features of a block ----------------------------------------------------------

MANUAL_SQL = f"""WITH {BLOCKS_SQL} SELECT series_id, block_id, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
round({{var}}, 6) AS var, max(x) AS max FROM b GROUP BY 1, 2"""


@query("f1_f4_manual_features", MANUAL_SQL.format(var="var_samp(x)"))
def _(spark, sf):
    out = manual_features(event_blocks(spark, sf), BLOCK_KEYS, "x")
    return out.select(*BLOCK_KEYS, r6("mean"), r6("std"), r6("var"), "max")


@query("f3_manual_root_of_deviation", MANUAL_SQL.format(var="sqrt(stddev_samp(x))"))
def _(spark, sf):
    out = manual_features(event_blocks(spark, sf), BLOCK_KEYS, "x", root_of_deviation=True)
    return out.select(*BLOCK_KEYS, r6("mean"), r6("std"), r6("var"), "max")


@query("f5_block_label", f"""WITH {BLOCKS_SQL},
m AS (SELECT series_id, block_id, label, count(*) AS n, min(i) AS f FROM b GROUP BY 1, 2, 3)
SELECT series_id, block_id, label FROM m QUALIFY row_number() OVER (PARTITION BY series_id, block_id ORDER BY n DESC, f) = 1""")
def _(spark, sf):
    return sm.majority_label(event_blocks(spark, sf), BLOCK_KEYS, "label", "i")
