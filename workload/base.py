"""Registry of queries and the inputs they share.

Every query reads the given tables in full.  ``SERIES_SQL`` and ``AXES_SQL`` say in plain
SQL what the Spark builders next to them produce.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.ordering import int_div, positions_by_time

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BLOCK_ROWS = 30


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column, name: str | None = None):
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c, 6)
    return out.alias(name or column) if isinstance(column, str) or name else out


# --- labelled series from events -------------------------------------------------------

SERIES_SQL = """
s AS (
  SELECT user_id AS series_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         epoch_us(ts) AS t_us,
         event_id,
         value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CASE event_type WHEN 'click' THEN 5.0 WHEN 'view' THEN 5.0 WHEN 'purchase' THEN 2.0
                         WHEN 'error' THEN NULL ELSE 6.0 END::DOUBLE AS coarse_label,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) < 50 THEN 1.0 ELSE 3.0 END::DOUBLE AS road_label
  FROM events
)"""


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    coarse = (
        F.when(F.col("event_type").isin("click", "view"), 5.0)
        .when(F.col("event_type") == "purchase", 2.0)
        .when(F.col("event_type") == "error", F.lit(None))
        .otherwise(6.0)
    )
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_id"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("t_us"),
        "event_id",
        "value",
        k.alias("k"),
        coarse.alias("coarse_label"),
        F.when(k < 50, 1.0).otherwise(3.0).alias("road_label"),
    )
    return positions_by_time(rows, ["series_id"], "t_us", ["event_id"])


# --- fixed blocks of the value signal ----------------------------------------------------

BLOCKS_SQL = SERIES_SQL + f""",
b AS (
  SELECT series_id, pos // {BLOCK_ROWS} AS block_id, pos % {BLOCK_ROWS} AS i, t_us,
         value AS x, k, road_label AS label, count(*) OVER (PARTITION BY series_id, pos // {BLOCK_ROWS}) AS n
  FROM s
)"""


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events_series(spark, sf_dir)
    return s.select(
        "series_id", int_div("pos", BLOCK_ROWS).alias("block_id"), (F.col("pos") % BLOCK_ROWS).alias("i"),
        "t_us", F.col("value").alias("x"), "k", F.col("road_label").alias("label"),
    )


BLOCK_KEYS = ["series_id", "block_id"]

# --- three axes from lineitem ------------------------------------------------------------

AXES_SQL = """
a AS (
  SELECT l_suppkey AS series_id, l_orderkey, l_linenumber, l_partkey, l_quantity AS ax,
         l_extendedprice / 997.0 AS ay, l_discount * 100.0 AS az, l_tax AS w
  FROM lineitem
)"""


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("series_id"), "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_quantity").alias("ax"), (F.col("l_extendedprice") / 997.0).alias("ay"),
        (F.col("l_discount") * 100.0).alias("az"), F.col("l_tax").alias("w"),
    )


AXIS_KEYS = ["series_id", "l_orderkey", "l_linenumber", "l_partkey"]
