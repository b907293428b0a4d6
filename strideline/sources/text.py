"""Reading headerless, space-separated recordings whose row order matters.

A recording is a file or folder of its own, or its lines stand together in files that many recordings share and
begin with its number.  Shared files are for many short recordings: opening a file costs more than reading a few lines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.materialise import cut

# Columns of a readings file in order.
READING_COLUMNS = [
    "time", "acceleration_x", "acceleration_y", "acceleration_z", "gyroscope_x", "gyroscope_y", "gyroscope_z",
    "magnetometer_x", "magnetometer_y", "magnetometer_z", "orientation_w", "orientation_x", "orientation_y",
    "orientation_z", "gravity_x", "gravity_y", "gravity_z", "linear_acceleration_x", "linear_acceleration_y",
    "linear_acceleration_z",
]
# Place and name of the labels in a label file.
LABEL_COLUMNS = {1: "coarse_label", 2: "fine_label", 3: "road_label"}
#: File splits up to this number are broadcast, about 100 bytes each.
MOST_SPLITS = 1 << 20
#: Folders of shared files; a recording is in the one of its number modulo this.
BUNDLES = 64


def _raw(spark: SparkSession, paths: list[str], width: int, shared: bool = False) -> DataFrame:
    fields = [T.StructField("_trip", T.LongType())] * shared + [T.StructField("_0", T.LongType())]
    fields += [T.StructField(f"_{i}", T.DoubleType()) for i in range(1, width)]
    reader = spark.read.schema(T.StructType(fields)).options(sep=" ", header=False, nanValue="NaN")
    return reader.csv(paths).select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mid"),
    )


def _with_positions(rows: DataFrame, series: list[str], use_rows: tuple[int, int] | None = None, shared: bool = False) -> DataFrame:
    """0-based row number per series in file order, without moving the rows.

    Rows of one file split are read in order, so the position is the number of rows in the
    splits before it plus the distance to the first row of the split.  One pass counts the rows of each
    split; the table of splits, one row per 128 MB of text or so, is broadcast if its counted size allows.
    With ``use_rows`` only splits that reach into the range stay in it, and rows of the others end at the join.
    Splits of ``shared`` files hold many series, each in one piece; then the table has a row per series and is not broadcast.
    """
    where = [*series, "_file", "_start"]
    if shared:
        where = [*series, "_split"]
        rows = rows.withColumn("_split", F.xxhash64("_file", "_start"))
    place = [F.min(c).alias(c) for c in ("_file", "_start") if c not in where]
    splits = rows.groupBy(*where).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"), *place)
    before = Window.partitionBy(*series).orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    if use_rows is not None:
        start, count = use_rows
        offsets = offsets.where((F.col("_offset") < start + count) & (F.col("_offset") + F.col("_n") > start))
    offsets = offsets.drop("_n", *(["_file", "_start"] if shared else []))
    few = not shared and offsets.count() <= MOST_SPLITS
    placed = (
        rows.join(F.broadcast(offsets) if few else offsets, on=where, how="inner")
        .withColumn("pos", F.col("_offset") + F.col("_mid") - F.col("_first"))
        .drop("_file", "_start", "_split", "_mid", "_first", "_offset")
    )
    return placed if use_rows is None else placed.where((F.col("pos") >= start) & (F.col("pos") < start + count))


def _pick(use_columns: list[int] | None, column_names: list[str] | None, width: int) -> dict[str, str]:
    chosen = list(range(width)) if use_columns is None else list(use_columns)
    if not chosen or max(chosen) >= width:
        raise ValueError(f"columns {chosen} are not all among the {width} of the file")
    names = [f"_{i}" for i in chosen] if column_names is None else list(column_names)
    if len(names) != len(chosen):
        raise ValueError(f"{len(chosen)} columns but {len(names)} names")
    return dict(zip(names, (f"_{i}" for i in chosen)))


def read_recording(
    spark: SparkSession, path: str, width: int = len(READING_COLUMNS), column_names: list[str] | None = None,
    use_rows: tuple[int, int] | None = None, use_columns: list[int] | None = None, trip: int | None = None,
) -> DataFrame:
    """One recording as ``pos`` and the chosen columns.

    ``use_rows`` is (first row, number of rows); the first column is an integer, the rest
    are doubles.  ``trip`` picks the recording of that number from files that many share.
    """
    if not isinstance(path, str):
        raise TypeError("path must be a string")
    picked = _pick(use_columns, column_names, width)
    lines = _raw(spark, [path], width) if trip is None else _raw(spark, [path], width, True).where(F.col("_trip") == trip).drop("_trip")
    rows = _with_positions(lines, [], use_rows)
    return rows.select("pos", *[F.col(c).alias(n) for n, c in picked.items()])


def read_trips(
    spark: SparkSession, template: str, identifiers: list[str] | DataFrame, width: int = len(READING_COLUMNS),
    column_names: list[str] | None = None, use_columns: list[int] | None = None,
) -> DataFrame:
    """Many recordings in one scan: ``series_id`` (place in ``identifiers``), ``pos`` and columns.

    ``template`` has one ``{}`` for the identifier of the trip.  With a table ``(trip, series_id)`` for identifiers it is
    the folder of files that the recordings of these numbers share.
    """
    if isinstance(identifiers, DataFrame):
        picked = _pick(use_columns, column_names, width)
        placed = _with_positions(_raw(spark, [template], width, True), ["_trip"], shared=True)
        trips = identifiers.select(F.col("trip").alias("_trip"), "series_id")
        return placed.join(trips, on="_trip", how="inner").select("series_id", "pos", *[F.col(c).alias(n) for n, c in picked.items()])
    if not isinstance(identifiers, list) or template.count("{}") != 1:
        raise TypeError("a template with one {} and a list of identifiers are needed")
    picked = _pick(use_columns, column_names, width)
    head, tail = template.split("{}")
    anchor = re.escape(head.rsplit("/", 2)[-2] + "/" + head.rsplit("/", 1)[-1]) if "/" in head else re.escape(head)
    rows = _raw(spark, [template.format(i) for i in identifiers], width)
    named = rows.withColumn("_trip", F.regexp_extract("_file", f"{anchor}([^/]+){re.escape(tail)}", 1))
    # The list of trips comes from the caller, so it is small.
    trips = spark.createDataFrame([(str(t), i) for i, t in enumerate(identifiers)], "_trip string, series_id int")
    placed = named.join(F.broadcast(trips), on="_trip", how="inner").drop("_trip")
    return _with_positions(placed, ["series_id"]).select(
        "series_id", "pos", *[F.col(c).alias(n) for n, c in picked.items()]
    )


def shared_folder_of(root: str, trip: int | None = None) -> str:
    """Where :func:`write_shared_trips` puts a recording, or all of them."""
    return root if trip is None else f"{root}/bundle={trip % BUNDLES}"


def write_shared_trips(df: DataFrame, trip: str, order: list[str], columns: list[str], root: str) -> None:
    """All recordings in ``BUNDLES`` folders, whatever their number; the lines of one stand together in order."""
    placed = df.select(F.pmod(F.col(trip), F.lit(BUNDLES)).cast("int").alias("bundle"), F.col(trip).alias("_trip"), *order, *columns)
    ordered = placed.repartitionByRange("bundle", "_trip", *order).sortWithinPartitions("bundle", "_trip", *order)
    lines = ordered.select("bundle", "_trip", *columns)
    lines.write.partitionBy("bundle").mode("overwrite").options(sep=" ", header=False).csv(root)


def write_fixed_text(df: DataFrame, order: list[str], label: str, axes: list[str], path: str) -> None:
    """Rows as ``label axis axis ...``: the label as an integer, axes with six decimals."""
    fixed_text(df, order, label, axes).write.mode("overwrite").text(path)


def fixed_text(df: DataFrame, order: list[str], label: str, axes: list[str]) -> DataFrame:
    complete = df.na.drop("any", subset=[label, *axes])
    pattern = " ".join(["%d"] + ["%1.6f"] * len(axes))
    line = F.format_string(pattern, F.col(label).cast("bigint"), *[F.col(a).cast("double") for a in axes])
    return complete.select(*order, line.alias("value")).orderBy(*order).select("value")
