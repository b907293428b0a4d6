"""Projections, missing values, label filters and axis corrections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.scalar import known, ratio
from strideline.ordering import SLICE_ROWS, attach_stats, with_halo

# Microseconds per unit of an epoch column.
MICROS_PER_UNIT = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "m": 60_000_000,
    "h": 3_600_000_000,
    "D": 86_400_000_000,
}

# Label codes of the recordings.
COARSE_LABELS = {"null": 0, "still": 1, "walk": 2, "run": 3, "bike": 4, "car": 5, "bus": 6, "train": 7, "subway": 8}
ROAD_LABELS = {"null": 0, "city": 1, "motorway": 2, "countryside": 3, "dirt": 4}


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the data: {missing}")


def select_named(df: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """Keep ``columns`` in the given order under new ``names``."""
    require_columns(df, columns)
    if len(columns) != len(names):
        raise ValueError(f"{len(columns)} columns but {len(names)} names")
    return df.select(*[F.col(c).alias(n) for c, n in zip(columns, names)])


def epoch_to_timestamp(df: DataFrame, column: str, unit: str = "ms") -> DataFrame:
    """Integer epoch to a zone-free timestamp; nanoseconds are cut to microseconds."""
    if unit == "ns":
        micros = F.expr(f"`{column}` div 1000L")
    elif unit in MICROS_PER_UNIT:
        micros = F.col(column).cast("bigint") * F.lit(MICROS_PER_UNIT[unit])
    else:
        raise ValueError(f"unknown time unit {unit!r}")
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return df.withColumn(column, F.timestamp_add("MICROSECOND", micros, epoch))


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows where any of the columns is null or NaN."""
    return df.na.drop("any", subset=columns)


def fill_mean(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """Replace null and NaN by the mean of the known values."""
    require_columns(df, columns)
    keys = list(keys)
    means = df.groupBy(*keys).agg(*[F.avg(known(c)).alias(f"_mean_{c}") for c in columns])
    joined = attach_stats(df, means, keys)
    filled = {c: F.coalesce(known(c), F.col(f"_mean_{c}")) for c in columns}
    return joined.withColumns(filled).select(*df.columns)


def fill_value(df: DataFrame, value: float, columns: list[str]) -> DataFrame:
    require_columns(df, columns)
    return df.withColumns({c: F.coalesce(known(c), F.lit(float(value))) for c in columns})


def remove_missing(
    df: DataFrame, mode: str, columns: list[str] | None = None, value: float | None = None
) -> DataFrame:
    """The three replacement modes under one name."""
    numeric = columns or [c for c, t in df.dtypes if t in ("double", "float")]
    if mode == "del_row":
        return drop_missing(df, columns)
    if mode == "mean":
        return fill_mean(df, numeric)
    if mode == "replacement_val":
        if value is None:
            raise TypeError("replacement_val needs a value")
        return fill_value(df, value, numeric)
    raise ValueError(f"unknown mode {mode!r}")


def drop_labels(df: DataFrame, unwanted: dict[str, list]) -> DataFrame:
    """Drop rows that carry an unwanted label; a missing label is kept."""
    require_columns(df, list(unwanted))
    for column, values in unwanted.items():
        df = df.where(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))
    return df


def keep_labels(df: DataFrame, wanted: dict[str, list]) -> DataFrame:
    require_columns(df, list(wanted))
    for column, values in wanted.items():
        df = df.where(F.col(column).isin(list(values)))
    return df


def above_two(column: Column) -> Column:
    """1 for codes above two (countryside), 0 otherwise and for missing codes."""
    return F.when(known(column) > 2.0, 1).otherwise(0)


def encode(
    df: DataFrame, columns: list[str], encoding: Callable[[Column], Column] = above_two
) -> DataFrame:
    """Replace each column by ``encoding(column)``."""
    require_columns(df, columns)
    return df.withColumns({c: encoding(F.col(c)) for c in columns})


def remove_gravity(df: DataFrame, axes: list[str], gravity: list[str]) -> DataFrame:
    if len(axes) != len(gravity):
        raise TypeError("one gravity column per axis is needed")
    require_columns(df, axes + gravity)
    return df.withColumns({a: F.col(a) - F.col(g) for a, g in zip(axes, gravity)})


def project_orientation(df: DataFrame, axes: list[str], orientation: list[str], w: str) -> DataFrame:
    """Scale each axis by its orientation component over ``w``; null where ``w`` is zero."""
    if len(axes) != len(orientation):
        raise TypeError("one orientation column per axis is needed")
    require_columns(df, axes + orientation + [w])
    return df.withColumns({a: F.col(a) * ratio(F.col(o), F.col(w)) for a, o in zip(axes, orientation)})


def remove_mean_gravity(
    df: DataFrame, keys: list[str], pos: str, axes: list[str], rows: int, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Subtract the mean of the last ``rows + 1`` readings of each axis."""
    require_columns(df, [*keys, pos, *axes])
    halo = with_halo(df, pos, before=rows, slice_rows=slice_rows)
    w = Window.partitionBy(*keys, "_slice").orderBy(pos).rangeBetween(-rows, 0)
    means = {f"_gravity_{a}": F.avg(a).over(w) for a in axes}
    return (
        halo.withColumns(means)
        .where("_core")
        .withColumns({a: F.col(a) - F.col(f"_gravity_{a}") for a in axes})
        .select(*df.columns)
    )


def project_to_global(df: DataFrame, mode: str, axes: list[str], args: list[str] = (), **options) -> DataFrame:
    if mode == "gravity":
        return remove_gravity(df, axes, list(args))
    if mode == "orientation":
        if len(args) != len(axes) + 1:
            raise TypeError("orientation needs one column per axis and w last")
        return project_orientation(df, axes, list(args[:-1]), args[-1])
    if mode == "mean_estimate_gravity":
        return remove_mean_gravity(df, axes=axes, **options)
    if mode == "gyroscope":
        raise NotImplementedError(mode)
    raise ValueError(f"unknown mode {mode!r}")


def first_of_equal_names(df: DataFrame) -> DataFrame:
    """Keep the first of several columns with the same name."""
    places = [i for i, c in enumerate(df.columns) if c not in df.columns[:i]]
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_{i}").alias(df.columns[i]) for i in places])


def with_series_id(df: DataFrame, series_id: int, name: str = "series_id") -> DataFrame:
    return df.withColumn(name, F.lit(series_id))


def select_features(df: DataFrame, kinds: list[str], keys: list[str]) -> DataFrame:
    """Keep key columns and every column whose name contains one of ``kinds``."""
    return df.select(*keys, *[c for c in df.columns if c not in keys and any(k in c for k in kinds)])


def sample_series(df: DataFrame, key: str, percent: int, seed: int = 0) -> DataFrame:
    """All rows of a repeatable pseudo-random share of the series (key is an integer)."""
    return df.where(portable_hash(F.col(key), F.lit(seed)) % 100 < percent)


def portable_hash(key: Column, seed: Column) -> Column:
    """Hash in [0, 2^31 - 2] that any SQL engine can repeat: a squared congruence."""
    prime = F.lit(2147483647).cast("bigint")
    mixed = (key.cast("bigint") % prime * F.lit(48271) + seed.cast("bigint") * F.lit(69621) + F.lit(12345)) % prime
    return mixed * mixed % prime
