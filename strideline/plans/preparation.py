"""From labelled readings to one normalised signal.

Input is ``series_id, pos, t_us`` (epoch microseconds), the axes and, for training,
``coarse_label`` and ``road_label``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.materialise import cut
from strideline.operators.combine import label_readings
from strideline.operators.segments import SEGMENT_ORDER, desegment, freq_micros, resample, segment_nested
from strideline.operators.signal import REDUCED, drop_tail, reduce_axes, trim_quantile, znormalize
from strideline.operators.splits import global_index, split_three
from strideline.ordering import SLICE_FANOUT, dense_index, int_div
from strideline.plans.settings import Settings


def split_readings(readings: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Labelled complete readings with ``part``: train, test or valid by position."""
    joined = label_readings(labels, readings).select(
        "series_id", "pos", "t_us", *settings.axes, "coarse_label", "road_label"
    )
    complete = cut(joined.na.drop("any"))
    indexed = dense_index(complete, ["series_id"], "pos", "_index", settings.slice_rows)
    rows = global_index(indexed, "series_id", "_index", "_row")
    return split_three(rows, "_row", *settings.shares).drop("_index", "_row")


def segment_signal(parts: DataFrame, settings: Settings) -> DataFrame:
    """Label runs, resampled and reduced to one axis, laid end to end within each part."""
    runs = cut(segment_nested(
        parts, ["part", "series_id"], "pos", "coarse_label", settings.coarse_labels, "road_label",
        settings.road_labels, settings.slice_rows,
    ))
    segment = ["part", "series_id", *SEGMENT_ORDER]
    bins = resample(runs, segment, "t_us", settings.freq, [*settings.axes, "road_label"])
    reduced = reduce_axes(bins, settings.reduction, settings.axes, REDUCED, keys=segment)
    numbered = reduced.withColumn("_bin", int_div("bin_us", freq_micros(settings.freq))).withColumn(
        "_super", int_div("series_id", SLICE_FANOUT)
    )
    levels = [["outer_rank"], ["_super"], ["series_id"], ["outer_start"], ["inner_rank"], ["inner_start"]]
    return desegment(cut(numbered), ["part"], levels, "_bin", [REDUCED, "road_label"], "cell").select(
        "part", "series_id", "cell", REDUCED, "road_label"
    )


def prepare_training(
    readings: DataFrame, labels: DataFrame, settings: Settings
) -> tuple[DataFrame, dict[str, float]]:
    """Rows ``part, series_id, idx, acceleration_abs, road_label`` and the training statistics.

    All parts are normalised with the mean and deviation of the training part, trimmed to
    their own central quantiles and shortened by two rows.
    """
    signal = cut(segment_signal(split_readings(readings, labels, settings), settings))
    _train, stats = znormalize(signal.where("part = 'train'"), [REDUCED])
    values = stats.first().asDict()
    frozen = signal.sparkSession.createDataFrame([values], stats.schema)
    normal, _ = znormalize(signal, [REDUCED], stats=frozen)
    kept = cut(trim_quantile(normal, [REDUCED], settings.quantile, ["part"]))
    indexed = dense_index(kept, ["part"], "cell", "idx", settings.slice_rows)
    shortened = drop_tail(indexed, ["part"], "idx", 2)
    return cut(shortened.select("part", "series_id", "idx", REDUCED, "road_label")), values


def prepare_inference(readings: DataFrame, stats: dict[str, float], settings: Settings) -> DataFrame:
    """Rows ``series_id, idx, acceleration_abs`` of new readings, normalised with stored statistics.

    Trips are resampled one by one.
    """
    complete = readings.select("series_id", "pos", "t_us", *settings.axes).na.drop("any")
    bins = resample(complete, ["series_id"], "t_us", settings.freq, settings.axes)
    reduced = reduce_axes(bins, settings.reduction, settings.axes, REDUCED, keys=["series_id"])
    frozen = readings.sparkSession.createDataFrame([stats])
    normal, _ = znormalize(reduced, [REDUCED], stats=frozen)
    numbered = cut(normal.withColumn("_bin", int_div("bin_us", freq_micros(settings.freq))).withColumn(
        "_super", int_div("series_id", SLICE_FANOUT)
    ))
    laid = desegment(numbered, [], [["_super"], ["series_id"]], "_bin", [REDUCED], "cell")
    kept = cut(trim_quantile(laid, [REDUCED], settings.quantile).select("series_id", "cell", REDUCED))
    indexed = dense_index(kept, [], "cell", "idx", settings.slice_rows)
    return drop_tail(indexed, [], "idx", 1).select("series_id", "idx", REDUCED)
