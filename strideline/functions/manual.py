"""The short hand-picked feature set of a block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.functions.scalar import known


def manual_features(df: DataFrame, keys: list[str], value: str, root_of_deviation: bool = False) -> DataFrame:
    """Mean, deviation, variance and maximum of each block.

    ``root_of_deviation`` puts the square root of the deviation in place of the variance.
    """
    x = known(value)
    third = F.sqrt(F.stddev_samp(x)) if root_of_deviation else F.var_samp(x)
    return df.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), third.alias("var"), F.max(x).alias("max")
    )
