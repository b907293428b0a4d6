"""Cutting the lineage of iterative and multi-stage jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share.

    A session that sets a checkpoint folder by code counts as well.  Only a local session
    without either gets a temporary folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="strideline-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str = "run") -> str:
    """A name in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the cluster's checkpoint folder and continue from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def tasks_for(spark: SparkSession, load: int, share: int) -> int:
    """Tasks that a load needs: one for each share of it, at least one for each core.

    Intermediate tables of short rows go through ``coalesce`` with this number before they are written.  It never makes
    more partitions than there are; where shuffles have many more than the rows need, it saves their small
    files, for each of which a local file system starts several processes.
    """
    return max(spark.sparkContext.defaultParallelism, -(-load // share))


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write the rows as Parquet to the shared folder and read them back.

    Later reads prune columns and push filters down, which a checkpoint can't.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
