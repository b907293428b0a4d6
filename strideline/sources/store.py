"""Tables, models and notes of a run."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_tag(extractor: str, freq: str, reduction: str, block_rows: int) -> str:
    return f"{extractor}_{freq}_{reduction}_{block_rows}"


def write_table(df: DataFrame, root: str, name: str, tag: str | None = None, partition_by: list[str] = ()) -> str:
    """Write a table of a run as Parquet; returns its path."""
    path = f"{root}/{name}" if tag is None else f"{root}/{name}/run_tag={tag}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def read_table(spark: SparkSession, root: str, name: str, tag: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}" if tag is None else f"{root}/{name}/run_tag={tag}")


def write_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_notes(spark: SparkSession, notes: dict, root: str, tag: str) -> None:
    """Statistics, parameters and scores of a run: one row with JSON text."""
    row = spark.createDataFrame([(tag, json.dumps(notes, sort_keys=True))], "tag string, notes string")
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/notes/run_tag={tag}")


def read_notes(spark: SparkSession, root: str, tag: str) -> dict:
    return json.loads(spark.read.parquet(f"{root}/notes/run_tag={tag}").select(F.first("notes")).first()[0])
