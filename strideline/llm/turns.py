"""Conversation turns in order, and digests of long ordered runs.

A conversation may hold any share of all rows.  Its order comes from a range partitioning by
conversation and turn, which cuts long conversations at borders of partitions; nothing gathers
a conversation in one task.  A SHA-256 can only be taken in sequence, so its bytes stream
through one task with a constant amount of memory.

Cases: rows without a turn come first; rows of one turn stand in order of role and of the hash
of the text, with null as one space in both; repeated rows are interchangeable.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.materialise import stored

#: Places are numbered part by part; a part is a partition of the range partitioning.
PART_BITS = 33


def text_key(text: Column) -> Column:
    """Stands for a text of any length in keys."""
    return F.sha2(text.cast("binary"), 256)


def in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``place``, a long that grows in the order of ``keys`` (nulls first), with holes between parts.

    Equal rows are told apart by where they were read, so that a large group of them is spread.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    order = [F.col(k).asc_nulls_first() for k in [*keys, "_tie"]]
    spread = tied.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(spread.drop("_tie").withColumn("place", F.monotonically_increasing_id()), "ordered")


def numbered(ordered: DataFrame, key: str, out: str = "pos") -> DataFrame:
    """Adds the place within ``key`` from 1.  One window row stands for a key's rows of a part."""
    parts = ordered.withColumn("_part", F.shiftright("place", PART_BITS))
    sizes = parts.groupBy(key, "_part").agg(F.count("*").alias("_n"), F.min("place").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col(key).alias("_key"), "_part", (F.coalesce(before, F.lit(0)) + 1 - F.col("_first")).alias("_shift"))
    same = parts[key].eqNullSafe(offsets["_key"]) & (parts["_part"] == offsets["_part"])
    return parts.join(offsets, same).select(*(parts[c] for c in ordered.columns), (F.col("place") + F.col("_shift")).alias(out))


def joined_sha256(ordered: DataFrame, separator: str) -> DataFrame:
    """``(key, sha256)`` of the pieces of each key, joined.

    ``ordered`` is ``(key, piece)``; the rows of a key stand together and in order in one
    partition.  Only the state of one digest is held.
    """
    sep, schema = separator.encode(), ordered.select("key").withColumn("sha256", F.lit("")).schema
    kind = pa.int64() if schema["key"].dataType.simpleString() == "bigint" else pa.string()

    def run(batches):
        now, sha = None, None
        for batch in batches:
            keys, out = [], []
            for key, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if sha is not None and key == now:
                    sha.update(sep)
                else:
                    if sha is not None:
                        keys.append(now)
                        out.append(sha.hexdigest())
                    now, sha = key, hashlib.sha256()
                sha.update(piece.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(out, pa.string())], ["key", "sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([sha.hexdigest()], pa.string())], ["key", "sha256"])

    return ordered.mapInArrow(run, schema)
