"""Token ids on disk in patched frame-of-reference blocks.

Ids of a document, closed by an end id, follow each other in ascending order of document ids.
A block of 256 ids stores its minimum and the differences to it, packed at a width that a
stated share of them fits; the others are patched from a list of exceptions (place and high
bits).  Whole documents form a segment of bounded size with an index of its block starts.
Segments are rows of Parquet files, which any store takes and a lost task writes again; a
part number and a running count inside the part put them in order.

Layout of a block: minimum (4 bytes), width (1), exceptions (2), packed low bits (32 * width
bytes), places (1 byte each), high bits (4 bytes each); all little-endian.

Cases: a null or empty text is a document of the end id alone; null document ids come first;
rows of one id stand in order of their texts, and
repeated rows are written each; an empty table gives an empty file; other columns are not
looked at.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideline.llm.tokens import encoder

BLOCK, HEAD = 256, 7
SCHEMA = "part int, first long, n_ids long, doc_ids array<long>, lengths array<long>, block_starts array<int>, payload binary"
_ARROW = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("lengths", pa.list_(pa.int64())), ("block_starts", pa.list_(pa.int32())), ("payload", pa.binary())])


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) if by >= 0 else x >> np.uint64(-by)


def packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below ``2 ** width`` as rows of bytes; eight values fill ``width`` bytes."""
    v = values.reshape(len(values), -1, 8).astype(np.uint64)
    out = np.empty((*v.shape[:2], width), np.uint8)
    for k in range(width):
        first, last = 8 * k // width, min(7, (8 * k + 7) // width)
        out[:, :, k] = np.bitwise_or.reduce([_shift(v[:, :, j], j * width - 8 * k) for j in range(first, last + 1)]).astype(np.uint8)
    return out.reshape(len(values), -1)


def unpacked_bits(data: np.ndarray, width: int) -> np.ndarray:
    """The values of :func:`packed_bits`."""
    b = data.reshape(len(data), -1, width).astype(np.uint64)
    out = np.empty((*b.shape[:2], 8), np.uint64)
    for j in range(8):
        first, last = j * width // 8, (j * width + width - 1) // 8
        out[:, :, j] = np.bitwise_or.reduce([_shift(b[:, :, k], 8 * k - j * width) for k in range(first, last + 1)])
    return (out & np.uint64((1 << width) - 1)).reshape(len(data), -1).astype("<u4")


def encode_blocks(ids: np.ndarray, share: int = 90) -> tuple[np.ndarray, bytes]:
    """Starts of the blocks and their bytes; the last block is filled up with its last id."""
    n_blocks = -(-len(ids) // BLOCK)
    x = np.pad(ids.astype("<u4"), (0, n_blocks * BLOCK - len(ids)), mode="edge").reshape(n_blocks, BLOCK)
    least = x.min(axis=1)
    rest = x - least[:, None]
    at = BLOCK * share // 100
    width = np.frexp(np.partition(rest, at, axis=1)[:, at].astype(np.float64))[1].astype(np.int64)
    high = (rest.astype(np.uint64) >> width.astype(np.uint64)[:, None]).astype("<u4")
    row, place = np.nonzero(high)
    n_patches = np.bincount(row, minlength=n_blocks)
    low_end = HEAD + BLOCK // 8 * width
    sizes = low_end + 5 * n_patches
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[starts + 4] = width
    out[starts[:, None] + np.arange(5, 7)] = n_patches.astype("<u2").view(np.uint8).reshape(-1, 2)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        out[(starts[rows] + HEAD)[:, None] + np.arange(BLOCK // 8 * w)] = packed_bits(rest[rows] & np.uint32((1 << int(w)) - 1), int(w))
    # The k-th exception of a block: its place, and its high bits behind all places.
    k = np.arange(len(row)) - np.repeat(np.cumsum(n_patches) - n_patches, n_patches)
    at = (starts + low_end)[row]
    out[at + k] = place
    out[(at + n_patches[row] + 4 * k)[:, None] + np.arange(4)] = high[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return starts.astype(np.int32), out.tobytes()


def decode_blocks(starts: np.ndarray, payload: bytes, n_ids: int) -> np.ndarray:
    """The ids of all blocks; any block can be read alone from its start."""
    data, starts = np.frombuffer(payload, np.uint8), np.asarray(starts, np.int64)
    take = lambda at, n: data[at[:, None] + np.arange(n)]
    least = take(starts, 4).copy().view("<u4").ravel()
    width = data[starts + 4].astype(np.int64)
    n_patches = take(starts + 5, 2).copy().view("<u2").ravel()
    x = np.zeros((len(starts), BLOCK), "<u4")
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        x[rows] = unpacked_bits(take(starts[rows] + HEAD, BLOCK * w // 8), int(w))
    n = n_patches.astype(np.int64)
    row = np.repeat(np.arange(len(starts)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = (starts + HEAD + BLOCK // 8 * width)[row]
    high = take(at + n[row] + 4 * k, 4).copy().view("<u4").ravel()
    x[row, data[at + k]] |= high << width[row].astype(np.uint32)
    return (x + least[:, None]).ravel()[:n_ids]


def _segments(path: str, split: str, end_id: int, most: int, share: int):
    def run(batches):
        encode, end = encoder(path, split), array("I", [end_id]).tobytes()
        part, first = TaskContext.get().partitionId(), 0
        names, held, size = [], [], 0

        def segment():
            starts, payload = encode_blocks(np.frombuffer(b"".join(held), "<u4"), share)
            row = [part, first, size, names, [len(h) // 4 for h in held], starts, payload]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                names.append(doc_id)
                held.append(ids)
                size += len(ids) // 4
                if size >= most:
                    yield segment()
                    first, names, held, size = first + size, [], [], 0
        if held:
            yield segment()

    return run


def write_blocks(docs: DataFrame, folder: str, path: str, split: str = "byte_level", end_id: int = 0, segment: int = 65536,
                 share: int = 90, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all documents to a new folder."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    # Packed ids don't compress further.
    ordered.mapInArrow(_segments(path, split, end_id, segment, share), SCHEMA).write.option("compression", "none").parquet(folder)


def _decoded(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_blocks(row["block_starts"], row["payload"], row["n_ids"]).tobytes()
            n = np.array(row["lengths"], np.int64)
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([row["part"]] * len(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - n),
                pa.array([ids[4 * (e - k) : 4 * e] for e, k in zip(ends, n, strict=True)], pa.binary()),
            ], ["part", "doc_id", "at", "ids"])


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start (ids before it), ids (little-endian 32-bit)."""
    files = spark.read.schema(SCHEMA).parquet(folder)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    docs = files.mapInArrow(_decoded, "part int, doc_id long, at long, ids binary")
    # One row per task that wrote: a few MB for 100,000 tasks.
    return docs.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "ids")
