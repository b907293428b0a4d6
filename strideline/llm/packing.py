"""Packing documents into sequences by the sum-of-squares rule.

A document's ids end with an end id; only documents longer than a sequence are cut.  Every
task tokenises its documents and packs them in loads of bounded size, longest first: a piece
goes where the squares of the counts of open sequences per remaining gap grow least, with
full sequences leaving the count.  Sequences that stay open are taken apart again, and their
pieces are dealt out to fewer tasks and packed once more, so that small partitions cost
nothing.  The ids move with their pieces; only those of open sequences are shuffled.

Cases: a null or empty text is a document of the end id alone; repeated rows are documents of
their own; a null id is carried along; an empty table gives no rows; other columns are not
looked at.  Of equally good gaps the smallest is taken.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.tokens import encoder
from strideline.materialise import stored

SCHEMA = "doc_id long, piece int, start long, ids binary, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("ids", pa.binary()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64())])

#: Ids that a task holds before it packs them.
LOAD = 3_000_000


def place(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence of each piece and the gaps left; pieces are placed in the order given."""
    never = 1 << 40
    open_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    where, gaps = [], []
    for size in lengths:
        # Growth of the sum of squares when the piece goes to gap size, size + 1, ...
        growth = np.where(count[size:capacity] > 0, 2 * (count[: capacity - size] - count[size:capacity]) + 2, never)
        if size < capacity and count[size]:
            growth[0] = 1 - 2 * count[size]
        best = int(growth.argmin()) if size < capacity else 0
        rest = capacity - size
        if size < capacity and growth[best] < never and growth[best] <= 2 * count[rest] + 1:
            sequence, rest = open_of[size + best].pop(), best
            count[size + best] -= 1
        else:
            sequence = len(gaps)
            gaps.append(0)
        where.append(sequence)
        gaps[sequence] = rest
        if rest:
            open_of[rest].append(sequence)
            count[rest] += 1
    return where, gaps


def _packer(capacity: int, slack: int, level: int):
    """Packs loads of pieces; yields rows, with a null sequence for pieces still open."""
    first, last = (level << 60) + (TaskContext.get().partitionId() << 36), [0]

    def pack(pieces: list[tuple], final: bool) -> tuple[list[tuple], list[tuple]]:
        pieces.sort(key=lambda p: (-len(p[3]), p[0] is None, p[0] or 0, p[1]))
        where, gaps = place([len(p[3]) // 4 for p in pieces], capacity)
        done, left, fill = [], [], [0] * len(gaps)
        for p, s in zip(pieces, where, strict=True):
            if final or gaps[s] <= slack:
                done.append((*p, first + last[0] + s, fill[s]))
                fill[s] += len(p[3]) // 4
            else:
                left.append(p)
        last[0] += len(gaps)
        return done, left

    return pack


def _batches(rows: list[tuple]):
    for i in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 2000], strict=True), _ARROW, strict=True)], schema=_ARROW)


def _loads(pieces, pack, final: bool):
    """Runs ``pack`` whenever a load is full; what stays open joins the next load."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[3]) // 4
        if size >= LOAD:
            done, held = pack(held, False)
            yield from _batches(done)
            left = sum(len(p[3]) // 4 for p in held)
            if left > LOAD // 2:
                done, rest = pack(held, True) if final else ([(*p, None, None) for p in held], [])
                yield from _batches(done)
                held, left = rest, 0
            size = left
    done, left = pack(held, final) if held else ([], [])
    yield from _batches(done + [(*p, None, None) for p in left])


def _tokenised(path: str, split: str, capacity: int, end_id: int, slack: int, most_pieces: int | None):
    def run(batches):
        encode, end = encoder(path, split, most_pieces), array("I", [end_id]).tobytes()
        step = 4 * capacity

        def pieces():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = encode(text.as_py() or "") + end
                    for piece, at in enumerate(range(0, len(ids), step)):
                        yield doc_id, piece, at // 4, ids[at : at + step]

        yield from _loads(pieces(), _packer(capacity, slack, 0), False)

    return run


def _again(capacity: int, slack: int):
    def run(batches):
        pieces = (tuple(r.values())[:4] for batch in batches for r in batch.to_pylist())
        yield from _loads(pieces, _packer(capacity, slack, 1), True)

    return run


def pack(docs: DataFrame, path: str, split: str = "spaces", capacity: int = 2048, end_id: int = 0, slack: int = 8,
         id_col: str = "doc_id", text_col: str = "text", most_pieces: int | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, ids (little-endian 32-bit), sequence_id, offset.

    ``most_pieces`` bounds the pieces of texts whose ids a worker keeps.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    packed = stored(texts.mapInArrow(_tokenised(path, split, capacity, end_id, slack, most_pieces), SCHEMA), "packed")
    still_open = packed.filter("sequence_id IS NULL")
    n = still_open.agg(F.sum(F.octet_length("ids") / 4)).first()[0] or 0
    shards = max(1, round(n / LOAD))
    dealt = (
        still_open.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
        .repartition(shards, "shard").drop("shard").sortWithinPartitions("doc_id", "piece", "ids")
    )
    return packed.filter("sequence_id IS NOT NULL").union(dealt.mapInArrow(_again(capacity, slack), SCHEMA))
