"""Token counts of whole texts; huge ones in overlapping chunks that are spliced exactly.

A border between characters is stable when no entry of the vocabulary can reach across it: a
space behind another character, as long as no entry holds a space behind something else.
That is read off the vocabulary once.  A huge text is encoded in chunks that overlap; two
neighbours are spliced at a stable border of the overlap that both encodings have.  Without
one the overlap is widened until there is one or the text ends.

Cases: a null text counts as empty and has no tokens; an empty table gives no rows; repeated
rows are counted each; other columns are not looked at; a text without any stable border is
encoded in one piece.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_LOADED: dict[str, tuple[sentencepiece.SentencePieceProcessor, bool]] = {}


def model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """The worker's model and whether its spaces only lead entries."""
    if path not in _LOADED:
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        _LOADED[path] = m, not any(SPACE in m.id_to_piece(i).lstrip(SPACE) for i in range(m.get_piece_size()))
    return _LOADED[path]


def _starts(m, text: str) -> list[int]:
    """First characters of the tokens of a text, ascending."""
    return sorted(begin for begin, _ in m.encode(text, return_type="offset_mapping")["offsets"])


def count_spliced(text: str, m, spaces_lead: bool, chunk: int, overlap: int) -> int:
    """Tokens of a text, from chunks of about ``chunk`` characters."""
    stable = re.compile(rf"(?<=[^ {SPACE}]) ")
    if not spaces_lead:
        return len(m.encode(text))
    total, spliced, start, stop = 0, 0, 0, min(chunk, len(text))
    here = _starts(m, text[:stop])
    while stop < len(text):
        width = overlap
        while True:
            lead = max(stop - width, spliced)
            beyond = min(max(lead + chunk, stop + overlap), len(text))
            after = _starts(m, text[lead:beyond])
            common = {start + b for b in here} & {lead + b for b in after}
            at = max((c.start() for c in stable.finditer(text, lead + 1, stop) if c.start() in common), default=spliced)
            if at > spliced or stop == len(text):
                break
            width *= 2
            stop = min(stop + width, len(text))
            here = _starts(m, text[start:stop])
        if at == spliced:
            break
        total += bisect_left(here, at - start) - bisect_left(here, spliced - start)
        start, stop, spliced, here = lead, beyond, at, after
    return total + len(here) - bisect_left(here, spliced - start)


def _counts(path: str, chunk: int, overlap: int, step: int = 128):
    def run(batches):
        m, spaces_lead = model(path)
        for batch in batches:
            counts = []
            for i in range(0, batch.num_rows, step):
                texts = [t or "" for t in batch.column(2).slice(i, step).to_pylist()]
                short = iter(m.encode([t for t in texts if len(t) <= chunk], num_threads=1))
                counts += [len(next(short)) if len(t) <= chunk else count_spliced(t, m, spaces_lead, chunk, overlap) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096, chunk: int = 32768, overlap: int = 512,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, n_tokens, over_limit."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(_counts(path, chunk, overlap), "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)
