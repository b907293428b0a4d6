"""From raw documents to packed training sequences.

Each stage gets all rows that the one before it kept, as Parquet; all but the last return the
columns of ``documents``.

Cases: a null or empty text fails the quality rules.  Of rows with equal texts the one with the largest
id stays, of rows equal in id and text one; an id with different texts keeps each of them, and so does
a null id.  Of linked documents those of the smallest id stay, rows with a null id link with nothing and stay.
Documents of two epochs come twice, and so do their pieces.  An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strideline.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from strideline.llm.queries import EPOCHS, PERCENT, SEED, TARGETS, documents, mixture_path
from strideline.materialise import stored

#: Pieces whose ids a worker of the last stage keeps; it stays alive beside the other stages.
MOST_PIECES = 400_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules pass."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that n-gram links connect the one with the smallest id."""
    return ngram_join.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at their target weights; a document of two epochs comes twice."""
    return mixing.mix(docs, mixture_path(), TARGETS, PERCENT, EPOCHS, SEED).select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and places in sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), most_pieces=MOST_PIECES)


STAGES = [
    ("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near),
    ("mixing to target weights", mixture), ("best-fit packing", sequences),
]

#: Links, components and tokenizer ids can't be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
