"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text, lower-cased in A-Z, is cut where its content says so; its recipe is the ordered list
of chunk hashes.  Recipes that occur once settle their documents without any movement of
text.  Chunks of the others are deduplicated and compared byte by byte; where different
chunks share a hash they get numbers, and a document notes the numbers of such chunks.
Documents are equal when recipe and notes are.

Cases: a null text counts as empty; all empty texts are equal.  Of equal texts the largest
id stays; a null id is below all others.  Rows repeated with the same id and text all count
and are all returned, one of them as kept.  Other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.ids import by_ids
from strideline.materialise import stored, tasks_for

#: Rows for each of which a task writes at most one of a list of odd rows.
SHARE = 5_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """Lower case in A-Z only; ``lower`` does that where all characters are ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def chunked(text: Column, least: int = 256, most: int = 4096) -> Column:
    """Cuts after the first sentence or line end beyond ``least`` characters, at ``most``."""
    pattern = rf"(?s).{{{least},{most - 2}}}?(?:[.!?]\x20|\n|\z)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _hash(chunk: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits) if bits < 64 else F.xxhash64(chunk)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select(F.col(id_col).alias("doc_id"), folded(F.col(text_col)).alias("text"))
    recipes = stored(texts.select(
        "doc_id", sha256(F.col("text")).alias("text_sha256"),
        F.transform(chunked(F.col("text")), lambda c: _hash(c, hash_bits)).alias("recipe"),
    ), "recipes")

    shared = recipes.groupBy("recipe").count().filter("count > 1")
    open_ids = recipes.join(shared, "recipe", "left_semi").select("doc_id")
    chunks = (
        texts.join(open_ids, texts["doc_id"].eqNullSafe(open_ids["doc_id"]), "left_semi")
        .select("doc_id", F.posexplode(chunked(F.col("text"))).alias("at", "chunk"))
        .withColumn("hash", _hash(F.col("chunk"), hash_bits))
    )
    distinct = chunks.groupBy("hash", "chunk").agg(F.lit(1).alias("one"))
    clashing = stored(
        distinct.groupBy("hash").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("chunk")).alias("chunks"))
        .filter("n > 1").select("hash", "chunks"), "clashing")
    recipes = recipes.withColumn("notes", F.array().cast("array<struct<at:int,number:int>>"))
    if not clashing.isEmpty():
        numbers = clashing.select("hash", F.posexplode("chunks").alias("number", "chunk"))
        notes = (
            chunks.join(numbers, ["hash", "chunk"]).groupBy("doc_id")
            .agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("at", "number")))).alias("found"))
            .withColumnRenamed("doc_id", "noted_id")
        )
        recipes = recipes.join(notes, recipes["doc_id"].eqNullSafe(notes["noted_id"]), "left").withColumn(
            "notes", F.coalesce("found", "notes"))

    rows = recipes.groupBy("doc_id", "text_sha256", "recipe", "notes").agg(F.count("*").alias("repeats"))
    groups = rows.groupBy("recipe", "notes").agg(
        F.max("doc_id").alias("keep_id"), F.sum("repeats").alias("group_size"))
    return (
        rows.join(groups, ["recipe", "notes"])
        .select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("nth"))
        .select("doc_id", "keep_id", "group_size",
                (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns.

    Pairs of id and text that go or have repeated rows are the short list here, so the texts of
    all other rows stay where they are.  Ids are compared as two keys, which lets a null find its
    row; the text is compared by the hash of its folded bytes, so rows of one id, or of none,
    with different texts are judged one by one.
    """
    pair, parts = ["k", "missing", "text_sha256"], tasks_for(docs.sparkSession, docs.count(), SHARE)
    keys = lambda c: (F.coalesce(c, F.lit(0)).alias("k"), c.isNull().alias("missing"))
    odd = stored(
        decide(docs, id_col, text_col).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
        .filter("NOT stays OR n > 1").select(*keys(F.col("doc_id")), "text_sha256", "stays").coalesce(parts), "odd-rows")
    rows = docs.select(*keys(F.col(id_col)), sha256(folded(F.col(text_col))).alias("text_sha256"), F.struct("*").alias("row"))
    once = by_ids(rows, odd, pair, "left_anti", parts).select("row.*")
    repeated = odd.filter("stays")
    if repeated.isEmpty():
        return once
    return once.union(by_ids(rows, repeated, pair, "left_semi", parts).dropDuplicates(pair).select("row.*"))
