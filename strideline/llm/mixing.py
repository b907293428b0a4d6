"""Mixing sources to target weights over a tree of domains, languages and sources.

A node hands its budget of tokens to its children by their weights.  A child that can't use
its share, because its documents times the allowed epochs are fewer, gives the shortage to its
siblings by their weights; only what a whole subtree can't use goes to the siblings of an
ancestor.  Going down with the capacities of whole subtrees does that in one pass: among
children sorted by capacity per weight, the level to which budgets fill is the largest of
(budget - capacities before) / (weights from here on).

A leaf's stream is its documents in a seeded order, a new order for each epoch.  It takes the
longest prefix of whole documents within its budget: some full epochs, then documents up to a
cut in the order of one more.  The cut is a hash, so the choice is a filter on the documents,
and no text is moved.

Cases: null names form the node "(null)"; a null text counts as empty, and documents without
tokens come with their place in the order; rows of equal ids stand at one place, and are taken
all or not; unknown nodes have weight 1, a node of weight 0 gets nothing; without documents the
result is empty; other columns come through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.llm.quality_rules import BLANKS, SPACE
from strideline.materialise import stored

#: Rows of a leaf that one window orders, on average; leaves up to this many are broadcast.
SLICE, MOST_LEAVES = 16384, 1_000_000


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE + "+"))).cast("long")


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document stands in the order of an epoch."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _weights(spark, weights: dict[tuple[str, ...], int], depth: int) -> DataFrame:
    rows = [(*path, w) for path, w in weights.items() if len(path) == depth]
    return spark.createDataFrame(rows, ", ".join([*(f"p{i} string" for i in range(depth)), "w long"]))


def budgets(leaves: DataFrame, weights: dict[tuple[str, ...], int], levels: int, percent: int, epochs: int) -> DataFrame:
    """Adds ``budget`` to leaves ``(p0, p1, ..., n_docs, tokens)``; the root gets percent of all tokens."""
    names = [f"p{i}" for i in range(levels)]
    capacity = F.sum("tokens") * epochs
    parents = leaves.agg(
        F.least(F.coalesce(F.floor(F.sum("tokens") * percent / 100), F.lit(0)), F.coalesce(capacity, F.lit(0))).cast("long").alias("budget"))
    for depth in range(1, levels + 1):
        path, above = names[:depth], names[: depth - 1]
        nodes = leaves.groupBy(*path).agg(capacity.cast("long").alias("cap"))
        nodes = nodes.join(F.broadcast(_weights(leaves.sparkSession, weights, depth)), path, "left").withColumn("w", F.coalesce("w", F.lit(1)))
        nodes = nodes.join(parents, above) if above else nodes.crossJoin(F.broadcast(parents))
        # Weightless children come last and bound nothing.
        order = Window.partitionBy(*above).orderBy(F.col("w") == 0, F.col("cap") / F.when(F.col("w") > 0, F.col("w")), path[-1])
        before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        onward = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        level = F.max(F.col("level")).over(Window.partitionBy(*above))
        nodes = nodes.withColumn("level", F.when(onward > 0, (F.col("budget") - before) / F.when(onward > 0, onward))).withColumn("level", level)
        filled = F.floor(F.col("w") * F.greatest(F.coalesce("level", F.lit(0.0)), F.lit(0.0)))
        # Rounding of the quotient must not take a token from a child that is full.
        parents = nodes.select(*path, F.least("cap", F.when(F.col("w") * F.col("level") >= F.col("cap") - 1e-6, F.col("cap")).otherwise(filled)).cast("long").alias("budget"))
    return leaves.join(parents, names)


def plan(rows: DataFrame, weights: dict[tuple[str, ...], int], levels: int, percent: int, epochs: int, seed: int) -> DataFrame:
    """Of each leaf: budget, full epochs, and the cut in the order of the next one.

    ``rows`` are ``(p0, p1, ..., id, tokens)``.
    """
    names = [f"p{i}" for i in range(levels)]
    leaves = rows.groupBy(*names).agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"))
    full = F.when(F.col("tokens") > 0, F.expr("budget DIV tokens")).otherwise(0)
    leaves = stored(
        budgets(leaves, weights, levels, percent, epochs).withColumn("full", full)
        .withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
        .withColumn("digits", F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("n_docs") / SLICE))).cast("int")), "leaves")
    few = leaves.count() <= MOST_LEAVES
    at = rows.withColumnRenamed("tokens", "own").join(F.broadcast(leaves) if few else leaves, names).filter("rest > 0").select(
        *names, "rest", "own", place(seed, F.col("full") + 1, F.col("id")).alias("place"), "digits").withColumn("slice", F.expr("substring(place, 1, digits)"))
    slices = at.groupBy(*names, "slice").agg(F.sum("own").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Only the slice in which the budget ends has to be ordered.
    ends = slices.select(*names, "slice", "sum", before.alias("before"))
    last = at.join(ends, [*names, "slice"]).filter("before <= rest AND before + sum > rest")
    within = F.sum("own").over(Window.partitionBy(*names, "slice").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    inside = last.withColumn("upto", F.col("before") + within).filter("upto <= rest").groupBy(*names).agg(F.max("place").alias("cut"))
    open_slice = last.groupBy(*names).agg(F.min("slice").alias("open_slice"))
    return leaves.join(inside, names, "left").join(open_slice, names, "left")


def mix(docs: DataFrame, path: list[Column], weights: dict[tuple[str, ...], int], percent: int = 90, epochs: int = 2, seed: int = 11,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, path, epoch, tokens)``: the whole row, its leaf, and the epoch it is taken in."""
    names = [f"p{i}" for i in range(len(path))]
    keyed = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("tokens"),
        *(F.coalesce(p.cast("string"), F.lit("(null)")).alias(n) for n, p in zip(names, path, strict=True)))
    leaves = stored(plan(keyed.select(*names, "id", "tokens"), weights, len(path), percent, epochs, seed).select(
        *names, "full", "rest", "digits", "cut", "open_slice"), "mix")
    at = place(seed, F.col("full") + 1, F.col("id"))
    # A leaf without an open slice has a rest that no place exceeds, or none at all.
    taken = (F.col("rest") > 0) & (F.col("open_slice").isNull() | (F.col("place") <= F.col("cut")) | (F.expr("substring(place, 1, digits)") < F.col("open_slice")))
    rows = keyed.join(F.broadcast(leaves) if leaves.count() <= MOST_LEAVES else leaves, names).withColumn("place", at)
    times = F.col("full") + F.coalesce(taken, F.lit(False)).cast("long")
    return rows.filter(times > 0).select("row", F.struct(*names).alias("path"), F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("epoch"), "tokens")
