"""Connected components of a distributed list of links.

Cases: a link of a node with itself is left out, repeated links count once, ties don't arise; without links
there are no nodes; ends are never null.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.materialise import stored

#: Links that one task merges, about 100 MB of memory.
SHARE = 500_000


def _forests(batches):
    """Links of a partition, shortened: every node points to the smallest of its tree."""
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = parent.setdefault(min(a, b), min(a, b))
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])


def _starred(links: DataFrame, both_ways: bool) -> DataFrame:
    """Joins neighbours to the smallest node around, from larger to smaller."""
    around = links.union(links.select("b", "a")) if both_ways else links
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = around.join(least, "a")
    if both_ways:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """``(node, component)`` for all nodes of links ``(a, b)``; a component is its smallest node.

    With ``parts``, the distinct links are written in at most that many files.

    Tasks merge bounded shares of the links; if that was one share, it is the result.  Else the
    two star steps alternate until nothing changes, which takes a number of rounds in the order
    of the logarithm of the longest path.  No node's neighbours are gathered, only their
    minimum is.
    """
    schema = "a long, b long"
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    ordered = stored(ordered if parts is None else ordered.coalesce(parts), "links")
    shares = max(1, -(-ordered.count() // SHARE))
    now = stored(ordered.repartition(shares).mapInArrow(_forests, schema), "links")
    if shares == 1:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select("b", "b").distinct())
        seen = mark
        now = stored(_starred(_starred(now, True), False), "links")
