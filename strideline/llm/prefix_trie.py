"""Prefix trie of conversations by digests of blocks of a fixed number of turns.

Turns are cut into blocks.  A conversation's first blocks are told by one digest of their
digests, so grouping by (that digest, next block) finds what conversations share block by
block.  Where all conversations with the same blocks so far go on with one block, its turns
are nodes of equal members and need no comparison.  Only blocks beside which other blocks stand are
refined: digests of their first 1, 2, ... turns tell at which turn the siblings part.

The digest of the blocks before each block is taken in slices of 64 blocks, then over slices in slices of 64, and
so on, so no conversation is gathered and the number of steps is the logarithm of the longest.

Sums over subtrees need no walk through the tree.  A node belongs to its smallest member; with
the tokens and leaves that belong to each conversation, the sum over a subtree is a sum
over the members of its top: all tokens of the members, less the tokens of nodes
that belong to one of them, where of the smallest member only those below the top count.

Cases: null roles and texts are empty; order and ties of turns as in :mod:`strideline.llm.turns`; rows without
``conv_id`` are left out; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.quality_rules import BLANKS, SPACE
from strideline.llm.turns import in_order, joined_sha256, numbered, text_key
from strideline.materialise import stored

BLOCK, SLICE = 4, 64
#: Range of ids whose members of one node are written together before they are hashed.
IDS = 4096


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE + "+"))).cast("long")


def sequences(rows: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn_key, words)`` with ``pos`` from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = rows.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text_key(text).alias("text_key"), key.alias("turn_key"), _words(text).alias("words"))
    ordered = in_order(turns, ["conv_id", "turn", "role", "text_key"]).select("conv_id", "place", "turn_key", "words")
    return numbered(ordered, "conv_id")


def _chained(above: Column, inside: Column) -> Column:
    """One digest of what stands before a slice and of its first blocks; either may be empty."""
    return F.when((above == "") | (inside == ""), F.concat(above, inside)).otherwise(F.sha2(F.concat(above, inside).cast("binary"), 256))


def _around(blocks: DataFrame, most: int) -> DataFrame:
    """``(conv_id, block, before, after, words_before)``: digests of all blocks in front of each, and of those up to it.

    ``blocks`` is ``(conv_id, block, digest, sum)`` with numbers up to ``most``.
    """
    piece = F.struct("block", "digest", "sum")
    slices = blocks.groupBy("conv_id", F.expr(f"block DIV {SLICE}").alias("slice")).agg(F.sort_array(F.collect_list(piece)).alias("own"))
    start = F.struct(F.lit("").alias("digest"), F.lit(0).cast("long").alias("sum"))
    step = lambda done, x: F.concat(done, F.array(F.struct(
        F.sha2(F.concat(F.element_at(done, -1)["digest"], x["digest"]).cast("binary"), 256).alias("digest"), (F.element_at(done, -1)["sum"] + x["sum"]).alias("sum"))))
    run = stored(slices.select("conv_id", "slice", "own", F.aggregate("own", F.array(start), step).alias("run")), "slices")
    if most >= SLICE:
        last = F.element_at("run", -1)
        upper = _around(run.select("conv_id", F.col("slice").alias("block"), last["digest"].alias("digest"), last["sum"].alias("sum")), most // SLICE)
        upper = upper.select("conv_id", F.col("block").alias("slice"), F.col("before").alias("above"), F.col("after").alias("above_after"), F.col("words_before").alias("above_words"))
        run = run.join(upper, ["conv_id", "slice"])
    else:
        run = run.select("*", F.lit("").alias("above"), F.lit(None).cast("string").alias("above_after"), F.lit(0).cast("long").alias("above_words"))
    rows = run.select("conv_id", "above", "above_after", "above_words", "run", F.posexplode("own").alias("i", "x"))
    here, behind = F.get("run", F.col("i")), F.get("run", F.col("i") + 1)
    # What stands before the first block of a slice is told as in the level above.
    after = F.when((F.col("x.block") % SLICE == SLICE - 1) & F.col("above_after").isNotNull(), F.col("above_after")).otherwise(_chained(F.col("above"), behind["digest"]))
    return rows.select(
        "conv_id", "x.block", _chained(F.col("above"), here["digest"]).alias("before"), after.alias("after"), (F.col("above_words") + here["sum"]).alias("words_before"))


def blocks_of(turns: DataFrame) -> DataFrame:
    """``(conv_id, block, digest, size, keys, words, before, after, words_before)`` of ``(conv_id, depth, turn_key, words)``."""
    piece = F.struct("depth", "turn_key", "words")
    own = F.sort_array(F.collect_list(piece))
    blocks = turns.groupBy("conv_id", F.expr(f"(depth - 1) DIV {BLOCK}").alias("block")).agg(own.alias("own")).select(
        "conv_id", "block", F.size("own").alias("size"), F.transform("own", lambda x: x["turn_key"]).alias("keys"), F.transform("own", lambda x: x["words"]).alias("words"))
    blocks = stored(blocks.withColumn("digest", F.sha2(F.array_join("keys", "").cast("binary"), 256)), "blocks")
    most = blocks.agg(F.max("block")).first()[0] or 0
    total = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)
    around = _around(blocks.select("conv_id", "block", "digest", total.alias("sum")), most)
    return stored(blocks.join(around, ["conv_id", "block"]), "blocks")


_BLOCK_KEY = ["block", "before", "digest"]


def _nodes(grouped: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Nodes ``(depth, key, ...)`` of distinct blocks with ``split`` (whether siblings stand beside it).

    A node at the end of a full block is told by the digest of all blocks up to it, one inside a block without
    siblings by the blocks before it, one inside a block with siblings by its turns as well.
    """
    inner = F.aggregate("keys", F.array(F.col("before")), lambda done, k: F.concat(done, F.array(F.sha2(F.concat(F.element_at(done, -1), k).cast("binary"), 256))))
    told = F.when(F.col("split"), inner).otherwise(F.array_repeat("before", F.size("keys") + 1))
    whole = F.when(F.col("size") == BLOCK, F.concat(F.slice("told", 1, BLOCK), F.array("after"))).otherwise(F.col("told"))
    rows = grouped.withColumn("told", told).withColumn("told", whole)
    each = rows.select("block", "words_before", *sums, "told", "words", F.posexplode(F.slice("told", F.lit(2), F.size("keys"))).alias("i", "key"))
    ahead = F.aggregate(F.slice("words", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x)
    each = each.select(
        (F.col("block") * BLOCK + F.col("i") + 1).alias("depth"), "key", F.get("told", F.col("i")).alias("parent_key"), F.get("words", F.col("i")).alias("words"),
        (F.col("words_before") + ahead).alias("words_ahead"), *sums)
    return each.groupBy("depth", "key").agg(
        *(F.first(c).alias(c) for c in ("parent_key", "words", "words_ahead")), *(c.alias(n) for n, c in sums.items()))


def trie(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of sequences ``(conv_id, depth, turn_key, words)``, depths from 1 without holes.

    Nodes are ``(key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens)``,
    ends ``(conv_id, depth, key)`` tell the node at which each of ``conversations`` ends.
    """
    blocks = blocks_of(turns)
    shared = blocks.groupBy(*_BLOCK_KEY).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), *(F.first(c).alias(c) for c in ("size", "keys", "words", "after", "words_before")))
    shared = stored(shared, "shared")
    siblings = shared.groupBy("block", "before").agg((F.count("*") > 1).alias("split"))
    shared = stored(shared.join(siblings, ["block", "before"]), "shared")

    first = _nodes(shared.select("*", F.col("n").alias("n_convs"), F.col("least").alias("conv")), {"n_convs": F.sum("n_convs"), "conv": F.min("conv")})
    root = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv")).filter("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), F.lit("").alias("key"), F.lit(None).cast("string").alias("parent_key"), F.lit(0).cast("long").alias("words"),
        F.lit(0).cast("long").alias("words_ahead"), "n_convs", "conv")
    nodes = stored(first.unionByName(root), "nodes")
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(below, ["depth", "key"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    # What belongs to each conversation: tokens and leaves of the nodes it is the smallest member of.
    owned = nodes.groupBy(F.col("conv").alias("conv_id")).agg(F.sum("words").alias("own"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    totals = turns.groupBy("conv_id").agg(F.sum("words").alias("total"))
    per = conversations.join(owned, "conv_id", "left").join(totals, "conv_id", "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("own", "leaves", "total")))
    per = stored(per, "conversations")
    sums = ["own", "leaves", "total"]
    summed = blocks.select("conv_id", *_BLOCK_KEY).join(per, "conv_id").groupBy(*_BLOCK_KEY).agg(*(F.sum(c).alias(c) for c in sums))
    again = _nodes(shared.drop("n", "least").join(summed, _BLOCK_KEY), {c: F.sum(c) for c in sums}).select("depth", "key", *sums)
    again = again.unionByName(per.agg(*(F.sum(c).alias(c) for c in sums)).select(F.lit(0).cast("long").alias("depth"), F.lit("").alias("key"), *sums))
    least = per.select(F.col("conv_id").alias("conv"), F.col("own").alias("least_own"), F.col("total").alias("least_total"))
    # All tokens of the members from this node on, less those of the distinct nodes from it on.
    saved = F.col("total") - F.col("n_convs") * F.col("words_ahead") - (F.col("least_total") - F.col("words_ahead") + F.col("own") - F.col("least_own"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv").alias("parent_conv_id"))
    full = nodes.join(again, ["depth", "key"]).join(least, "conv").join(parents, ["depth", "parent_key"], "left").select(
        "key", F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"))

    lasts = blocks.groupBy("conv_id").agg(F.max_by(F.struct(*_BLOCK_KEY), "block").alias("last")).select("conv_id", "last.*")
    ends_at = shared.select(*_BLOCK_KEY, (F.col("block") * BLOCK + F.col("size")).alias("depth"), F.when(
        F.col("size") == BLOCK, F.col("after")
    ).when(~F.col("split"), F.col("before")).otherwise(
        F.aggregate("keys", F.col("before"), lambda done, k: F.sha2(F.concat(done, k).cast("binary"), 256))).alias("key"))
    ends = conversations.join(lasts.join(ends_at, _BLOCK_KEY), "conv_id", "left").select(
        "conv_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("key", F.lit("")).alias("key"))
    return full, ends


def member_digests(ends: DataFrame) -> DataFrame:
    """``(key, depth, ends_sha256)`` of the ids that end at each node, ascending and comma-joined.

    Ids are written together in ranges of ``IDS``, so that few rows of a large node meet in the one task that hashes them.
    """
    chunks = ends.groupBy("depth", "key", F.floor(F.col("conv_id") / IDS).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids")).select(
        F.concat_ws("/", "depth", "key").alias("node"), "chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("piece"))
    ordered = chunks.repartition("node").sortWithinPartitions("node", "chunk").select(F.col("node").alias("key"), "piece")
    found = joined_sha256(ordered, ",")
    cut = F.split("key", "/", 2)
    return found.select(cut[0].cast("long").alias("depth"), cut[1].alias("key"), F.col("sha256").alias("ends_sha256"))


def rebuilt(rows: DataFrame, host: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``head`` turns of ``host(conv_id)`` instead of as many of their own.

    Both are columns over ``conv_id``; gives ``(conv_id, depth, turn_key, words)`` and the distinct ``conv_id``.
    ``head`` is small: each conversation gets that many rows at most.
    """
    own = stored(sequences(rows), "turns")
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    hosts = sizes.select("conv_id", host.alias("host"), head.cast("long").alias("head"))
    lengths = sizes.select(F.col("conv_id").alias("host"), F.col("n").alias("host_n"))
    convs = stored(hosts.join(lengths, "host", "left").withColumn("taken", F.least("head", F.coalesce("host_n", F.lit(0)))), "hosts")
    wanted = convs.filter("taken > 0").select("conv_id", "host", F.explode(F.sequence(F.lit(1).cast("long"), "taken")).alias("pos"))
    heads = wanted.join(own.withColumnRenamed("conv_id", "host"), ["host", "pos"]).select("conv_id", F.col("pos").alias("depth"), "turn_key", "words")
    rest = own.join(convs, "conv_id").filter("pos > head").select("conv_id", (F.col("taken") + F.col("pos") - F.col("head")).alias("depth"), "turn_key", "words")
    return stored(heads.unionByName(rest), "rebuilt"), convs.select("conv_id")
