"""N-gram Jaccard join with trees over count vectors.

Word windows are hashed; a document is the set of its hashes.  The hashes fall into groups,
and the counts per group are the document's point.  The sum of the smaller coordinates of
two points bounds the overlap of their sets from above; the same sum over the largest
coordinates of two nodes bounds it for all documents below them.

One tree over everything would compare nearly all nodes, because points of many coordinates
lie about equally far from each other.  So there is a tree per shard: a document goes to the
shards of its first windows in an order that puts frequent ones last: as many as may miss from
the other document, and one more, which at 75 percent is a quarter.  Two documents over the
threshold must meet in one of these (prefix filter), so nothing is lost.
What the order is decides the cost alone; it rests on counts of all windows of all documents
in a sketch of fixed size.

1. Documents with equal sets are represented by the smallest id.
2. Each document is tested with the neighbour it shares most shards with; links found so are
   contracted to components.  A large group of near copies ends here, in linear work.
3. Pairs of different components in shards of one leaf are verified, then, in rounds, for each
   document of a larger shard a neighbour from another component; links are contracted.
4. Larger shards that still hold several components go through their trees; pairs of different
   components over the bound are verified on the whole sets: first the most promising ones of each
   component, whose links are contracted, then all that remain.  Very large shards are dealt out
   in blocks, and blocks of one component are not compared with each other.

Pairs are bounded once more, before they become rows, by the parities of the counts of finer groups: each
group in which two documents differ in parity holds a window that only one of them has.

Cases: a null text counts as empty; an empty document has no windows and links with nothing;
fewer words than a window give one window; rows with equal ids are one node and rows with a
null id are returned with a null component; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.components import components
from strideline.llm.ids import by_ids
from strideline.llm.words import hashed_words, mixed, slices, windows
from strideline.materialise import stored, tasks_for

SKETCH, SLICES = 1 << 20, 256
LEAF, BLOCK = 64, 1024
#: Rounds of contraction in larger shards before their trees are joined.
ROUNDS = 4
#: First shards of a document that its rows in small shards carry.
EARLY = 3
#: Groups of the parities that rows of small shards carry at most.
BRIEF = 512
#: Windows of a task, and the number that a document counts for at least.
SHARE, LEAST = 1 << 20, 256
#: Pairs that each component gives from a pair of blocks, before all that remain are tested.
FIRST_PAIRS = 3


# --- sets of windows ---------------------------------------------------------------------


def _sets(batches, size: int):
    """Distinct window hashes of some texts: ids, hashes and the bounds of each text."""
    for batch in batches:
        texts, ids = batch.column(1).to_pylist(), batch.column(0)
        for first, stop in slices(texts):
            h, doc = windows(*hashed_words(texts[first:stop]), size)
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[new], doc[new]
            yield ids.slice(first, stop - first), h, doc, np.searchsorted(doc, np.arange(stop - first + 1))


def _sketch(size: int):
    """Counts of windows by the low bits of their hash, in slices."""
    def run(batches):
        counts = np.zeros(SKETCH, np.uint32)
        for _, h, _, _ in _sets(batches, size):
            counts += np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([s.tobytes() for s in counts.reshape(SLICES, -1)], pa.binary())], ["slice", "counts"])

    return run


def _summed(batches):
    """Sums of the slices of a partition, added up as they come."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(counts.as_py(), np.uint32).astype(np.uint64)
            total[k] = part if k not in total else total[k] + part
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["slice", "counts"])


def frequency_classes(docs: DataFrame, size: int) -> np.ndarray:
    """A class for each counter of the sketch; counts near the mean are class 0.

    The result has one byte per counter, 1 MB whatever the input.
    """
    schema = "slice int, counts binary"
    parts = docs.mapInArrow(_sketch(size), schema).repartition("slice").mapInArrow(_summed, schema).orderBy("slice").collect()
    counts = np.concatenate([np.frombuffer(r.counts, np.uint64) for r in parts] or [np.zeros(SKETCH, np.uint64)]).astype(float)
    mean = max(counts.mean(), 0.1)
    return np.clip(np.floor(2 * np.log2(np.maximum(counts, 1) / (1.5 * mean)) + 1), 0, 250).astype(np.uint8)


def _parities(h: np.ndarray, doc: np.ndarray, groups: np.ndarray) -> list[bytes]:
    """For each document a bit per group: whether its count is odd."""
    base = np.concatenate(([0], np.cumsum(groups)))
    odd = np.bincount(base[doc] + ((h >> np.uint64(32)).astype(np.int64) & (groups[doc] - 1)), minlength=base[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little")
    return [packed[i // 8 : j // 8].tobytes() for i, j in zip(base[:-1], base[1:], strict=True)]


def _profiles(size: int, percent: int, classes):
    """Set size, digest, point, parities of finer groups and shards of each document."""
    def run(batches):
        rank = classes.value
        for ids, h, doc, at in _sets(batches, size):
            n = np.diff(at)
            groups = 1 << np.maximum(3, np.ceil(np.log2(np.maximum(n, 1) / 4)).astype(np.int64))
            base = np.concatenate(([0], np.cumsum(groups)))
            points = np.bincount(base[doc] + ((h >> np.uint64(20)).astype(np.int64) & (groups[doc] - 1)), minlength=base[-1])
            token = mixed(h)
            order = np.lexsort((token, rank[(h & np.uint64(SKETCH - 1)).astype(np.int64)], doc))
            prefix = n + (-percent * n) // 100 + 1
            keep = np.arange(len(h)) - at[doc] < prefix[doc]
            shards, lengths = token[order][keep].view(np.int64), np.bincount(doc[keep], minlength=len(n))
            digests = [xxhash.xxh3_128_digest(h[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            # A count beyond 16 bits can't be stored; the empty point bounds nothing.
            vectors = [p.astype("<u2").tobytes() if p.max(initial=0) < 65536 else b"" for p in np.split(points, base[1:-1])]
            parity, brief = (_parities(h, doc, np.minimum(8 * groups, most)) for most in (1 << 62, BRIEF))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary()), pa.array(parity, pa.binary()), pa.array(brief, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(shards)),
            ], ["doc_id", "n", "digest", "point", "parity", "brief", "shards"])

    return run


def _whole_sets(size: int):
    def run(batches):
        for ids, h, _, at in _sets(batches, size):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["doc_id", "hashes"])

    return run


# --- bounds and verification -------------------------------------------------------------


def needed(na, nb, percent: int):
    """Least overlap of two sets of these sizes: 100 * overlap >= percent * union."""
    return -(-percent * (na + nb) // (100 + percent))


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The counts for a smaller number of groups."""
    return point.reshape(*point.shape[:-1], -1, groups).sum(axis=-2)


def odd_groups(parity: bytes) -> tuple[int, int]:
    """The groups with an odd count, as the bits of a number, and the number of groups."""
    return int.from_bytes(parity, "little"), 8 * len(parity)


def bound(a: tuple[int, int], b: tuple[int, int], na: int, nb: int) -> int:
    """Upper bound of the overlap: a group whose counts differ in parity holds a window that only one set has."""
    (x, p), (y, q) = (a, b) if a[1] >= b[1] else (b, a)
    while p > q:  # Two groups become one, whose count is odd if one of theirs is.
        p //= 2
        x = (x >> p) ^ (x & ((1 << p) - 1))
    return (na + nb - (x ^ y).bit_count()) // 2


def tree_join(points: list[bytes], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i from left, j from right) whose points allow the overlap needed.

    Both sides are packed into trees, by size and then by their largest coordinates; a pair of
    nodes is opened only if the bound over its largest coordinates reaches what the smallest
    sizes need.
    """
    if any(not p for p in points):
        i, j = np.meshgrid(left, right, indexing="ij")
        return i.ravel(), j.ravel()
    groups = min(len(p) // 2 for p in points)
    x = np.stack([folded(np.frombuffer(p, "<u2").astype(np.int32), groups) for p in points])

    def tree(members: np.ndarray, depth: int = 0):
        node = {"most": x[members].max(axis=0), "small": sizes[members].min(), "large": sizes[members].max(), "members": members, "below": None}
        if len(members) > LEAF:
            spread = x[members].var(axis=0)
            key = sizes[members] if depth % 2 == 0 else x[members, int(spread.argmax())]
            order = members[np.argsort(key, kind="stable")]
            half = len(order) // 2
            node["below"] = [tree(order[:half], depth + 1), tree(order[half:], depth + 1)]
        return node

    found, todo = [], [(tree(left), tree(right))] if len(left) and len(right) else []
    while todo:
        a, b = todo.pop()
        if 100 * a["large"] < percent * b["small"] or 100 * b["large"] < percent * a["small"]:
            continue
        if np.minimum(a["most"], b["most"]).sum() < needed(a["small"], b["small"], percent):
            continue
        if a["below"] is None and b["below"] is None:
            i, j = np.meshgrid(a["members"], b["members"], indexing="ij")
            i, j = i.ravel(), j.ravel()
            fits = np.minimum(x[i], x[j]).sum(axis=1) >= needed(sizes[i], sizes[j], percent)
            found.append((i[fits], j[fits]))
        elif b["below"] is None or (a["below"] is not None and len(a["members"]) >= len(b["members"])):
            todo += [(c, b) for c in a["below"]]
        else:
            todo += [(a, c) for c in b["below"]]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([f[k] for f in found]) if found else none for k in (0, 1))


def _bounded(percent: int):
    def run(batches):
        for t in batches:
            na, nb = t.column("na").to_numpy(), t.column("nb").to_numpy()
            sides = [[odd_groups(p) for p in t.column(c).to_pylist()] for c in ("pa", "pb")]
            most = list(map(bound, *sides, na.tolist(), nb.tolist()))
            yield t.filter(pa.array(np.array(most, np.int64) >= needed(na, nb, percent))).select(["a", "b"])

    return run


def _verified(percent: int):
    def run(batches):
        for t in batches:
            good = []
            for p, q in zip(t.column("ha"), t.column("hb"), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (p, q))
                both = np.sort(np.concatenate((x, y)))
                good.append(bool(np.count_nonzero(both[1:] == both[:-1]) >= needed(len(x), len(y), percent)))
            yield t.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return run


def _links(docs: DataFrame, pairs: DataFrame, size: int, percent: int, parts: int) -> DataFrame:
    """The pairs that link, checked on the whole sets."""
    pairs = stored(pairs.coalesce(parts), "pairs")
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = by_ids(docs, ids, ["doc_id"], "left_semi", parts).mapInArrow(_whole_sets(size), "doc_id long, hashes binary")
    both = (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb")), "b")
    )
    return stored(both.select("a", "b", "ha", "hb").mapInArrow(_verified(percent), "a long, b long").distinct().coalesce(parts), "verified")


# --- shards ------------------------------------------------------------------------------

_SHARED = "token long, doc_id long, n long, leads boolean, before long, n_before long"


def _shared(batches):
    """Of rows sorted by token: those whose token occurs again, with the row before them."""
    held, held_had = None, False
    schema = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("leads", pa.bool_()), ("before", pa.int64()), ("n_before", pa.int64())])

    def out(cols, had, again):
        token, doc, n, leads = cols
        keep = np.flatnonzero(had | again)
        before = pa.array(np.concatenate(([0], doc[:-1]))[keep], mask=~had[keep])
        n_before = pa.array(np.concatenate(([0], n[:-1]))[keep], mask=~had[keep])
        return pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(doc[keep]), pa.array(n[keep]), pa.array(leads[keep]), before, n_before], schema=schema)

    last_before = None
    for batch in batches:
        token, doc, packed = (batch.column(i).to_numpy() for i in range(3))
        if not len(token):
            continue
        cols = [token, doc, packed >> 1, (packed & 1).astype(bool)]
        if held is not None:
            cols = [np.concatenate((h, c)) for h, c in zip(held, cols, strict=True)]
        again = cols[0][1:] == cols[0][:-1]
        had = np.concatenate(([held_had], again))
        first = out([c[:-1] for c in cols], had[:-1], again)
        if held_had and first.num_rows and last_before is not None:
            first = first.set_column(4, schema.field(4), pa.array([last_before[0], *first.column(4).to_pylist()[1:]], pa.int64()))
            first = first.set_column(5, schema.field(5), pa.array([last_before[1], *first.column(5).to_pylist()[1:]], pa.int64()))
        yield first
        if len(cols[0]) > 1:
            last_before = (int(cols[1][-2]), int(cols[2][-2]))
        held, held_had = [c[-1:] for c in cols], bool(had[-1])
    if held is not None and held_had:
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c) for c in held), pa.array([last_before[0]], pa.int64()), pa.array([last_before[1]], pa.int64())], schema=schema)


def _whole_groups(batches, keys: list[str]):
    """Tables of sorted rows in which no group of equal keys is cut."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        same = np.logical_and.reduce([t.column(c).to_numpy() == t.column(c)[-1].as_py() for c in keys])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held = t.slice(cut)
        if cut:
            yield t.slice(0, cut)
    if held is not None:
        yield held


def _groups(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Bounds of the groups of equal keys."""
    k = np.stack([t.column(c).to_numpy() for c in keys])
    return np.flatnonzero(np.concatenate(([True], (k[:, 1:] != k[:, :-1]).any(axis=0), [True])))


def _pair_batch(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])


def _from_small(percent: int):
    """Pairs of different components in shards of one leaf, sorted by token, that their parities allow."""
    def run(batches):
        for t in _whole_groups(batches, ["token"]):
            doc, n, comp = (t.column(c).to_numpy() for c in ("doc_id", "n", "component"))
            leads = t.column("leads").to_numpy(zero_copy_only=False)
            odd, token = list(map(odd_groups, t.column("brief").to_pylist())), t.column("token").to_numpy()
            early = np.array([(e + [0] * EARLY)[:EARLY] for e in t.column("early").to_pylist()], np.int64).reshape(-1, EARLY)
            cuts = _groups(t, ["token"])
            size = np.diff(cuts)
            found = []
            for s in np.unique(size[size > 1]):
                at = cuts[:-1][size == s]
                i, j = np.triu_indices(s, 1)
                i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                swap = (n[i] > n[j]) | ((n[i] == n[j]) & (doc[i] > doc[j]))
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                # The smaller of two documents over the threshold meets the other early.
                keep = np.flatnonzero((comp[i] != comp[j]) & (100 * n[i] >= percent * n[j]) & leads[i])
                # Two documents with early shards in common are a pair in the first of these alone.
                mine, others = early[i[keep]], early[j[keep]]
                both = ((mine[:, :, None] == others[:, None, :]) & (mine[:, :, None] != 0)).any(axis=2)
                first = mine[np.arange(len(keep)), both.argmax(axis=1)]
                keep = keep[~both.any(axis=1) | (first == token[i[keep]])]
                least = needed(n[i[keep]], n[j[keep]], percent)
                fits = [bound(odd[a], odd[b], int(n[a]), int(n[b])) >= m for a, b, m in zip(i[keep], j[keep], least, strict=True)]
                keep = keep[np.array(fits, bool)]
                found.append(np.stack((doc[i[keep]], doc[j[keep]])))
            if found:
                yield _pair_batch(*np.unique(np.concatenate(found, axis=1), axis=1))

    return run


def _neighbours(percent: int):
    """Pairs of rows next to each other in shards sorted by size, if of different components."""
    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in ("token", "doc_id", "n", "component")]
            token, doc, n, comp = rows if held is None else (np.concatenate(x) for x in zip(held, rows, strict=True))
            held = [x[-1:] for x in (token, doc, n, comp)]
            i = np.flatnonzero((token[1:] == token[:-1]) & (comp[1:] != comp[:-1]) & (100 * n[:-1] >= percent * n[1:]))
            yield _pair_batch(doc[i], doc[i + 1])

    return run


def _from_large(percent: int, most: int | None):
    """Pairs of different components from the trees of pairs of blocks, sorted by (token, low, high).

    With ``most``, each component gives that many pairs of a pair of blocks, those with the largest bounds.
    """
    keys = ["token", "low", "high"]

    def best(i: np.ndarray, j: np.ndarray, over: np.ndarray, comp: np.ndarray) -> np.ndarray:
        order = np.argsort(-over, kind="stable")
        keep = np.zeros(len(i), bool)
        for side in (i, j):
            own = comp[side[order]]
            by = np.argsort(own, kind="stable")
            first = np.concatenate(([0], np.flatnonzero(own[by][1:] != own[by][:-1]) + 1)) if len(own) else np.zeros(0, np.int64)
            place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
            keep[order[by[place < most]]] = True
        return keep

    def run(batches):
        for t in _whole_groups(batches, keys):
            doc, n, comp = (t.column(c).to_numpy() for c in ("doc_id", "n", "component"))
            left, right = (t.column(c).to_numpy(zero_copy_only=False) for c in ("is_low", "is_high"))
            points, odd, cuts = t.column("point").to_pylist(), list(map(odd_groups, t.column("parity").to_pylist())), _groups(t, keys)
            found = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                i, j = tree_join(points[a:b], n[a:b], np.flatnonzero(left[a:b]), np.flatnonzero(right[a:b]), percent)
                i, j = a + i, a + j
                keep = comp[i] != comp[j]
                i, j = i[keep], j[keep]
                allowed = np.fromiter((bound(odd[x], odd[y], int(n[x]), int(n[y])) for x, y in zip(i, j, strict=True)), np.int64, len(i))
                over = allowed - needed(n[i], n[j], percent)
                keep = over >= 0
                i, j, over = i[keep], j[keep], over[keep]
                if most is not None:
                    keep = best(i, j, over, comp)
                    i, j = i[keep], j[keep]
                found.append(np.stack((doc[i], doc[j])))
            low, high = np.sort(np.concatenate(found, axis=1), axis=0)
            yield _pair_batch(*np.unique(np.stack((low, high)), axis=1))

    return run


def _open_shards(shared: DataFrame, parts: int) -> DataFrame:
    """Shards with several components: their rows, blocks, and components that fill blocks."""
    per = shared.groupBy("token", "component").agg(F.count("*").alias("c"))
    big = F.col("c") > BLOCK
    return stored(per.groupBy("token").agg(
        F.count("*").alias("n_components"), F.sum("c").alias("n_rows"),
        F.ceil(F.coalesce(F.sum(F.when(~big, F.col("c"))), F.lit(0)) / BLOCK).cast("int").alias("n_mixed"),
        F.sort_array(F.collect_list(F.when(big, F.struct("component", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))))).alias("big"),
    ).filter("n_components > 1").coalesce(parts), "shards")


def _blocked(shared: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows of shards, once for each pair of blocks they belong to.

    Components of more than a block get blocks of their own, which are not compared among
    themselves; the others are dealt to blocks by component.
    """
    rows = shared.join(shards, "token")
    place = F.array_position(F.transform("big", lambda b: b["component"]), F.col("component")).cast("int")
    before = lambda k: F.col("n_mixed") + F.aggregate(F.slice("big", F.lit(1), k), F.lit(0), lambda s, b: s + b["blocks"])
    rows = rows.withColumn("place", place).withColumn("n_blocks", before(F.size("big")))
    rows = rows.withColumn("first", F.when(F.col("place") > 0, before(F.col("place") - 1)))
    rows = rows.withColumn("own", F.when(F.col("place") > 0, F.get("big", F.col("place") - 1)["blocks"]))
    mine = F.when(F.col("place") > 0, F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("own")).cast("int")).otherwise(
        F.pmod(F.xxhash64("component"), F.greatest("n_mixed", F.lit(1))).cast("int"))
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    apart = (F.col("place") == 0) | (F.col("other") < F.col("first")) | (F.col("other") >= F.col("first") + F.col("own"))
    return rows.filter(apart).select(
        "token", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
        (F.col("mine") <= F.col("other")).alias("is_low"), (F.col("mine") >= F.col("other")).alias("is_high"),
        "doc_id", "n", "component")


# --- the join ----------------------------------------------------------------------------


def join(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(frequency_classes(docs, size))
    profiles = stored(docs.mapInArrow(
        _profiles(size, percent, classes), "doc_id long, n long, digest binary, point binary, parity binary, brief binary, shards array<long>"), "profiles")
    parts = tasks_for(spark, profiles.agg(F.sum(F.greatest("n", F.lit(LEAST)))).first()[0] or 0, SHARE)

    nodes = profiles.filter("n > 0 AND doc_id IS NOT NULL")
    copies = nodes.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).filter("c > 1").select("digest", "first")
    copies = stored(nodes.join(copies, "digest").filter("doc_id <> first").select("doc_id", "first").distinct().coalesce(parts), "copies")
    firsts = by_ids(nodes, copies, ["doc_id"], "left_anti", parts)

    leads = F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1
    # Size and lead share a column, which makes the largest shuffle a fifth smaller.
    tokens = firsts.select("doc_id", "n", leads.alias("lead"), F.posexplode("shards").alias("at", "token")).select(
        "token", "doc_id", (2 * F.col("n") + F.when(F.col("at") < F.col("lead"), 1).otherwise(0)).alias("n_and_lead"))
    shared = stored(tokens.repartition("token").sortWithinPartitions("token", "n_and_lead", "doc_id").coalesce(parts).mapInArrow(_shared, _SHARED), "shared")

    parities = firsts.select("doc_id", "n", "parity")
    with_parities = lambda pairs: pairs.join(parities.toDF("a", "na", "pa"), "a").join(parities.toDF("b", "nb", "pb"), "b").coalesce(parts)
    pair, known = "a long, b long", ["token", "doc_id", "n", "leads"]

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that their parities allow and that link."""
        return _links(docs, with_parities(pairs).mapInArrow(_bounded(percent), pair), size, percent, parts)

    near = (
        shared.filter(f"before IS NOT NULL AND before <> doc_id AND 100 * n_before >= {percent} * n")
        .groupBy("doc_id", "before").agg(F.count("*").alias("c"))
        .groupBy("doc_id").agg(F.max_by("before", F.struct("c", "before")).alias("before"))
    )
    links = verified(near.select(F.least("doc_id", "before").alias("a"), F.greatest("doc_id", "before").alias("b")).distinct())

    def contracted(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of shards that hold several components, and these shards."""
        rows = rows.select(*known).join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
            "component", F.coalesce("component", "doc_id"))
        shards = _open_shards(rows, parts)
        return stored(rows.join(shards.select("token", "n_rows"), "token").coalesce(parts), "shared"), shards

    def merged(found: DataFrame, links: DataFrame) -> DataFrame:
        return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links), parts)

    found = components(links, parts)
    shared, _ = contracted(shared, found)
    small = shared.filter(F.col("n_rows") <= LEAF).join(firsts.select("doc_id", "brief", F.slice("shards", 1, EARLY).alias("early")), "doc_id")
    small = small.select("token", "doc_id", "n", "leads", "component", "brief", "early")
    small = small.repartition("token").sortWithinPartitions("token").mapInArrow(_from_small(percent), pair).distinct()
    found = merged(found, verified(small))

    large, shards = contracted(shared.filter(F.col("n_rows") > LEAF), found)
    tested = None
    for _ in range(ROUNDS):
        if shards.isEmpty():
            break
        near = large.repartition("token").sortWithinPartitions("token", "n", "doc_id").mapInArrow(_neighbours(percent), pair)
        near = near.groupBy("a", "b").agg(F.count("*").alias("c"))
        near = near if tested is None else near.join(tested, ["a", "b"], "left_anti")
        ends = near.select("a", "b", "c", F.explode(F.array("a", "b")).alias("doc_id"))
        picked = stored(
            ends.groupBy("doc_id").agg(F.max_by(F.struct("a", "b"), F.struct("c", "a", "b")).alias("p")).select("p.*").distinct().coalesce(parts), "picked")
        if picked.isEmpty():
            break
        found = merged(found, verified(picked))
        tested = picked if tested is None else tested.union(picked)
        large, shards = contracted(large, found)
    for most in (FIRST_PAIRS, None):
        if shards.isEmpty():
            break
        blocks = _blocked(large.drop("n_rows"), shards).join(firsts.select("doc_id", "point", "parity"), "doc_id").select(
            "token", "low", "high", "is_low", "is_high", "doc_id", "n", "component", "point", "parity")
        pairs = blocks.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high").mapInArrow(_from_large(percent, most), pair).distinct()
        pairs = stored((pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")).coalesce(parts), "pairs")
        found = merged(found, _links(docs, pairs, size, percent, parts))
        tested = pairs if tested is None else tested.union(pairs)
        if most is not None:
            large, shards = contracted(large, found)

    whole = merged(found, copies.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    return profiles.select("doc_id", F.col("n").alias("n_shingles")).join(
        whole.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left",
    ).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of its component, with their columns.

    Rows with a null id stay; so do all rows of an id that stays.
    """
    parts = tasks_for(docs.sparkSession, LEAST * docs.count(), SHARE)
    gone = join(docs, size, percent, id_col, text_col).filter("component_id <> doc_id").select(F.col("doc_id").alias("gone"))
    rows = docs.select(F.col(id_col).cast("long").alias("gone"), F.struct("*").alias("row"))
    return by_ids(rows, gone, ["gone"], "left_anti", parts).select("row.*")
