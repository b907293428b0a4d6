"""Removal of long repeats by prefix-free parsing.

Every window of ``length`` bytes chooses a trigger inside itself: the place with the smallest
rolling hash among its first ``length // 2`` starts.  Equal windows choose alike, so the
triggers cut equal stretches of the corpus into equal phrases, and no phrase is longer than
half a window.  The windows of one trigger start in one phrase and run through the next ones.

1. The dictionary counts, for each trigger, what all its windows share (the core) and all they
   cover (the reach).  A core seen once settles that nothing repeats, a reach seen twice that
   everything does.  In repetitive text that is nearly all; no text is moved for it.
2. The rest lies around the ends of repeats.  Their stretches are brought together by core, and
   each task builds the suffix order of its stretches by prefix doubling up to ``length`` bytes;
   windows of equal rank repeat.
3. A core with very many open stretches is not gathered.  Its windows reach at least half of what they
   may to the left of it, or to the right, so each stretch goes to two longer cores with half the windows
   each; longer cores that one stretch alone has are settled, and those that are still too frequent are split again.
4. The bytes of repeating windows are cut out, judged on the input as a whole.

Equality rests on 64-bit hashes in step 1 and on bytes in step 2; hashes of step 3 only bring stretches
together, but for single windows that are more frequent than a task gathers.

Cases: a null text counts as empty; texts shorter than a window stay whole; exact copies and
repeated rows are each other's repeats, so all of them lose these bytes; rows are told apart by
id and text, null ids are allowed; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.ids import by_ids
from strideline.llm.words import mixed, running, spans
from strideline.materialise import stored

GRAM = 16
#: Bytes of a text that are handled at once, and stretches of a core that are gathered.
PART, MOST_GATHERED = 2_000_000, 2000
#: Bytes of stretches that are ranked at once.
RANKED = 1_000_000
KEY = ["id", "hash"]
_KEY_SQL = "id long, hash long"


def _parts(batches, length: int):
    """Loads of ``(row key, offset, bytes)``; long texts come in parts that share windows."""
    load, size = [], 0
    for batch in batches:
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = (key[2].as_py() or "").encode()
            for at in range(0, max(len(data) - length + 1, 0), PART):
                part = data[at : at + PART + length - 1]
                load.append((key[0], key[1], at, part))
                size += len(part)
                if size >= PART:
                    yield load
                    load, size = [], 0
    if load:
        yield load


def triggers(parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of each trigger: core and reach hashes, part, first and last start of its windows, and its own place."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    end = np.cumsum(size)
    sums, at = running(data), np.arange(len(data))
    gram, among = min(GRAM, length - length // 2), length // 2
    low = np.full(len(data), np.uint64(2**64 - 1))
    n = len(data) - gram + 1
    low[:n] = (spans(sums, at[:n], at[:n] + gram) & np.uint64(0xFFFFFFFF00000000)) | at[:n].astype(np.uint64)
    covered = 1
    while covered < among:  # running minimum by doubling
        step = min(covered, among - covered)
        low[:-step] = np.minimum(low[:-step], low[step:])
        covered += step
    part = np.repeat(np.arange(len(parts)), size)
    starts = at[at + length <= end[part]]
    place, part = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64), part[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    lo, hi = starts[first], starts[np.concatenate((first[1:] - 1, [len(starts) - 1]))] if len(first) else starts[first]
    place, part = place[first], part[first]
    base = (end - size)[part]
    return spans(sums, place, place + length - among + 1), spans(sums, lo, hi + length), part, lo - base, hi - base, place - base


_TRIGGERS = f"core long, reach long, seen long, {_KEY_SQL}, lo long, hi long"


def _parsed(length: int):
    """Rows of triggers; equal reaches of a load become one row with a count, beside rows

    without hashes for the places they cover.
    """
    def run(batches):
        for load in _parts(batches, length):
            core, reach, part, lo, hi, _ = triggers([p[3] for p in load], length)
            ids, hashes, offsets = (np.array([p[k] for p in load], np.int64) for k in (0, 1, 2))
            _, first, inverse, seen = np.unique(np.stack((core, reach)), axis=1, return_index=True, return_inverse=True, return_counts=True)
            again = seen[inverse.ravel()] > 1
            one = first[seen > 1]
            alone = np.flatnonzero(~again)
            # Neighbouring places that are settled are one stretch.
            s = np.flatnonzero(again)
            starts = np.ones(len(s), bool)
            starts[1:] = (part[s][1:] != part[s][:-1]) | (lo[s][1:] != hi[s][:-1] + 1)
            begin = np.flatnonzero(starts)
            stop = np.concatenate((begin[1:] - 1, [len(s) - 1])) if len(begin) else begin
            rows = np.concatenate((alone, one, s[begin]))
            n, m, k = len(alone), len(one), len(begin)
            hashed = np.r_[np.zeros(n + m, bool), np.ones(k, bool)]
            last = np.concatenate((hi[rows[: n + m]], hi[s[stop]]))
            off = offsets[part[rows]]
            yield pa.RecordBatch.from_arrays([
                pa.array(core[rows].view(np.int64), mask=hashed), pa.array(reach[rows].view(np.int64), mask=hashed),
                pa.array(np.concatenate((np.ones(n, np.int64), seen[seen > 1], np.zeros(k, np.int64)))),
                pa.array(ids[part[rows]]), pa.array(hashes[part[rows]]),
                pa.array(lo[rows] + off), pa.array(last + off),
            ], ["core", "reach", "seen", "id", "hash", "lo", "hi"])

    return run


_STRETCHES = f"core long, {_KEY_SQL}, lo long, bytes binary"


def _cut_out(length: int):
    """The bytes of the open stretches of each text."""
    def run(batches):
        schema = pa.schema([("core", pa.int64()), ("id", pa.int64()), ("hash", pa.int64()), ("lo", pa.int64()), ("bytes", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                data = r["text"].encode()
                open_ = r["open"]
                n = len(open_)
                yield pa.RecordBatch.from_arrays([
                    pa.array([o["core"] for o in open_], pa.int64()), pa.array([r["id"]] * n, pa.int64()), pa.array([r["hash"]] * n, pa.int64()),
                    pa.array([o["lo"] for o in open_], pa.int64()), pa.array([data[o["lo"] : o["hi"] + length] for o in open_], pa.binary()),
                ], schema=schema)

    return run


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the stretches of ``length`` bytes at ``starts``; equal ones have equal ranks.

    Prefix doubling: a rank of 2n bytes comes from the ranks of two halves.  Only places that
    a longer rank builds on are ranked.
    """
    sizes = [1]
    while 2 * sizes[-1] <= length:
        sizes.append(2 * sizes[-1])
    wanted = np.zeros(len(data), bool)
    wanted[starts] = True
    wanted[starts + length - sizes[-1]] = True
    levels = [wanted]
    for n in reversed(sizes[:-1]):
        wanted = wanted.copy()
        wanted[n:] |= levels[-1][:-n]
        levels.append(wanted)
    levels = levels[::-1]
    rank = data.astype(np.int64)
    top = 256
    # Up to 8 bytes the value itself is the rank.
    for n, level in zip(sizes[1:], levels[1:], strict=True):
        at = np.flatnonzero(level)
        pair = rank[at].astype(np.uint64) * np.uint64(top) + rank[np.minimum(at + n // 2, len(data) - 1)].astype(np.uint64)
        if top <= 65536 and n <= 4:
            names, top = pair.astype(np.int64), top * top
        else:
            distinct, names = np.unique(pair, return_inverse=True)
            top = len(distinct) + 1
        rank = np.zeros(len(data), np.int64)
        rank[at] = names
    pair = rank[starts].astype(np.uint64) * np.uint64(top) + rank[starts + length - sizes[-1]].astype(np.uint64)
    return np.unique(pair, return_inverse=True)[1]


_SPANS = f"{_KEY_SQL}, start long, stop long"


def _spans_of(ids, hashes, starts, length: int) -> pa.RecordBatch:
    """Rows of the stretches that windows at ascending ``starts`` of equal keys cover."""
    new = np.ones(len(starts), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(starts) - 1])) if len(first) else first
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[first]), pa.array(hashes[first]), pa.array(starts[first]), pa.array(starts[last] + length)], ["id", "hash", "start", "stop"])


def _ordered(length: int):
    """Repeats among stretches sorted by core; groups are whole in a load."""
    def resolve(t: pa.Table) -> pa.RecordBatch:
        raw = t.column("bytes").to_pylist()
        size = np.array([len(b) for b in raw])
        data, base = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size
        n = size - length + 1
        row = np.repeat(np.arange(len(raw)), n)
        starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + base[row]
        rank = suffix_ranks(data, starts, length)
        hit = np.flatnonzero(np.bincount(rank)[rank] > 1)
        row, at = row[hit], starts[hit] - base[row[hit]]
        ids, hashes, lo = (t.column(c).to_numpy()[row] for c in ("id", "hash", "lo"))
        return _spans_of(ids, hashes, lo + at, length)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            core = held.column("core").to_numpy()
            other = np.flatnonzero(core != core[-1])
            whole = int(other[-1]) + 1 if len(other) else 0
            yield from map(resolve, loads(held.slice(0, whole)))
            held = held.slice(whole)
        if held is not None:
            yield from map(resolve, loads(held))

    def loads(t: pa.Table):
        """Tables of whole groups with about a million bytes each."""
        if not t.num_rows:
            return
        core = t.column("core").to_numpy()
        bounds = np.flatnonzero(np.concatenate((core[1:] != core[:-1], [True]))) + 1
        size = np.cumsum(np.fromiter((len(b) for b in t.column("bytes").to_pylist()), np.int64, t.num_rows))
        first, before = 0, 0
        for stop in bounds:
            if size[stop - 1] - before >= RANKED or stop == t.num_rows:
                yield t.slice(first, stop - first)
                first, before = stop, size[stop - 1]

    return run


_LONGER = f"token long, core long, {_KEY_SQL}, lo long, a int, b int, first long, last long"


def _longer_cores(length: int):
    """Of stretches with their nodes, the two halves of each node.

    A node ``(a, b)`` is the windows that reach at least ``a`` bytes to the left of the core and ``b`` to the right of
    it; its token is the hash of the core with these bytes.
    """
    free = length // 2 - 1
    inner = length - free
    schema = pa.schema([(c, pa.int64()) for c in ("token", "core", "id", "hash", "lo")] + [("a", pa.int32()), ("b", pa.int32()), ("first", pa.int64()), ("last", pa.int64())])

    def halves(row: dict):
        data = np.frombuffer(row["bytes"], np.uint8)
        place, sums = int(triggers([row["bytes"]], length)[5][0]), running(data)
        for node in row["nodes"]:
            a, b = node["a"], node["b"]
            middle = (a + free - b + 1) // 2
            for x, y in ((middle, b), (a, free - middle + 1)):
                first, last = max(0, place - (free - y)), min(len(data) - length, place - x)
                if first <= last:
                    token = spans(sums, np.array([place - x]), np.array([place + inner + y])) ^ mixed(np.array([1024 * x + y], np.uint64))
                    yield token.view(np.int64)[0], row["core"], row["id"], row["hash"], row["lo"], x, y, row["lo"] + first, row["lo"] + last

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = [r for row in batch.slice(at, 1000).to_pylist() for r in halves(row)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _sub_stretches(length: int):
    """The bytes of the windows of each node, under the node's token."""
    schema = pa.schema([("core", pa.int64()), ("id", pa.int64()), ("hash", pa.int64()), ("lo", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = [(n["token"], r["id"], r["hash"], n["first"], r["bytes"][n["first"] - r["lo"] : n["last"] - r["lo"] + length])
                        for r in batch.slice(at, 1000).to_pylist() for n in r["nodes"]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _split_cores(hot: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stretches of frequent cores under longer cores that a task can gather, and spans that need no comparison."""
    at, free = ["core", *KEY, "lo"], length // 2 - 1
    nodes = hot.select(*at, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))).alias("nodes"))
    stretches, settled = [], []
    while not nodes.isEmpty():
        tokens = stored(hot.join(nodes, at).mapInArrow(_longer_cores(length), _LONGER), "longer")
        counts = tokens.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1")
        met = stored(tokens.join(counts, "token"), "met")
        few = met.filter(F.col("c") <= MOST_GATHERED).groupBy(*at).agg(F.collect_list(F.struct("token", "first", "last")).alias("nodes"))
        stretches.append(hot.join(few, at).mapInArrow(_sub_stretches(length), _STRETCHES))
        many = met.filter(F.col("c") > MOST_GATHERED)
        settled.append(many.filter(F.col("a") + F.col("b") == free).select(*KEY, F.col("first").alias("start"), (F.col("first") + length).alias("stop")))
        nodes = stored(many.filter(F.col("a") + F.col("b") < free).groupBy(*at).agg(F.collect_list(F.struct("a", "b")).alias("nodes")), "nodes")
    return stretches, settled


def _removed(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
    for batch in batches:
        rows = []
        for doc_id, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data, merged = text.as_py().encode(), []
            for s in sorted((s["start"], s["stop"]) for s in found):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            edges = [0, *(e for m in merged for e in m), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((doc_id, len(data), [{"start": a, "stop": b} for a, b in merged], kept))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, spans (removed), kept (the other bytes)."""
    if length < 2:
        raise ValueError("length must be at least 2")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), F.xxhash64(text).alias("hash"))
    parsed = stored(rows.filter(F.octet_length("text") >= length).select("id", "hash", "text").mapInArrow(_parsed(length), _TRIGGERS), "triggers")

    reaches = parsed.filter("core IS NOT NULL").groupBy("core", "reach").agg(F.sum("seen").alias("seen"))
    cores = reaches.groupBy("core").agg(F.sum("seen").alias("all"), F.when(F.expr("count_if(seen = 1)") > 0, F.count("*")).otherwise(0).alias("open"))
    shared = reaches.join(cores.filter("all > 1"), "core").select("core", "reach", "open", (F.col("seen") > 1).alias("whole"))
    placed = stored(
        parsed.filter("core IS NOT NULL").join(shared, ["core", "reach"])
        .select("core", "reach", "whole", "open", "id", "hash", "lo", "hi"), "placed")

    # Of reaches seen again, one stands for all where open ones have to be compared with it.
    settled = placed.filter("whole AND open > 0").groupBy("core", "reach", "open").agg(F.min(F.struct(*KEY, "lo", "hi")).alias("at"))
    todo = stored(placed.filter("NOT whole").select("core", *KEY, "lo", "hi", "open").union(settled.select("core", "at.*", "open")), "open")
    lists = todo.groupBy("id", "hash").agg(F.collect_list(F.struct("core", "lo", "hi", "open")).alias("open"))
    texts = by_ids(rows.select("id", "hash", "text"), todo, KEY, "left_semi").dropDuplicates(KEY)
    one = lambda condition: texts.join(lists.select(*KEY, F.filter("open", condition).alias("open")).filter("size(open) > 0"), KEY).select(
        *KEY, "text", F.transform("open", lambda o: F.struct(o["core"], o["lo"], o["hi"])).alias("open")).mapInArrow(_cut_out(length), _STRETCHES)
    few = one(lambda o: o["open"] <= MOST_GATHERED)
    frequent = stored(one(lambda o: o["open"] > MOST_GATHERED), "frequent")
    more, settled_spans = _split_cores(frequent, length)
    for part in more:
        few = few.union(part)
    found = few.repartition("core").sortWithinPartitions("core", *KEY, "lo").mapInArrow(_ordered(length), _SPANS)

    pieces = [
        placed.filter("whole").select(*KEY, F.col("lo").alias("start"), (F.col("hi") + length).alias("stop")),
        parsed.filter("core IS NULL").select(*KEY, F.col("lo").alias("start"), (F.col("hi") + length).alias("stop")),
        found,
    ]
    pieces += settled_spans
    spans_ = pieces[0]
    for p in pieces[1:]:
        spans_ = spans_.union(p)
    spans_ = stored(spans_.groupBy(*KEY).agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")

    out = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
    touched = by_ids(rows, spans_, KEY, "left_semi").join(spans_, KEY).select("doc_id", "text", "spans").mapInArrow(_removed, out)
    whole = by_ids(rows, spans_, KEY, "left_anti").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<start:long,stop:long>>").alias("spans"), F.col("text").cast("binary").alias("kept"))
    return whole.union(touched)
