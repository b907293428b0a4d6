"""Repair of the turn structure of conversations by the auction algorithm for shortest paths.

A conversation is legal when the initials of its roles are ``(s?(ua)+)?``.  Edits keep a turn
(0), give it the other role (2), delete it (3; blank and repeated turns must go) or insert an
empty turn (2); a truncated turn that stays costs 1 more.  The cheapest edits are a shortest
path over the lattice of (turns read, what may follow), with integer costs.

The auction keeps a price for each node of the lattice, never above the cost of an arc plus
the price at its end.  From the last node of the path it goes on over an arc that is tight, or,
when none is, raises the price to the least such sum and takes the node back from the path.  At the
goal the prices are dual to the shortest path: its arcs are the tight ones, and they are
traced in alphabetical order of the edits, stepping back from dead ends.  Prices start at the sums of
what each turn costs at least, so they rise only where the structure is broken.

Long conversations are cut: a segment of at most 64 turns is a matrix of costs from each state
to each state, found by auctions; matrices are arcs of a coarser lattice, which again is cut at
32.  A conversation spans several tasks as pieces of a range partitioning, and only one matrix
for each piece travels to the task that prices the borders between them.

Cases: a null role or text counts as one space, a role that starts with none of s, u, a can't
be kept; order and ties as in :mod:`strideline.llm.turns`; rows without ``conv_id`` are one
conversation; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.turns import PART_BITS, in_order, text_key
from strideline.materialise import stored

INF = math.inf
SEGMENT, FANOUT = 64, 32
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

# What has been written so far: nothing, the system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The turn that may be inserted, or that a turn may be made to.
MADE = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Inserted turns that end a conversation, and their cost.
CLOSING = ("", "II", "I", "")
CLOSING_COST = [INSERT * len(x) for x in CLOSING]

#: A turn's code: its initial, in capitals if truncated; a digit if it must go.
_FORCED = {"s": "1", "u": "2", "a": "3", "x": "0"}
_INITIAL = {v: k for k, v in _FORCED.items()}


def initial(code: str) -> str:
    return _INITIAL.get(code, code.lower())


def _edits(code: str, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, turns read, next state) in the order of the edits' names."""
    out = [("D", DELETE, 1, state), ("I", INSERT, 0, MADE[state])]
    if code not in _INITIAL:
        extra = TRUNCATED if code.isupper() else 0
        if (kept := _KEPT.get((state, code.lower()))) is not None:
            out.append(("K", KEEP + extra, 1, kept))
        out.append(("R", REROLE + extra, 1, MADE[state]))
    return out


_EDITS = {c: [_edits(c, s) for s in STATES] for c in "suaxSUAX0123"}
_LEAST = {c: min(e[1] for s in STATES for e in _EDITS[c][s] if e[2]) for c in _EDITS}


def auction(arcs: list[list[tuple[int, int]]], price: list[float], origin: int, goal: int) -> float:
    """Length of the shortest path; raises ``price``, which must not exceed arc plus price at its end."""
    path = [origin]
    while (i := path[-1]) != goal:
        best, at = INF, -1
        for cost, j in arcs[i]:
            if cost + price[j] < best:
                best, at = cost + price[j], j
        if best > price[i] or best == INF:
            price[i] = best
            if len(path) > 1:
                path.pop()
            elif best == INF:
                return INF
        else:
            path.append(at)
    return price[origin] - price[goal]


def traced(arcs: list[list[tuple[int, int]]], price: list[float], origin: int, goal: int) -> list[tuple[int, int]]:
    """The first path of tight arcs in the order of the arcs, as (node, number of its arc)."""
    path, dead = [(origin, -1)], set()
    while path[-1][0] != goal:
        i, tried = path[-1]
        for k in range(tried + 1, len(arcs[i])):
            cost, j = arcs[i][k]
            if j not in dead and price[i] == cost + price[j]:
                path[-1] = (i, k)
                path.append((j, -1))
                break
        else:
            dead.add(i)
            path.pop()
    return path[:-1]


def _priced(layers: int, least: list[float], reach: list[bool]) -> list[float]:
    """Prices of all nodes and the goal at the start: what the layers from here on cost at least."""
    out, total = [0.0] * (4 * layers + 5), 0.0
    for k in range(layers, -1, -1):
        if k < layers:
            total += least[k]
        out[4 * k : 4 * k + 4] = [total if reach[s] else INF for s in STATES]
    return out


def _reach(exits: list[float]) -> list[bool]:
    """States from which a wanted state can follow: nothing leads back to the start or the system turn."""
    open_ = [e < INF for e in exits]
    return [any(open_), any(open_[SYSTEM:]), open_[USER] or open_[ASSISTANT], open_[USER] or open_[ASSISTANT]]


def _turn_lattice(codes: str, exits: list[float]):
    n = len(codes)
    arcs = [[(e[1], 4 * (k + e[2]) + e[3]) for e in _EDITS[c][s]] for k, c in enumerate(codes) for s in STATES]
    arcs += [[(exits[s], 4 * n + 4)] if exits[s] < INF else [] for s in STATES] + [[]]
    return arcs, _priced(n, [_LEAST[c] for c in codes], _reach(exits))


def matrix_lattice(matrices: list, exits: list[float]):
    """Nodes are (matrix, state), arcs are the matrices' finite costs; the last node is the goal."""
    n = len(matrices)
    arcs = [[(m[s][t], 4 * (k + 1) + t) for t in STATES if m[s][t] < INF] for k, m in enumerate(matrices) for s in STATES]
    arcs += [[(exits[s], 4 * n + 4)] if exits[s] < INF else [] for s in STATES] + [[]]
    return arcs, _priced(n, [min(min(r) for r in m) for m in matrices], _reach(exits))


def _only(state: int) -> list[float]:
    return [0 if s == state else INF for s in STATES]


def _parts(codes: str) -> list[str]:
    size = SEGMENT
    while size * FANOUT < len(codes):
        size *= FANOUT
    return [codes[i : i + size] for i in range(0, len(codes), size)]


@lru_cache(4096)
def matrix(codes: str) -> tuple:
    """Least cost of reading the turns, from each state to each state."""
    if len(codes) > SEGMENT:
        inner = [matrix(c) for c in _parts(codes)]
        lattice = lambda exits: matrix_lattice(inner, exits)
    else:
        lattice = lambda exits: _turn_lattice(codes, exits)
    columns = []
    for end in STATES:
        arcs, price = lattice(_only(end))
        columns.append([auction(arcs, price, s, len(arcs) - 1) if price[s] < INF else INF for s in STATES])
    return tuple(tuple(columns[t][s] for t in STATES) for s in STATES)


def border_costs(matrices: list, exits: list[float]) -> list[list[float]]:
    """Least cost to the end from each state in front of each matrix, and behind the last one."""
    arcs, price = matrix_lattice(matrices, exits)
    goal = len(arcs) - 1
    for node in range(goal - 1, -1, -1):
        if price[node] < INF:
            auction(arcs, price, node, goal)
    return [price[4 * k : 4 * k + 4] for k in range(len(matrices) + 1)]


def edits(codes: str, state: int, exits: list[float]) -> tuple[str, int]:
    """The alphabetically first of the cheapest edits, and the state behind them."""
    if len(codes) <= SEGMENT:
        return _segment_edits(codes, state, tuple(exits))
    parts, out = _parts(codes), []
    borders = border_costs([matrix(c) for c in parts], exits)
    for part, behind in zip(parts, borders[1:], strict=True):
        done, state = edits(part, state, behind)
        out.append(done)
    return "".join(out), state


@lru_cache(50_000)
def _segment_edits(codes: str, state: int, exits: tuple) -> tuple[str, int]:
    arcs, price = _turn_lattice(codes, list(exits))
    goal = len(arcs) - 1
    auction(arcs, price, state, goal)
    path = traced(arcs, price, state, goal)
    taken = [_EDITS[codes[i // 4]][i % 4][k][0] for i, k in path[:-1]]
    return "".join(taken), path[-1][0] % 4


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


# --- over tables -------------------------------------------------------------------------


def _clean(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), text_key(text).alias("text_key"))


def faults(rows: DataFrame) -> DataFrame:
    """The turns in order: ``(conv_id, turn, role, text_key, place, fault)``; fault is blank, duplicate, truncated or null."""
    clean = _clean(rows)
    bare = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    marked = clean.select("conv_id", "turn", "role", "text_key", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    ordered = in_order(marked, ["conv_id", "turn", "role", "text_key"])
    firsts = ordered.groupBy("conv_id", "role", "text_key").agg(F.min("place").alias("first")).select(
        *(F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "text_key")), "first")
    same = ordered["conv_id"].eqNullSafe(firsts["f_conv_id"]) & (ordered["role"] == firsts["f_role"]) & (ordered["text_key"] == firsts["f_text_key"])
    fault = F.when(F.col("blank"), "blank").when(F.col("first") < F.col("place"), "duplicate").when(F.col("cut"), "truncated")
    return stored(ordered.join(firsts, same).select("conv_id", "turn", "role", "text_key", "place", fault.alias("fault")), "faults")


def _matrices(batches):
    """(conv_id, part, codes) -> (conv_id, part, costs): the piece as a matrix, -1 for no way."""
    for b in batches:
        costs = [[int(x) if x < INF else -1 for row in matrix(c) for x in row] for c in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(costs, pa.list_(pa.int64()))], ["conv_id", "part", "costs"])


def _groups(batches):
    """(conv_id, its rows) from sorted batches; a conversation has a row for each part it spans at most."""
    now, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and row[0] != now:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield now, rows


def _rows_of(schema: pa.Schema, rows, size: int = 2000):
    """Batches of the rows that a generator gives."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_LONGS = pa.list_(pa.int64())
_BORDERS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("exits", _LONGS), ("cost", pa.int64()), ("first", pa.bool_())])
_CHOICES = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("cost", pa.int64()), ("initials", pa.string()), ("audits", pa.list_(pa.string())), ("ends", _LONGS), ("illegal", pa.int64())])
_AUDITS = pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def _borders(batches):
    def rows():
        for conv, pieces in _groups(batches):
            found = [[[x if x >= 0 else INF for x in p[2][4 * s : 4 * s + 4]] for s in STATES] for p in pieces]
            costs = border_costs(found, CLOSING_COST)
            for k, piece in enumerate(pieces):
                yield conv, piece[1], [int(x) for x in costs[k + 1]], int(costs[0][START]), k == 0

    yield from _rows_of(_BORDERS, rows())


def _choices(batches):
    def rows():
        for b in batches:
            for conv, part, codes, exits, cost, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                done = [edits(codes, s, exits) for s in ([START] if first else STATES)]
                marks = "".join(map(initial, codes))
                yield conv, part, cost, marks[0] + marks[-1], [d[0] for d in done], [d[1] for d in done], illegal_pairs(marks)

    yield from _rows_of(_CHOICES, rows())


def _chosen(batches):
    def rows():
        for conv, pieces in _groups(batches):
            state, audit, illegal, last = START, [], 0, ""
            for _, _, _, ends_with, audits, ends, inside in pieces:
                audit.append(audits[state])
                state, illegal = ends[state], illegal + inside + illegal_pairs(last + ends_with[0])
                last = ends_with[1]
            yield conv, pieces[0][2], illegal, "".join(audit) + CLOSING[state]

    yield from _rows_of(_AUDITS, rows(), 200)


def _whole(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part")


def audits(found: DataFrame) -> DataFrame:
    """``(conv_id, cost, illegal, audit)`` of conversations with turns; ``found`` is what :func:`faults` gives."""
    letter = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    forced = F.translate(letter, "suax", "1230")
    code = F.when(F.col("fault").isin("blank", "duplicate"), forced).when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    part = F.shiftright("place", PART_BITS).alias("part")
    # A piece holds the turns that a conversation has in one range partition, a character each.
    letters = F.sort_array(F.collect_list(F.struct("place", code.alias("code"))))
    pieces = stored(found.groupBy("conv_id", part).agg(F.array_join(F.transform(letters, lambda x: x["code"]), "").alias("codes")), "pieces")
    costs = pieces.mapInArrow(_matrices, "conv_id long, part long, costs array<long>")
    borders = _whole(costs).mapInArrow(_borders, "conv_id long, part long, exits array<long>, cost long, first boolean")
    at = borders.withColumnsRenamed({"conv_id": "b_conv", "part": "b_part"})
    both = pieces.join(at, pieces["conv_id"].eqNullSafe(at["b_conv"]) & (pieces["part"] == at["b_part"])).select("conv_id", "part", "codes", "exits", "cost", "first")
    choices = both.mapInArrow(_choices, "conv_id long, part long, cost long, initials string, audits array<string>, ends array<long>, illegal long")
    return _whole(choices).mapInArrow(_chosen, "conv_id long, cost long, illegal long, audit string")


def _applied(batches):
    """Turns behind their conversation's audit (the row without a text) -> the turns after the edits."""

    def rows():
        conv, audit, at, state, place, closing = None, "", 0, START, 0, 0
        for b in batches:
            for own, text, role, given in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "role", "audit")), strict=True):
                if text is None:
                    conv, audit, at, state, place, closing = own, given, 0, START, 0, len(given.rstrip("I"))
                    continue
                done = False
                while at < len(audit) and (not done or at >= closing):
                    edit, at = audit[at], at + 1
                    done |= edit != "I"
                    if edit == "D":
                        continue
                    state, place = (_KEPT[state, role[0]] if edit == "K" else MADE[state]), place + 1
                    yield conv, place, (role if edit == "K" else ROLE[state]), ("" if edit == "I" else text), edit

    yield from _rows_of(_TURNS, rows(), 500)


def repaired(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """``(conv_id, place, role, text, edit)``: the turns after the edits, in order within their partition.

    A conversation's turns stream through one task, in which their edits meet them one by one.
    """
    turns = _clean(rows).withColumn("audit", F.lit(None).cast("string"))
    heads = audit.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("text_key"), "audit")
    order = [F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), *(F.col(c).asc_nulls_first() for c in ("turn", "role", "text_key"))]
    both = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions(*order)
    return both.mapInArrow(_applied, "conv_id long, place long, role string, text string, edit string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of each
    conversation, and its turns after the edits as :func:`repaired` gives them."""
    found = faults(rows)
    kind = lambda name: F.count_if(F.coalesce(F.col("fault") == name, F.lit(False))).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    counts = found.groupBy(F.col("conv_id").alias("c")).agg(gaps, kind("blank"), kind("duplicate"), kind("truncated"))
    done = stored(audits(found), "audits")
    report = done.join(counts, done["conv_id"].eqNullSafe(counts["c"])).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return report, repaired(rows, done)
