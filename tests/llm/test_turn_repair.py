"""Repair of turns against a plain dynamic programme over all edits."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from strideline.llm import turn_repair, turns

SCHEMA = "conv_id long, turn long, role string, text string, audit int, place int"
GIVES = re.compile("(s?(ua)+)?")


def found_faults(rows):
    """rows: (turn, role, text) in order, nulls replaced."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, turns) by trying all edits turn by turn; the least (cost, audit) for each end of the output."""

    def state(initials):
        return initials[-1] if initials else ""

    def legal(before, nxt):
        return before + nxt in ("s", "u", "su", "ua", "au")

    now = {"": (0, "", ())}

    def put(into, key, value):
        if key not in into or value[:2] < into[key][:2]:
            into[key] = value

    def inserted(layer):
        out = dict(layer)
        for _ in range(2):
            for before, (cost, audit, made) in list(out.items()):
                for role in ("user", "assistant"):
                    if legal(before, role[0]):
                        put(out, role[0], (cost + 2, audit + "I", (*made, (role, ""))))
        return out

    for (_, role, text), fault in zip(rows, faults, strict=True):
        nxt = {}
        for before, (cost, audit, made) in inserted(now).items():
            put(nxt, before, (cost + 3, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if role[:1] in ("s", "u", "a") and legal(before, role[:1]):
                put(nxt, role[:1], (cost + extra, audit + "K", (*made, (role, text))))
            for new in ("user", "assistant"):
                if legal(before, new[0]):
                    put(nxt, new[0], (cost + extra + 2, audit + "R", (*made, (new, text))))
        now = nxt
    ends = [v for k, v in inserted(now).items() if k in ("", "a")]
    return min(ends, key=lambda v: v[:2])


def expected(table):
    out = {}
    convs = {}
    for conv, turn, role, text, *_ in table:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        faults = found_faults(rows)
        cost, audit, made = cheapest(rows, faults)
        assert GIVES.fullmatch("".join(r[:1] for r, _ in made))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def got(spark, table, partitions=3):
    df = spark.createDataFrame([(*r, None, 1) for r in table], SCHEMA).repartition(partitions)
    report, repaired = turn_repair.repair(df)
    digests = {r.key: r.sha256 for r in turns.joined_sha256(repaired.select(F.col("conv_id").alias("key"), F.concat_ws(":", "role", "text").alias("piece")), "\n").collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*r[1:], digests.get(r.conv_id, empty)) for r in report.collect()}


def conversation(rnd, conv, n, mess):
    roles = ["user", "assistant"]
    rows = [(conv, 0, "system", "Be kind.")] if rnd.random() < 0.4 else []
    for i in range(n):
        role, text = roles[i % 2], f"t{rnd.randrange(4 * n)}" + rnd.choice([".", "!", "?", "", "? \n"])
        if rnd.random() < mess:
            role = rnd.choice(["user", "assistant", "system", "tool", "", None])
        if rnd.random() < mess:
            text = rnd.choice(["", " \n", None, "same.", text, "é"])
        rows.append((conv, rnd.choice([None, i]) if rnd.random() < 0.1 else i + rnd.randrange(3), role, text))
    return rows + rnd.sample(rows, min(len(rows), rnd.randrange(3)))


def test_small_conversations(spark):
    rnd = random.Random(5)
    table = [r for c in range(150) for r in conversation(rnd, c, rnd.randrange(0, 9), rnd.choice([0, 0.2, 0.7]))]
    table += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, None, None, None)]
    assert got(spark, table) == expected(table)


@pytest.mark.parametrize("segment,fanout", [(64, 32), (5, 2)])
def test_long_conversation_over_many_parts(spark, monkeypatch, segment, fanout):
    monkeypatch.setattr(turn_repair, "SEGMENT", segment)
    monkeypatch.setattr(turn_repair, "FANOUT", fanout)
    turn_repair.matrix.cache_clear()
    rnd = random.Random(segment)
    table = conversation(rnd, 1, 700, 0.3) + [r for c in range(2, 40) for r in conversation(rnd, c, 4, 0.3)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark, table, 8) == expected(table)
        parts = turns.in_order(spark.createDataFrame([(*r, None, 1) for r in table], SCHEMA).drop("place"), ["conv_id", "turn"])
        assert parts.filter("conv_id = 1").select(F.shiftright("place", turns.PART_BITS)).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_auction_prices_are_dual():
    rnd = random.Random(3)
    for _ in range(200):
        codes = "".join(rnd.choice("suaxSUAX0123") for _ in range(rnd.randrange(1, 30)))
        exits = list(turn_repair.CLOSING_COST)
        arcs, price = turn_repair._turn_lattice(codes, exits)
        length = turn_repair.auction(arcs, price, 0, len(arcs) - 1)
        assert all(price[i] <= c + price[j] for i, out in enumerate(arcs) for c, j in out)
        path = turn_repair.traced(arcs, price, 0, len(arcs) - 1)
        assert sum(arcs[i][k][0] for i, k in path) == length == price[0]
        assert turn_repair.border_costs([turn_repair.matrix(codes)], exits)[0][0] == length


def test_cases(spark):
    assert got(spark, []) == {}
    same = [(7, 1, "user", "hi.")] * 500 + [(7, 2, "assistant", "yes")]
    assert got(spark, same) == expected(same)
    alone = [(1, None, "user", None), (2, 5, "assistant", "x" * 300_000), (3, -4, "system", "s.")]
    assert got(spark, alone) == expected(alone)
