"""Prefix trie against all prefixes of all conversations."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strideline.llm import prefix_trie


def expected(table):
    convs = {}
    for conv, turn, role, text in table:
        if conv is not None:
            convs.setdefault(conv, []).append((turn, role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))] for c, rows in convs.items()}
    paths = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + rows[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    out, done = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(node[-1][1].split()) if node else 0
        kids = children.get(node, [])
        saved = (len(members[node]) - 1) * words + sum(done[k][1] for k in kids)
        leaves = sum(done[k][0] for k in kids) if kids else 1
        done[node] = (leaves, saved)
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if len(paths[c]) == len(node)))
        out[min(members[node]), len(node)] = (min(members[node[:-1]]) if node else None, len(members[node]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def got(spark, table):
    df = spark.createDataFrame([(*r, "k", 3) for r in table], "conv_id long, turn long, role string, text string, key string, depth int").repartition(4)
    conv = F.col("conv_id")
    turns, every = prefix_trie.rebuilt(df, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4)
    nodes, ends = prefix_trie.trie(turns, every)
    shas = {(r.depth, r.key): r.ends_sha256 for r in prefix_trie.member_digests(ends).collect()}
    rows = nodes.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, shas.get((r.depth, r.key), hashlib.sha256(b"").hexdigest())) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed,block,slices", [(0, 4, 64), (1, 2, 2), (2, 3, 4)])
def test_trie(spark, monkeypatch, seed, block, slices):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "SLICE", slices)
    monkeypatch.setattr(prefix_trie, "IDS", 8)
    rnd = random.Random(seed)
    table = []
    for c in rnd.sample(range(150), 110):
        shared = rnd.choice([0, 0, 5, 9])
        for i in range(rnd.randrange(1, 14)):
            same = i < shared or rnd.random() < 0.5
            table.append((c, None if i == 0 and rnd.random() < 0.2 else i, rnd.choice(["user", None, ""]) if not same else "user", f"w{i if same else rnd.randrange(3)} two \x1cthree"))
    table += [(300, i, "user", f"w{i} two \x1cthree") for i in range(40)] + [(301, i, "user", f"w{i} two \x1cthree") for i in range(37)]
    table += [(None, 1, "user", "x"), (400, None, None, None), (400, None, None, None), (402, 1, None, "")]
    assert got(spark, table) == expected(table)


def test_cases(spark):
    assert got(spark, []) == {}
    one = [(7, 1, "user", "hi there")]
    assert got(spark, one) == expected(one)
    copies = [(c, t, "user", "long " * 2000) for c in range(0, 60, 3) for t in range(6)]
    assert got(spark, copies) == expected(copies)
