import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strideline.llm import ngram_join
from strideline.llm.components import components
from strideline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sets(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, percent=75):
    """doc -> (set size, smallest id reachable), comparing all pairs."""
    s = {d: sets(t) for d, t in docs}
    up = {d: d for d in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if s[a] and s[b] and 4 * min(len(s[a]), len(s[b])) >= 3 * max(len(s[a]), len(s[b])) and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s[d]), root(d)) for d in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def made(seed=0, groups=12, copies=9):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnopqrst") + str(rnd.randint(0, 60))
    passage, texts = [word() for _ in range(30)], []
    for _ in range(groups):
        base = [word() for _ in range(rnd.randint(1, 120))]
        if rnd.random() < 0.5:
            base[:0] = passage
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 18))):
                k = rnd.randrange(len(w))
                w[k : k + rnd.randint(0, 1)] = [word()] * rnd.randint(0, 2)
            texts.append(rnd.choice([" ", "\n", "\t"]).join(x.upper() if rnd.random() < 0.1 else x for x in w))
    return [(i * 7 % 1009, t) for i, t in enumerate(texts + ["", " ", "one two", "One  TWO", "one two three", "É a b c d", "é a b c d"])]


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("leaf,block", [(64, 1024), (4, 5)])
def test_equals_all_pairs(spark, seed, leaf, block, monkeypatch):
    # Small blocks send every shard through trees and pairs of blocks.
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = made(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, component long")
    assert result(ngram_join.join(df)) == brute(docs)


@pytest.mark.parametrize("percent", [50, 90])
def test_other_thresholds(spark, percent):
    # Sets of 100 that share 70 frequent windows, which stand behind the 30 rare ones of each.
    passage = [f"p{i}" for i in range(74)]
    texts = [" ".join(passage + [f"d{k}x{i}" for i in range(30)]) for k in range(6)] + [t for _, t in made(3, 6, 5)]
    docs = list(enumerate(texts))
    s = {d: sets(t) for d, t in docs}
    want = {d: d for d in s}
    for a in sorted(s):
        for b in range(a + 1, len(docs)):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]) and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = {d: low if c == high else c for d, c in want.items()}
    got = result(ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), percent=percent))
    assert got == {d: (len(s[d]), want[d]) for d in s}


def test_neighbours_stream_a_shard():
    rows = [(token, 10 * token + i, 100 + i, i % 3) for token in (1, 2) for i in range(9)]
    names, read = ["token", "doc_id", "n", "component"], []

    def batches():
        for a in range(0, len(rows), 2):
            read.append(a)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + 2], strict=True)], names)

    out, got = ngram_join._neighbours(75)(batches()), []
    got += next(out).to_pylist()
    assert read == [0]
    for batch in out:
        got += batch.to_pylist()
    assert [(r["a"], r["b"]) for r in got] == [(x[1], y[1]) for x, y in zip(rows, rows[1:]) if x[0] == y[0]]


def test_cases(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (5, None), (6, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.join(df).collect()), key=str)
    assert got == sorted([(None, 1, None), (3, 1, 2), (2, 1, 2), (2, 1, 2), (5, 0, 5), (6, 0, 6)], key=str)
    assert ngram_join.join(df.filter("false")).count() == 0
    assert sorted((r.doc_id is None, r.doc_id) for r in ngram_join.keep_first(df).collect() if r.doc_id) == [(False, 2), (False, 2), (False, 5), (False, 6)]


def test_tree_join_loses_no_pair():
    rng = np.random.default_rng(1)
    points, sizes = [], []
    for i in range(300):
        groups = 1 << rng.integers(3, 6)
        p = rng.poisson(3, groups) if i % 3 else np.maximum(np.resize(points[-1] if points else [3], groups) + rng.integers(-1, 2, groups), 0)
        points.append(p)
        sizes.append(int(p.sum()))
    raw, n = [p.astype("<u2").tobytes() for p in points], np.array(sizes)
    left, right = np.arange(0, 200), np.arange(100, 300)
    got = set(zip(*(x.tolist() for x in ngram_join.tree_join(raw, n, left, right, 75)), strict=True))
    for i in left:
        for j in right:
            groups = min(len(points[i]), len(points[j]))
            both = np.minimum(ngram_join.folded(points[i], groups), ngram_join.folded(points[j], groups)).sum()
            if min(n[i], n[j]) * 100 >= 75 * max(n[i], n[j]) and both >= ngram_join.needed(n[i], n[j], 75):
                assert (i, j) in got


def test_parities_bound_the_overlap():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = set(rng.integers(0, 300, rng.integers(1, 200)).tolist()), set(rng.integers(0, 300, rng.integers(1, 200)).tolist())
        sides = []
        for x in (a, b):
            groups = 64 << rng.integers(0, 3)
            odd = np.bincount([v * 7919 % groups for v in x], minlength=groups) & 1
            sides.append(ngram_join.odd_groups(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()))
        assert ngram_join.bound(*sides, len(a), len(b)) >= len(a & b)


def test_words_with_equal_polynomial_hashes_are_not_linked(spark):
    turns = [0]
    for _ in range(10):
        turns += [1 - t for t in turns]
    a, b = ("".join("ab"[t ^ flip] for t in turns) for flip in (0, 1))
    assert result(ngram_join.join(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"))) == {1: (1, 1), 2: (1, 2)}


@pytest.mark.parametrize("share", [500_000, 40])
def test_components(spark, monkeypatch, share):
    monkeypatch.setattr("strideline.llm.components.SHARE", share)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (2000, 1001), (7000, 7000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000, 2000: 1000}


def test_op4_over_the_table(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(QUERIES["op4_ngram_join"](spark, SF)) == brute(docs)
