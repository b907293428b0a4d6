import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strideline.llm import exact_dedup, mixing, quality_rules


def measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t ", "one", "a b c a b c", "a a a a a", "x\n\nx\n x\nx", "# <b> 50% | $", "é è\x0b\x0cß \r\n 𝒳y", "w " * 60, "the cat and a dog ran. " * 20,
         " ".join(f"the word{i} of" for i in range(100)), "\x1cnot\x85a\xa0space", "A,b!\n" * 9]


def test_measures(spark):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, m int, words int")
    got = {r.row.doc_id: r for r in quality_rules.judged(df).collect()}
    for i, t in enumerate(TEXTS):
        m = got[i].m
        want = measures(t)
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == want, t
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i].kept and got[i].base_failed)
    assert quality_rules.keep_good(df).columns == df.columns
    assert [r.doc_id for r in quality_rules.keep_good(df).collect()] == [i for i in got if got[i].kept] == [11]
    assert quality_rules.judged(df.filter("false")).count() == 0


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup(spark, bits):
    rnd = random.Random(0)
    long = "".join(rnd.choice("abc. \n") for _ in range(9000))
    texts = ["", None, "A", "a", "É", "é", "x" * 9000, "x" * 9001, long, long.upper(), long[:-1] + "!", long + long, long[5000:] + long[:5000]]
    docs = [(i * 3 % 31, t) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, recipe string")
    got = {r.doc_id: r for r in exact_dedup.decide(df, hash_bits=bits).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        group = [j for j, u in docs if fold(u) == fold(t)]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), i == max(group))
        assert r.text_sha256 == hashlib.sha256(fold(t).encode()).hexdigest()
    assert sorted(r.doc_id for r in exact_dedup.keep_one(df).collect()) == sorted({r.keep_id for r in got.values()})


def test_chunks_join_to_the_text(spark):
    texts = ["", "a", "y" * 20000, "one. " * 3000, "𝒳é\n" * 2000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", exact_dedup.chunked(F.col("text")).alias("c")).collect():
        assert "".join(r.c) == r.text and all(len(c) <= 4096 for c in r.c)


def test_exact_dedup_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a"), (None, "A"), (None, "b"), (1, "a"), (1, "a"), (2, "c"), (2, "c")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text_sha256[:4], str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.decide(df).collect())
    a, b, c = (hashlib.sha256(x).hexdigest()[:4] for x in (b"a", b"b", b"c"))
    assert got == sorted([("None", a, "1", 4, False)] * 2 + [("None", b, "None", 1, True), ("1", a, "1", 4, False), ("1", a, "1", 4, True), ("2", c, "2", 2, False), ("2", c, "2", 2, True)])
    kept = exact_dedup.keep_one(df.filter("doc_id IS NOT NULL OR text = 'b'"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.filter("text = 'b' OR doc_id IS NOT NULL").distinct().collect()))
    assert exact_dedup.decide(df.filter("false")).count() == 0 and exact_dedup.keep_one(df.filter("false")).count() == 0


def test_keep_one_keeps_every_text_of_an_id(spark):
    rows = [(None, "a"), (None, "A"), (None, "b"), (None, "B"), (None, "c"), (None, None), (1, "a"), (1, "a"), (2, "d"), (2, "e"), (2, "E"), (3, "d"), (0, "f"), (0, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    best = {}
    for i, t in rows:
        best[fold(t)] = max(best.get(fold(t), -1), -1 if i is None else i)
    for part in (df, df.repartition(1).orderBy(F.desc("text"))):
        got = [(-1 if r.doc_id is None else r.doc_id, fold(r.text)) for r in exact_dedup.keep_one(part).collect()]
        assert sorted(got) == sorted((i, t) for t, i in best.items())


# --- mixing ------------------------------------------------------------------------------


def shared_out(budget, caps, weights):
    """Budgets of children, one saturated child after the other."""
    out, open_, left = dict.fromkeys(caps, 0), {k for k in caps if weights[k] > 0}, budget
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if caps[k] * total <= weights[k] * left}
        if not full:
            for k in open_:
                out[k] = left * weights[k] // total
            break
        for k in full:
            out[k] = caps[k]
        left -= sum(caps[k] for k in full)
        open_ -= full
    return out


def chosen(docs, weights, percent, epochs, seed):
    """(doc_id, epoch) of all rows taken, step by step."""
    leaves = {}
    for i, a, b, n in docs:
        leaves.setdefault((a, b), []).append((i, n))
    cap = lambda p: epochs * sum(n for k, v in leaves.items() if k[: len(p)] == p for _, n in v)
    budget = {(): min(sum(d[3] for d in docs) * percent // 100, cap(()))}
    for depth in (1, 2):
        for above in {k[: depth - 1] for k in leaves}:
            kids = {k[:depth] for k in leaves if k[: depth - 1] == above}
            budget |= shared_out(budget[above], {k: cap(k) for k in kids}, {k: weights.get(k, 1) for k in kids})
    out = Counter()
    for leaf, members in leaves.items():
        left, total = budget[leaf], sum(n for _, n in members)
        full = left // total if total else 0
        for e in range(full):
            out.update((i, e + 1) for i, _ in members)
        left -= full * total
        order = sorted(members, key=lambda m: hashlib.md5(f"{seed}|{full + 1}|{m[0]}".encode()).hexdigest())
        used = 0
        for i, n in order if left > 0 else []:
            used += n
            if used > left:
                break
            out[i, full + 1] += 1
    return out, budget


@pytest.mark.parametrize("seed,slice_rows,percent", [(0, 16384, 90), (1, 3, 50), (2, 2, 150), (3, 5, 1000)])
def test_mixing(spark, monkeypatch, seed, slice_rows, percent):
    monkeypatch.setattr(mixing, "SLICE", slice_rows)
    rnd = random.Random(seed)
    docs = [(i, rnd.choice("AAAB"), rnd.choice("xxyz"), rnd.choice([0, 1, 5, 30])) for i in range(300)]
    docs += [(1000 + i, "C", "x", 2) for i in range(2)] + [(2000, "D", "x", 50)]
    weights = {("A",): 1, ("B",): 3, ("C",): 40, ("D",): 0, ("A", "x"): 1, ("A", "y"): 9}
    df = spark.createDataFrame([(i, a, b, " ".join(["w"] * n), 7) for i, a, b, n in docs], "doc_id long, a string, b string, text string, epoch int")
    got = Counter((r.row.doc_id, r.epoch) for r in mixing.mix(df, [F.col("a"), F.col("b")], weights, percent, 2, 5).collect())
    want, budget = chosen(docs, weights, percent, 2, 5)
    assert got == want
    used = sum(dict((i, n) for i, _, _, n in docs)[i] * c for (i, _), c in got.items())
    assert used <= budget[()]


def test_mixing_cases(spark):
    df = spark.createDataFrame([(None, None, "a b"), (1, None, None), (1, "s", "c"), (1, "s", "c")], "doc_id long, source string, text string")
    got = mixing.mix(df, [F.col("source")], {}, 100, 1, 1)
    assert got.select("row.*").columns == df.columns
    assert sorted(str(r.path.p0) for r in got.collect()) in (["(null)", "(null)", "s", "s"], ["(null)", "s", "s"])
    assert mixing.mix(df.filter("false"), [F.col("source")], {}, 100, 1, 1).count() == 0
