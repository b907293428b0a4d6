import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.llm import fm_quality, toxicity
from strideline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"



def odd(spark):
    docs = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "good words here", "x"), (4, "bad " * 5000, None), (5, " \n\t", "y")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string")


@pytest.mark.parametrize("scores,label", [(fm_quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_cases(spark, scores, label):
    schema = f"doc_id long, {label} int"
    none = spark.createDataFrame([], schema)
    got = scores(odd(spark), none, F.lit(False)).collect()
    assert len(got) == 6 and all(r.score == pytest.approx(0.5, abs=0.01) for r in got)
    some = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (99, 1), (None, 1), (5, None)], schema)
    got = scores(odd(spark), some, F.lit(False)).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == ["1", "2", "2", "4", "5", "None"]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out is False for r in got)
    assert scores(odd(spark).filter("false"), some, F.lit(False)).count() == 0


@pytest.mark.parametrize("name,label,bar", [("op2_fm_quality", "quality", (3, 1)), ("op8_toxicity", "toxic", (5, 0))])
def test_held_out_accuracy(spark, name, label, bar):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES[name](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % bar[0] == bar[1]) for r in got)
    test = [r for r in got if r.held_out and r.doc_id in truth]
    right = np.mean([r.predicted == truth[r.doc_id] for r in test])
    share = np.mean([truth[r.doc_id] for r in test])
    assert right > max(share, 1 - share) + 0.03
    again = {r.doc_id: r.score for r in QUERIES[name](spark, SF).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-6) for r in got)


def test_pairs_in_linear_time_equal_the_sum_over_pairs():
    m = fm_quality.Machine()
    m.w = np.random.default_rng(0).normal(size=fm_quality.SIZE)
    texts = ["a b c a", "", "x & y\nx & y"]
    index, value, bounds, _ = fm_quality.features(texts, m.cuts)
    for k, margin in enumerate(m.margins(index, value, bounds)):
        i, x = index[bounds[k] : bounds[k + 1]], value[bounds[k] : bounds[k + 1]]
        pairs = sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        assert margin == pytest.approx((m.w[i] * x).sum() + pairs)


def test_interactions_are_learned():
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for _ in range(1500):
        a, b = rng.integers(2), rng.integers(2)
        texts.append(" ".join(["left"] * a + ["right"] * b + [f"w{rng.integers(20)}" for _ in range(2)]))
        labels.append(float(a == b))
    m = fm_quality.Machine().fit(texts[:1200], np.array(labels[:1200]), epochs=30)
    assert np.mean((m.scores(texts[1200:]) >= 0.5) == np.array(labels[1200:])) > 0.9


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(4)
    names = np.sort(rng.integers(0, 2**63, 30, dtype=np.uint64))
    x = rng.integers(0, 3, (400, 30)) * (rng.random((400, 30)) < 0.15)
    index = toxicity.build(np.arange(400), [""] * 400, (rng.random(400) < 0.3).astype(float), names, np.ones(30))
    norm = np.sqrt((x**2).sum(axis=1, keepdims=True))
    x = np.divide(x, norm, out=np.zeros(x.shape), where=norm > 0)
    x = x[x.any(axis=1)]
    index.x, index.labels = x, np.ones(len(x))
    place, best = index.nearest(x[:50], k=7)
    cosine = np.round(x[:50] @ x.T, 10)
    order = np.argsort(-cosine, axis=1, kind="stable")[:, :7]
    want = np.take_along_axis(cosine, order, axis=1)
    assert np.array_equal(best, want) and np.array_equal(place, np.where(want > 0, order, -1))


def test_every_word_of_an_example_is_a_term(spark):
    # No word tells the labels apart; the neighbour is the example with the same rare words.
    common = " ".join(f"w{i}" for i in range(40))
    docs = [(i, f"{common} only{i} also{i}") for i in range(60)] + [(100 + i, f"also{i} other only{i}") for i in range(60)] + [(200, "unseen words"), (201, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(df, labels, F.lit(False)).collect()}
    for i in range(60):
        assert [(e.doc_id, e.label) for e in got[100 + i].evidence] == [(i, i % 2)]
    assert got[200].evidence == got[201].evidence == [] and got[200].score == got[201].score

    n = len(docs)
    bags = {i: (t or "").split() for i, t in docs}
    idf = {w: np.log((1 + n) / (1 + sum(w in set(b) for b in bags.values()))) + 1 for b in [bags[i] for i in range(60)] for w in b}

    def unit(i):
        v = {w: idf[w] * (1 + np.log(bags[i].count(w))) for w in bags[i] if w in idf}
        return {w: x / np.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}

    for i in (0, 7, 107):
        a = unit(i)
        want = sorted((round(sum(a[w] * b.get(w, 0) for w in a), 9) for b in map(unit, range(60))), reverse=True)[: len(got[i].evidence)]
        assert [round(e.cosine, 9) for e in got[i].evidence] == want


def test_beginnings_of_long_words_join_texts():
    h, doc = toxicity.words(["strange", "strangely odd", "strang"])
    by = [set(h[doc == i].tolist()) for i in range(3)]
    assert len(by[0]) == 2 and len(by[1]) == 3 and len(by[2]) == 1
    assert by[0] & by[1] == by[2] and len(toxicity.words([None, ""])[0]) == 0


def test_lists_skip_no_neighbour(monkeypatch):
    monkeypatch.setattr(toxicity, "FREQUENT", 6)
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng = np.random.default_rng(5)
    topic = rng.integers(0, 5, 300)
    x = rng.integers(1, 4, (300, 120)) * (rng.random((300, 120)) < np.where(np.arange(120) < 12, 0.6, np.where(np.arange(120) % 5 == topic[:, None], 0.3, 0.01)))
    x = x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-9)
    rows = toxicity.sparse(x)
    rows = rows.taken(toxicity._alike(rows))
    x = rows.dense(np.arange(120))
    index = toxicity.Index(np.arange(120, dtype=np.uint64), np.ones(120), np.arange(300), np.ones(300), rows, 0.5, (4.0, 0.0))
    place, best = index.nearest(rows, k=5, own=np.arange(300))
    cosine = np.round(x @ x.T, 10)
    np.fill_diagonal(cosine, 0)
    order = np.argsort(-cosine, axis=1, kind="stable")[:, :5]
    want = np.take_along_axis(cosine, order, axis=1)
    assert np.allclose(best, want, atol=2e-10) and np.all(np.sort(np.take_along_axis(cosine, place, axis=1), axis=1) >= np.sort(want, axis=1) - 2e-10)
    assert any(len(at) < 300 for at, _ in index.lists()[0].cosines(rows, 5, None))
