import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strideline.llm import repeats
from strideline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    """Removed spans of each text, from counts of all its windows."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1])
        out.append((len(d), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), bytes(b for b, g in zip(d, gone[1:], strict=False) if not g)))
    return out


def check(spark, docs, length, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, hash string")
    got = repeats.remove_repeats(df.repartition(5), length, **more).collect()
    got = sorted((str(r.doc_id), (r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept))) for r in got)
    assert got == sorted((str(i), b) for (i, _), b in zip(docs, brute([t for _, t in docs], length), strict=True))


def made(seed, n=60, passages=4, size=300):
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choice("abcdeé \n") for _ in range(k))
    common, docs = [text(rnd.randint(20, 120)) for _ in range(passages)], []
    for _ in range(n):
        parts = [text(rnd.randint(0, size)) for _ in range(3)]
        for p in common:
            if rnd.random() < 0.3:
                a = rnd.randint(0, 10)
                parts.insert(rnd.randint(0, len(parts)), p[a : len(p) - rnd.randint(0, 10)])
        docs.append("".join(parts))
    docs += [docs[0], docs[1] + "!", docs[2][:30] + "?" + docs[2][31:], "", None, "a" * 200, "ab" * 90, "tail of aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x"]
    return [(i, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed,length,gathered,part", [(0, 40, 2000, 2_000_000), (1, 33, 0, 2_000_000), (2, 40, 3, 150), (3, 2, 2000, 1000), (4, 7, 5, 500)])
def test_equals_counting_all_windows(spark, monkeypatch, seed, length, gathered, part):
    # Few stretches gathered: windows counted one by one; small parts: texts handled in pieces.
    monkeypatch.setattr(repeats, "MOST_GATHERED", gathered)
    monkeypatch.setattr(repeats, "PART", part)
    check(spark, made(seed), length)


def test_cases(spark):
    check(spark, [(None, "abcdefgh"), (None, "abcdefgh"), (3, "abcdefgh-"), (3, "other text"), (5, None)], 8)
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_ranks():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    for length in (1, 2, 3, 8, 9, 10, 13, 37):
        starts = np.arange(0, len(data) - length)
        raw = [data[s : s + length].tobytes() for s in starts]
        order = {b: i for i, b in enumerate(sorted(set(raw)))}
        assert repeats.suffix_ranks(data, starts, length).tolist() == [order[b] for b in raw]


def test_op7_over_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {d.doc_id: (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
            for d, (n, spans, kept) in zip(docs, brute([d.text for d in docs], 400), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_remove_repeats"](spark, SF).collect()}
    assert got == want
