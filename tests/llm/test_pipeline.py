import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from strideline.materialise import stored
from tests.llm.test_ngram_join import brute
from strideline.llm import queries
from tests.llm.test_rules_dedup_mixing import fold, shared_out
from tests.llm.test_tokens import WORD, check_packing

SF = "/root/testdata/sf0.001"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def mixed_by_steps(docs):
    """How often each document is taken, level by level of domain, language and source."""
    leaves = {}
    for d in docs:
        number = re.search("[0-9]+", d.source or "")
        path = (queries.DOMAINS[int(number[0]) % 4 if number else 0], d.lang or "(null)", d.source or "(null)")
        leaves.setdefault(path, []).append((d.doc_id, len(re.findall(WORD_PATTERN, d.text or ""))))
    total = {p: sum(n for _, n in rows) for p, rows in leaves.items()}
    cap = lambda above: queries.EPOCHS * sum(n for p, n in total.items() if p[: len(above)] == above)
    budget = {(): min(sum(total.values()) * queries.PERCENT // 100, cap(()))}
    for depth in (1, 2, 3):
        for above in {p[: depth - 1] for p in leaves}:
            kids = {p[:depth] for p in leaves if p[: depth - 1] == above}
            budget |= shared_out(budget[above], {k: cap(k) for k in kids}, {k: queries.TARGETS.get(k, 1) for k in kids})
    out = Counter()
    for path, rows in leaves.items():
        full = budget[path] // total[path] if total[path] else 0
        left = budget[path] - full * total[path]
        out.update({i: full for i, _ in rows})
        used = 0
        for i, n in sorted(rows, key=lambda r: hashlib.md5(f"{queries.SEED}|{full + 1}|{r[0]}".encode()).hexdigest()) if left > 0 else []:
            used += n
            if used > left:
                break
            out[i] += 1
    return +out


def test_stages_equal_brute_force(spark):
    from array import array

    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    passed = stored(corpus_pipeline.quality(spark, docs, SF))
    assert passed.columns == docs.columns and 0 < passed.count() < docs.count()

    one = stored(corpus_pipeline.exact(spark, passed, SF))
    largest = {}
    for d in passed.collect():
        largest[fold(d.text)] = max(d.doc_id, largest.get(fold(d.text), d.doc_id))
    assert sorted(r.doc_id for r in one.collect()) == sorted(largest.values())

    first = stored(corpus_pipeline.near(spark, one, SF))
    comps = brute([(d.doc_id, d.text) for d in one.collect()])
    assert sorted(r.doc_id for r in first.collect()) == sorted(d for d, (_, c) in comps.items() if c == d)

    mixed = stored(corpus_pipeline.mixture(spark, first, SF))
    taken = mixed.collect()
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in taken) == mixed_by_steps(first.collect())

    distinct = mixed.dropDuplicates(["doc_id"])
    tokenizer = Tokenizer.from_file(WORD)
    want = {d.doc_id: array("I", [*tokenizer.encode(d.text, add_special_tokens=False).ids, 0]).tobytes() for d in distinct.collect()}
    check_packing(corpus_pipeline.sequences(spark, distinct, SF).collect(), want, 2048)

    # The whole run packs every document as often as it was taken, each piece at its place.
    rows = corpus_pipeline.run(spark, SF).collect()
    pieces = Counter()
    for d in taken:
        whole = want[d.doc_id]
        pieces.update((d.doc_id, k, whole[8192 * k : 8192 * (k + 1)]) for k in range(-(-len(whole) // 8192)))
    assert Counter((r.doc_id, r.piece, bytes(r.ids)) for r in rows) == pieces
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, len(r.ids) // 4))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)]])
def test_stages_of_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= len(rows)
