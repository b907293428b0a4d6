import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strideline.llm import packing, token_blocks, token_counts
from strideline.llm.queries import QUERIES
from strideline.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
BYTE, WORD, PIECE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "x", "  two  spaces ", "a\n\nb", " \n c", "don't, he'll.", "<|endoftext|> in <|startoftext|>text", "中文字。 ", "\x1c\x85\xa0 é",
       "ΑΣ σ İ ß", "a" * 3000, "word, " * 9000, "é́ \t\r\n\x0b\x0c", "x \x00y", "▁ a▁b"]


def fuzz(n=2000):
    random.seed(5)
    parts = list(" \n\t\r\x1c\x85\xa0aAbZé'sΣ09!.,") + ["'s", " \n", "\n\n", "don't", " x", "hello", " World.", "ok,", "<|endoftext|>"]
    return ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(n)]


def rows(spark, texts):
    return spark.createDataFrame(
        [(i if i else None, t, "n") for i, t in enumerate([None, *texts])], "doc_id long, text string, n_tokens string")


@pytest.mark.parametrize("path,split", [(BYTE, "byte_level"), (WORD, "spaces")])
def test_pieces_give_the_ids_of_the_library(path, split):
    plain, encode = Tokenizer.from_file(path), encoder(path, split)
    for text in ODD + fuzz():
        assert encode(text) == array("I", plain.encode(text, add_special_tokens=False).ids).tobytes(), text[:80]


def test_splicing_gives_the_counts_of_whole_texts():
    m, spaces_lead = token_counts.model(PIECE)
    assert spaces_lead
    random.seed(3)
    texts = [" ".join(random.choice(["a", "bb.", "", "thing,\n", "x" * 50, "中文", "▁", "ß"]) for _ in range(300)) for _ in range(40)] + ODD
    for text in texts:
        for chunk, overlap in ((20, 5), (64, 16), (300, 40)):
            assert token_counts.count_spliced(text, m, True, chunk, overlap) == len(m.encode(text)), text[:80]
    assert token_counts.count_spliced("a b c", m, False, 2, 1) == len(m.encode("a b c"))


def test_token_counts(spark):
    m = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = token_counts.token_counts(rows(spark, ODD), PIECE, limit=100, chunk=500, overlap=20).collect()
    want = {i if i else None: t or "" for i, t in enumerate([None, *ODD])}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {
        i: (len(t.encode()), len(m.encode(t)), len(m.encode(t)) > 100) for i, t in want.items()}
    assert token_counts.token_counts(rows(spark, ODD).filter("false"), PIECE).count() == 0


def test_op3_over_the_table(spark):
    m = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in QUERIES["op3_token_counts"](spark, SF).collect()}
    assert got == {d.doc_id: len(m.encode(d.text)) for d in docs}


def check_packing(got, want, capacity):
    """All pieces once, in order, without gaps; ids as the library gives them."""
    found, sequences = {}, {}
    for r in got:
        found.setdefault(r.doc_id, {})[r.piece] = (r.start, r.ids)
        sequences.setdefault(r.sequence_id, []).append((r.offset, len(r.ids) // 4))
    assert {d: b"".join(p[k][1] for k in sorted(p)) for d, p in found.items()} == want
    for parts in found.values():
        at = 0
        for k in range(len(parts)):
            assert parts[k][0] == at
            at += len(parts[k][1]) // 4
        assert all(len(parts[k][1]) == 4 * capacity for k in range(len(parts) - 1))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences)


def test_packing(spark):
    tokenizer = Tokenizer.from_file(WORD)
    texts = ODD + fuzz(500)
    want = {i if i else None: array("I", [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]).tobytes() for i, t in enumerate([None, *texts])}
    n = check_packing(packing.pack(rows(spark, texts).repartition(7), WORD, capacity=64).collect(), want, 64)
    assert n <= 1.02 * -(-sum(map(len, want.values())) // 256) + 1
    assert packing.pack(rows(spark, []).filter("false"), WORD).count() == 0
    twice = rows(spark, ["one two", "one two"]).drop("doc_id").selectExpr("5L AS doc_id", "text")
    assert packing.pack(twice, WORD).count() == 3


def test_op6_over_the_table(spark):
    tokenizer = Tokenizer.from_file(WORD)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = {d.doc_id: array("I", [*tokenizer.encode(d.text, add_special_tokens=False).ids, 0]) for d in docs}
    got = QUERIES["op6_pack_sequences"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == {
        (d, p): (at, len(x[at : at + 2048]), zlib.crc32(x[at : at + 2048].tobytes()))
        for d, x in ids.items() for p, at in enumerate(range(0, len(x), 2048))}
    total = sum(map(len, ids.values()))
    assert len({r.sequence_id for r in got}) <= 1.02 * -(-total // 2048) + 1


@pytest.mark.parametrize("ids", [[], [7], [0] * 256, list(range(1000)), [1, 2**32 - 1] * 300, [5] * 255 + [2**31]])
def test_blocks_round_trip(ids):
    x = np.array(ids, "<u4")
    for share in (0, 50, 90, 99):
        starts, payload = token_blocks.encode_blocks(x, share)
        assert token_blocks.decode_blocks(starts, payload, len(x)).tolist() == ids
        for i, start in enumerate(starts):  # each block alone
            n = min(256, len(ids) - 256 * i)
            assert token_blocks.decode_blocks(np.array([start]), payload, n).tolist() == ids[256 * i : 256 * i + n]


def blocks(spark, docs, tmp_path, **more):
    folder = f"{tmp_path}/blocks{len(list(tmp_path.iterdir()))}"
    token_blocks.write_blocks(docs, folder, BYTE, **more)
    return token_blocks.read_blocks(spark, folder).collect()


def test_block_files(spark, tmp_path):
    tokenizer = Tokenizer.from_file(BYTE)
    texts = ODD + fuzz(300)
    got = sorted(blocks(spark, rows(spark, texts).repartition(5), tmp_path, segment=700), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *range(1, len(texts) + 1)]
    at = 0
    for r, text in zip(got, [None, *texts], strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.ids) == (at, array("I", ids).tobytes())
        at += len(ids)
    assert blocks(spark, rows(spark, []).filter("false"), tmp_path) == []


def test_op9_over_the_table(spark):
    tokenizer, at, want = Tokenizer.from_file(BYTE), 0, {}
    for d in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = [*tokenizer.encode(d.text, add_special_tokens=False).ids, 0]
        want[d.doc_id] = (at, len(ids), zlib.crc32(array("I", ids).tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op9_token_blocks"](spark, SF).collect()} == want
