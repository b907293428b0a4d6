import random
from array import array
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strideline.llm import exact_dedup, ngram_join
from strideline.llm.tokens import encoder
from strideline.materialise import tasks_for
from tests.llm.test_ngram_join import brute, made

WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def folders(spark, monkeypatch, tmp_path):
    """Many shuffle partitions that stay apart; where intermediate tables are written."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    made_folders = Counter()

    def new_folder(_, name="run"):
        made_folders[name] += 1
        return f"{tmp_path}/{name}-{made_folders[name]}"

    monkeypatch.setattr("strideline.materialise.new_folder", new_folder)
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield tmp_path
    for k, v in old.items():
        spark.conf.set(k, v)


def most_files(folder: Path) -> int:
    return max(len(list(f.glob("*.parquet"))) for f in folder.iterdir())


def test_small_tables_of_the_join_go_to_few_files(spark, folders):
    docs = made(1)
    comps = {d: c for d, (_, c) in brute(docs).items()}
    kept = ngram_join.keep_first(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, c in comps.items() if c == d)
    assert most_files(folders) <= spark.sparkContext.defaultParallelism


def test_small_tables_of_exact_copies_go_to_few_files(spark, folders):
    docs = [(i, f"text {i % 60}") for i in range(180)]
    kept = exact_dedup.keep_one(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(120, 180))
    assert most_files(folders) <= spark.sparkContext.defaultParallelism


def test_tasks_grow_with_the_load(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [tasks_for(spark, n, 10) for n in (0, 1, 10 * cores, 10 * cores + 1, 1000 * cores)] == [cores, cores, cores, cores + 1, 100 * cores]


def test_an_encoder_of_few_pieces_gives_the_same_ids():
    rnd = random.Random(3)
    plain, encode = Tokenizer.from_file(WORD), encoder(WORD, "spaces", 100)
    for _ in range(200):
        text = " ".join("".join(rnd.choice("abcdé.,") for _ in range(rnd.randint(1, 6))) for _ in range(20))
        assert encode(text) == array("I", plain.encode(text, add_special_tokens=False).ids).tobytes()
        assert len(encode) + len(encode.older) <= 100 + 2 * 40
    assert encoder(WORD, "spaces").MOST_PIECES > 100
