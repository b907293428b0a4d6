"""Personal data against plain regular expressions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from strideline.llm import personal_data
from strideline.llm.personal_data import KINDS, spans_of


def plain(text):
    """Base spans by the patterns as written."""
    out = []
    for n, kind in enumerate(KINDS):
        if kind.base:
            for m in re.finditer(kind.pattern, text):
                digits = [int(c) for c in m[0] if "0" <= c <= "9"]
                doubled = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
                ok = {"email": True, "ip": kind.name == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                      "card": 12 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind.name]
                if ok:
                    out.append((m.start(), n, kind.name, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


ODD = ["", "a@b.c", "a@b", "@a.b@c.d", "a@b.c@d.e", "a@b.c_d@e.f", "x..%@y-.z-.w", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "1.1.1.0000255", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111",
       "+1 (017) 555-7713", "+1", "+12", "+1 2", "++49 30 1234567)", "é𝒳 a@b.cd +1 (017) 555-7713", "1" * 19, "٣٣٣.1.1.1", "+1.1.1.1.1.1.1", "a@b..c", "4026083977531332"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert [s[:3] for s in spans_of(text) if s[0] in personal_data.BASE] == plain(text)


def test_random_texts():
    rnd = random.Random(1)
    for alphabet in ("a1@.", "01. -", "+1(). -2", "A1 @.-+_é\n"):
        for _ in range(1500):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40)))
            assert [s[:3] for s in spans_of(text) if s[0] in personal_data.BASE] == plain(text), text


def test_added_kinds_need_checksum_or_context():
    def kinds(text):
        return [(k, text[s:e]) for k, s, e, _ in spans_of(text)]

    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00.") == [] and kinds("xGB82WEST12345698765432") == []
    assert kinds("no word GB82WEST12345698765432 here") == [("iban", "GB82WEST12345698765432")]
    assert kinds("Telefon: 030 1234567") == [("local_phone", "030 1234567")] and kinds("number 030 1234567") == []
    assert kinds("SSN 123-45-6789") == [("national_id", "123-45-6789")] and kinds("row 123-45-6789") == []
    assert kinds("tel +49 030 1234567") == [("phone", "+49 030 1234567")]
    with_word, without = spans_of("my visa card 4111111111111111"), spans_of("4111111111111111")
    assert with_word[0][3] > without[0][3]


@pytest.mark.parametrize("text", ["a" * 2_000_000, "1" * 2_000_000, "@" * 2_000_000, "a@" * 1_000_000, "1." * 1_000_000, "+1(" * 600_000, "1 " * 1_000_000, "0 1-" * 500_000, "AB12 " * 400_000, "a.b@c " * 300_000])
def test_time_is_linear(text):
    began = time.time()
    spans_of(text)
    assert time.time() - began < 20


def test_table(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "a@b.c and a@b.c", 6), (3, "a@b.c and a@b.c", 6), (None, "x" * 500_000 + " 10.0.0.1", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = personal_data.personal_data(df)
    assert got.select("row.*").columns == df.columns
    found = {str(r.row.doc_id): [(x.kind, x.start, x.end) for x in r.spans] for r in got.collect()}
    assert found == {"1": [], "2": [], "3": [("email", 0, 5), ("email", 10, 15)], "None": [("ip", 500_001, 500_009)]}
    assert got.count() == 5 and personal_data.personal_data(df.filter("false")).count() == 0
    assert personal_data.personal_data(df, keep=["doc_id"]).select(F.col("row.doc_id")).count() == 5
