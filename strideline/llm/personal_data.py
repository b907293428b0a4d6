"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Each kind has a pattern, whose matches are taken from the left without overlap, a test that a match must
pass (a match that fails is dropped, and nothing inside it is tried again), and a score.  The score starts at
the kind's prior, grows by a checksum that holds (Luhn for cards, mod 97 for account numbers) and by a context word
within ``NEAR`` characters before the span.  Base kinds stay whatever their score; spans of the
other kinds need ``LEAST`` and must not overlap a base span.

All patterns take a time linear in the text: a class that may repeat never overlaps what follows it.

Cases: a null text counts as empty, an empty one has no spans; positions are code points, ends
exclusive; rows are judged one by one, so repeated rows and ties get equal spans; an empty table gives an empty result;
other columns are passed on whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEAR, LEAST = 40, 0.5
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"


@dataclass(frozen=True)
class Kind:
    """``checksum`` and ``context`` are added to ``prior`` when they hold; ``beside`` lists what may not touch the span."""

    name: str
    pattern: str
    base: bool
    prior: float
    checksum: float = 0.0
    context: float = 0.0
    words: tuple[str, ...] = ()
    beside: str = ""


#: Context words are fixed values in the four languages of the corpus, lower case.
KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", True, 0.8, context=0.1, words=("mail", "correo", "courriel", "contact")),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", True, 0.5, context=0.3, words=("ip", "host", "server", "address", "adresse")),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", True, 0.3, checksum=0.5, context=0.2, words=("card", "visa", "karte", "carte", "tarjeta")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, 0.6, context=0.3, words=("tel", "phone", "call", "mobil", "fax", "móvil")),
    Kind("iban", r"[A-Z][A-Z][0-9][0-9](\x20?[0-9A-Z])+", False, 0.1, checksum=0.7, context=0.2, words=("iban", "account", "konto", "compte", "cuenta"), beside="A-Za-z0-9"),
    Kind("local_phone", r"0[0-9]([\x20()./-]?[0-9])+", False, 0.2, context=0.5, words=("tel", "phone", "call", "mobil", "fax", "móvil"), beside="0-9+"),
    Kind("national_id", r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]", False, 0.2, context=0.5, words=("ssn", "social security", "taxpayer"), beside="0-9-"),
)
BASE = tuple(k.name for k in KINDS if k.base)
_ORDER = {k.name: i for i, k in enumerate(KINDS)}


def luhn(digits: str) -> bool:
    """Every second digit from the right counts twice, less nine if that has two digits."""
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The account number with its first four characters last, letters as 10 to 35, leaves 1."""
    rest = 0
    for c in account[4:] + account[:4]:
        value = int(c, 36)
        rest = (rest * (10 if value < 10 else 100) + value) % 97
    return rest == 1


def _digits(found: str) -> str:
    return re.sub("[^0-9]", "", found)


def confirmed(kind: str, found: str) -> bool:
    """The test that a match of the kind must pass."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))
    if kind == "card":
        digits = _digits(found)
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(_digits(found)) <= 15
    if kind == "iban":
        account = found.replace(" ", "")
        return 15 <= len(account) <= 34 and mod97(account)
    if kind == "local_phone":
        return 8 <= len(_digits(found)) <= 13
    return True


_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The kinds' patterns without stepping back.  A digit inside a run starts no match that its run does not start.
_FORMS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
    "iban": re.compile(r"[A-Z][A-Z][0-9][0-9](?: ?[0-9A-Z])++"),
    "local_phone": re.compile(r"0[0-9](?:[ ()./-]?[0-9])++"),
    "national_id": re.compile(r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]"),
}
_WORDS = {k.name: re.compile("|".join(map(re.escape, k.words))) for k in KINDS}
_BESIDE = {k.name: re.compile(f"[{k.beside}]") for k in KINDS if k.beside}


def _emails(text: str):
    """Matches by their at signs: what may stand before one never reaches over another."""
    free = 0
    for m in _DOMAIN.finditer(text):
        before = text[free : m.start()]
        size = len(before) - len(before.rstrip(_LOCAL))
        if size:
            yield m.start() - size, m.end()
        free = m.end() if size else m.start() + 1


def _matches(kind: str, text: str):
    return _emails(text) if kind == "email" else (m.span() for m in _FORMS[kind].finditer(text))


def score(kind: Kind, text: str, start: int) -> float:
    near = text[max(0, start - NEAR) : start].lower()
    return round(kind.prior + kind.checksum + (kind.context if _WORDS[kind.name].search(near) else 0.0), 2)


def _merged(spans) -> list[tuple[int, int]]:
    """The union of spans as intervals that don't touch."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s, e) for _, s, e, _ in spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then by kind as listed."""
    out: list[tuple[str, int, int, float]] = []
    taken: list[tuple[int, int]] = []
    for kind in KINDS:
        if not kind.base and not taken:
            taken = _merged(out)
        for start, end in _matches(kind.name, text):
            if not confirmed(kind.name, text[start:end]):
                continue
            if not kind.base:
                k = bisect_right(taken, start, key=lambda x: x[1])
                touched = _BESIDE[kind.name].search(text[max(0, start - 1) : start] + text[end : end + 1])
                if touched or (k < len(taken) and taken[k][0] < end):
                    continue
            value = score(kind, text, start)
            if kind.base or value >= LEAST:
                out.append((kind.name, start, end, value))
    return sorted(out, key=lambda x: (x[1], _ORDER[x[0]]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _run(batches):
    for b in batches:
        found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans_of(t.as_py() or "")] for t in b.column("_text")]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(found, _SPANS)], ["row", "spans"])


def personal_data(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``(row, spans)``: the columns ``keep`` (all by default) and the spans with kind, start, end and score."""
    kept = F.struct(*(keep or ["*"])).alias("row")
    rows = docs.select(kept, F.col(text_col).cast("string").alias("_text"))
    schema = rows.select("row").withColumn("spans", F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")).schema
    return rows.mapInArrow(_run, schema)
