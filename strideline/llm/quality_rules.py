"""Quality rules: a table of thresholds compiled into Spark columns, without user functions.

Cases: a null text counts as empty, an empty one has no words and fails; rows are judged one
by one, so repeated rows and ties get equal verdicts; an empty table gives an empty result;
other columns are never looked at and come through :func:`keep_good` unchanged, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"

# Frequent function words of the four languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "on", "are", "as", "with", "be", "by", "at", "this", "have", "from", "or", "an", "not"],
    "de": ["der", "die", "das", "und", "in", "zu", "den", "ist", "von", "mit", "auf", "für", "nicht", "ein", "eine", "im", "des", "sich", "als", "auch", "es", "an", "werden", "aus"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "pas", "plus", "ne", "se", "ce", "il"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es", "lo", "como", "más", "pero"],
}


@dataclass(frozen=True)
class Rule:
    """``low * base <= 100 * measure <= high * base``; a missing bound does not bind."""

    measure: str
    base: str
    low: int | None = None
    high: int | None = None


#: The base rules: too short, or more than half of the words in repeated windows.
BASE_RULES = (Rule("n_words", "one", low=50 * 100), Rule("n_repeat_words", "n_words", high=50))

#: Thresholds in hundredths of the base.
RULES = (
    Rule("word_chars", "n_words", low=200, high=1500),
    Rule("n_symbols", "n_words", high=10),
    Rule("n_letter_words", "n_words", low=70),
    Rule("n_stop_words", "one", low=2 * 100),
    Rule("n_dup_lines", "n_lines", high=50),
    Rule("n_bullet_lines", "n_lines", high=90),
    Rule("n_ellipsis_lines", "n_lines", high=50),
)


def compiled(rules: tuple[Rule, ...], of) -> Column:
    """The table as one condition; ``of`` gives the column of a measure."""
    verdict = F.lit(True)
    for rule in rules:
        value, base = 100 * of(rule.measure), of(rule.base)
        if rule.low is not None:
            verdict &= value >= rule.low * base
        if rule.high is not None:
            verdict &= value <= rule.high * base
    return verdict


def _with_measures(rows: DataFrame) -> DataFrame:
    """Adds ``m``, a struct of the measures, to rows of ``(row, text)``.

    Each step is a projection of its own, because the next one uses its result more than
    once.  Repeated windows are found by sorting the window hashes of one text; no row
    leaves its task.
    """
    bare = F.btrim("text", F.lit(BLANKS))
    split = rows.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+")))
    split = split.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
    words, lines = F.col("words"), F.col("lines")
    n = F.size(words)
    windows = F.transform(
        F.when(n < 3, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 3)),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    ranked = split.withColumn("windows", F.sort_array(windows))
    at = F.col("windows")
    hits = F.filter(
        at, lambda x, k: (x["h"] == F.get(at, k - 1)["h"]) | (x["h"] == F.get(at, k + 1)["h"])
    )
    found = ranked.withColumn("hits", F.sort_array(F.transform(hits, lambda x: x["i"]))).drop("windows")
    starts = F.col("hits")
    covered = F.aggregate(
        F.transform(starts, lambda i, k: F.coalesce(F.least(F.get(starts, k + 1) - i, F.lit(3)), F.lit(3))),
        F.lit(0), lambda total, x: total + x,
    )
    stop = F.array(*map(F.lit, sorted({w for words in STOP_WORDS.values() for w in words})))
    count = lambda pattern: F.size(F.filter(lines, lambda line: line.rlike(pattern)))
    return found.withColumn("m", F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_intersect(words, stop)).cast("long").alias("n_stop_words"),
        F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        count(r"^[\x20\x09-\x0D]*[-*•]").cast("long").alias("n_bullet_lines"),
        count(r"(\.\.\.|…)[\x20\x09-\x0D]*$").cast("long").alias("n_ellipsis_lines"),
        F.lit(1).cast("long").alias("one"),
    )).select("row", "m")


def judged(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(row, m, base_failed, kept)``: the whole row, its measures and the verdict."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    of = lambda name: F.col(f"m.{name}")
    return _with_measures(rows).select(
        "row", "m", (~compiled(BASE_RULES, of)).alias("base_failed"),
        (compiled(BASE_RULES, of) & compiled(rules, of)).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with their columns.

    A generator drops the others.  A filter on ``kept`` would be pushed below the projections
    of the measures and would put the split of the text inside the loop over its words.
    """
    passed = F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")
    return judged(docs, text_col, rules).select(passed).select("row.*")
