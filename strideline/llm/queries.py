"""One registered query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.llm import (
    exact_dedup,
    fm_quality,
    mixing,
    ngram_join,
    packing,
    personal_data,
    prefix_trie,
    quality_rules,
    repeats,
    token_blocks,
    token_counts,
    toxicity,
    turn_repair,
    turns,
)
from strideline.materialise import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- quality rules -----------------------------------------------------------------------


def _rules_sql(rules) -> str:
    out = []
    for r in rules:
        if r.low is not None:
            out.append(f"100 * {r.measure} >= {r.low} * {r.base}")
        if r.high is not None:
            out.append(f"100 * {r.measure} <= {r.high} * {r.base}")
    return " AND ".join(out)


_STOP = ", ".join(f"'{w}'" for w in sorted({w for words in quality_rules.STOP_WORDS.values() for w in words}))
_WORD = r"[^\x20\x09-\x0D]+"

QUALITY_SQL = rf"""
d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i+2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '{quality_rules.SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
      CAST(len(l) AS BIGINT) AS n_lines, len(list_distinct(list_filter(w, lambda x: x IN ({_STOP})))) AS n_stop_words,
      len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
      len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
      len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines, 1 AS one
      FROM d LEFT JOIN r USING (doc_id)),
q AS (SELECT *, NOT ({_rules_sql(quality_rules.BASE_RULES)}) AS base_failed,
      ({_rules_sql(quality_rules.BASE_RULES)} AND {_rules_sql(quality_rules.RULES)}) AS kept FROM m)"""


@query("op5_quality_rules", f"""WITH {QUALITY_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q""")
def _(spark, sf):
    return quality_rules.judged(documents(spark, sf)).select(
        "row.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept")


# --- exact deduplication -----------------------------------------------------------------

_FOLD = f"translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}')"


@query("op10_exact_dedup", f"""WITH t AS (SELECT doc_id, {_FOLD} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM t""")
def _(spark, sf):
    return exact_dedup.decide(documents(spark, sf))


# --- tokens ------------------------------------------------------------------------------


@query("op3_token_counts")
def _(spark, sf):
    return token_counts.token_counts(documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_pack_sequences")
def _(spark, sf):
    packed = packing.pack(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "piece", "start", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query("op9_token_blocks")
def _(spark, sf):
    folder = new_folder(spark, "token-blocks")
    token_blocks.write_blocks(documents(spark, sf), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_blocks.read_blocks(spark, folder).select(
        "doc_id", "start", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


# --- near duplicates ---------------------------------------------------------------------


@query("op4_ngram_join")
def _(spark, sf):
    return ngram_join.join(documents(spark, sf))


# --- classifiers -------------------------------------------------------------------------


def _id_class(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query("op2_fm_quality")
def _(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return fm_quality.quality_scores(documents(spark, sf), labels, _id_class(3) == 1)


@query("op8_toxicity")
def _(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return toxicity.toxicity_scores(documents(spark, sf), labels, _id_class(5) == 0)


# --- repeats -----------------------------------------------------------------------------


@query("op7_remove_repeats")
def _(spark, sf):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return repeats.remove_repeats(documents(spark, sf)).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# --- mixture -----------------------------------------------------------------------------

DOMAINS = ["web", "books", "code", "talk"]
#: Targets: relative weights of nodes; sources without one weigh the same.
TARGETS = {("web",): 40, ("books",): 30, ("code",): 20, ("talk",): 10} | {
    (d, lang): w for d in DOMAINS for lang, w in (("en", 5), ("de", 2), ("fr", 2), ("es", 1))} | {("web", "en", "src0"): 2}
PERCENT, EPOCHS, SEED = 90, 2, 11


def mixture_path() -> list:
    """Domain, language and source; the domain is told by the number of the source."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '[0-9]+', 0) AS int)"), F.lit(0)) % len(DOMAINS)
    return [F.get(F.array(*map(F.lit, DOMAINS)), number), F.col("lang"), F.col("source")]


_TARGET_ROWS = ", ".join("(" + ", ".join([*(f"'{x}'" for x in p), *["NULL"] * (3 - len(p)), str(w)]) + ")" for p, w in TARGETS.items())


def _level_sql(depth: int) -> str:
    path = [f"p{i}" for i in range(depth)]
    above, key = path[:-1], ", ".join(path)
    on = " AND ".join([f"t.{c} = n.{c}" for c in path] + [f"t.p{i} IS NULL" for i in range(depth, 3)])
    part = f"PARTITION BY {', '.join(above)} " if above else ""
    join = f"JOIN b{depth - 1} USING ({', '.join(above)})" if above else "CROSS JOIN b0"
    return f"""
n{depth} AS (SELECT {key}, CAST(sum(tokens) * {EPOCHS} AS BIGINT) AS cap FROM leaves GROUP BY ALL),
w{depth} AS (SELECT n.*, coalesce(t.w, 1) AS w FROM n{depth} n LEFT JOIN targets t ON {on}),
v{depth} AS (SELECT *, CASE WHEN sum(w) OVER o2 > 0 THEN (budget - coalesce(sum(cap) OVER o1, 0))::DOUBLE / (sum(w) OVER o2)::DOUBLE END AS level
  FROM w{depth} {join}
  WINDOW o1 AS ({part}ORDER BY w = 0, cap / nullif(w, 0), p{depth - 1} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         o2 AS ({part}ORDER BY w = 0, cap / nullif(w, 0), p{depth - 1} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
x{depth} AS (SELECT * EXCLUDE (level), max(level) OVER ({part}) AS level FROM v{depth}),
b{depth} AS (SELECT {key}, CAST(least(cap, CASE WHEN w * level >= cap - 1e-6 THEN cap ELSE floor(w * greatest(coalesce(level, 0), 0)) END) AS BIGINT) AS budget FROM x{depth})"""


MIXTURE_SQL = rf"""
targets(p0, p1, p2, w) AS (VALUES {_TARGET_ROWS}),
d AS (SELECT doc_id, (['web', 'books', 'code', 'talk'])[1 + coalesce(TRY_CAST(regexp_extract(source, '[0-9]+') AS INTEGER), 0) % 4] AS p0,
      coalesce(lang, '(null)') AS p1, coalesce(source, '(null)') AS p2, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS own FROM documents),
leaves AS (SELECT p0, p1, p2, sum(own) AS tokens FROM d GROUP BY ALL),
b0 AS (SELECT CAST(least(coalesce(floor(sum(tokens) * {PERCENT} / 100), 0), coalesce(sum(tokens) * {EPOCHS}, 0)) AS BIGINT) AS budget FROM leaves),
{_level_sql(1)},{_level_sql(2)},{_level_sql(3)},
f AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS f FROM leaves JOIN b3 USING (p0, p1, p2)),
s AS (SELECT d.*, f.f, budget - f.f * tokens AS rest, sum(own) OVER (PARTITION BY p0, p1, p2
      ORDER BY md5(concat_ws('|', '{SEED}', CAST(f.f + 1 AS BIGINT), coalesce(CAST(doc_id AS VARCHAR), '')))) AS upto FROM d JOIN f USING (p0, p1, p2)),
e AS (SELECT *, f + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM s)"""


@query("op1_mix_sources", f"""WITH {MIXTURE_SQL}
SELECT doc_id, p0 AS domain, p1 AS lang, p2 AS source, CAST(unnest(range(1, CAST(times AS BIGINT) + 1)) AS INTEGER) AS epoch, own AS n_tokens FROM e""")
def _(spark, sf):
    mixed = mixing.mix(documents(spark, sf), mixture_path(), TARGETS, PERCENT, EPOCHS, SEED)
    return mixed.select("row.doc_id", F.col("path.p0").alias("domain"), F.col("path.p1").alias("lang"), F.col("path.p2").alias("source"),
                        "epoch", F.col("tokens").alias("n_tokens"))


# --- personal data -----------------------------------------------------------------------

_OPEN, _SHUT = "chr(57344)", "chr(57345)"


def _proposed_sql(kind: personal_data.Kind) -> str:
    """Matches of a kind with their places: each is marked in the text, which is cut at the marks."""
    pattern = kind.pattern.replace("'", "''")
    return rf"""SELECT doc_id, t, '{kind.name}' AS kind, unnest(p) AS part, unnest(range(0, len(p))) AS i
  FROM (SELECT doc_id, t, string_split(regexp_replace(t, '({pattern})', {_OPEN} || '\1' || {_SHUT}, 'g'), {_OPEN}) AS p FROM d)"""


def _digit_sum(digits: str) -> str:
    """Luhn's sum of a string of digits in SQL."""
    return (f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: (CASE WHEN i % 2 = 0 THEN (2 * CAST(substring({digits}, -i, 1) AS INT)) // 10"
            f" + (2 * CAST(substring({digits}, -i, 1) AS INT)) % 10 ELSE CAST(substring({digits}, -i, 1) AS INT) END)))")


_CONFIRMED = f"""CASE kind
  WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) > 255)) = 0
  WHEN 'card' THEN length(ds) BETWEEN 12 AND 19 AND {_digit_sum('ds')} % 10 = 0
  WHEN 'phone' THEN length(ds) BETWEEN 9 AND 15
  WHEN 'iban' THEN length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(
    string_split(substring(replace(m, ' ', ''), 5) || substring(replace(m, ' ', ''), 1, 4), ''), lambda c: CAST(CASE WHEN ord(c) < 58 THEN ord(c) - 48 ELSE ord(c) - 55 END AS BIGINT))),
    lambda a, b: (a * (CASE WHEN b < 10 THEN 10 ELSE 100 END) + b) % 97) = 1
  WHEN 'local_phone' THEN length(ds) BETWEEN 8 AND 13 ELSE true END"""


def _score_sql() -> str:
    near = f"lower(substring(t, greatest(s - {personal_data.NEAR}, 0) + 1, least(s, {personal_data.NEAR})))"
    cases = []
    for k in personal_data.KINDS:
        words, low = "|".join(k.words), round(k.prior + k.checksum, 2)
        cases.append(f"WHEN '{k.name}' THEN CASE WHEN regexp_matches({near}, '{words}') THEN {round(low + k.context, 2)} ELSE {low} END")
    return "CASE kind " + " ".join(cases) + " END"


_BESIDE_SQL = "CASE kind " + " ".join(
    f"WHEN '{k.name}' THEN regexp_matches(substring(t, s, CASE WHEN s > 0 THEN 1 ELSE 0 END) || substring(t, e + 1, 1), '[{k.beside}]')" for k in personal_data.KINDS if k.beside) + " ELSE false END"
_KIND_ROWS = ", ".join(f"('{k.name}', {n}, {str(k.base).lower()})" for n, k in enumerate(personal_data.KINDS))
_SPANS_OF = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n) FILTER ({where}), '')"
_COUNTS = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in personal_data.BASE)

PERSONAL_SQL = f"""
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds(kind, n, base) AS (VALUES {_KIND_ROWS}),
cuts AS ({' UNION ALL '.join(map(_proposed_sql, personal_data.KINDS))}),
placed AS (SELECT *, string_split(part, {_SHUT})[1] AS m,
  CAST(coalesce(sum(length(replace(part, {_SHUT}, ''))) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM cuts),
proposed AS (SELECT *, s + length(m) AS e, regexp_replace(m, '[^0-9]', '', 'g') AS ds FROM placed WHERE i > 0),
confirmed AS (SELECT *, {_score_sql()} AS score, {_BESIDE_SQL} AS beside FROM proposed JOIN kinds USING (kind) WHERE {_CONFIRMED}),
spans AS (SELECT * FROM confirmed c WHERE base OR (score >= {personal_data.LEAST} AND NOT beside AND NOT EXISTS (
  SELECT 1 FROM confirmed b WHERE b.base AND b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)))"""


@query("op12_personal_data", f"""WITH {PERSONAL_SQL}
SELECT doc_id, {_COUNTS}, sha256({_SPANS_OF('base')}) AS base_sha256, {_SPANS_OF('kind IS NOT NULL')} AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id""")
def _(spark, sf):
    found = personal_data.personal_data(documents(spark, sf), keep=["doc_id"])
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    base = of(*personal_data.BASE)
    return found.select(
        "row.doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in personal_data.BASE),
        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


# --- conversations -----------------------------------------------------------------------


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a string of ASCII characters in SQL."""
    bit = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda a, b: {byte}), 4294967295)"


def damaged(rows: DataFrame) -> DataFrame:
    """Known faults in a twentieth of the turns each, told by a hash of conversation and turn."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return marked.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _with_cost(path: str, cost: int, letters: str) -> str:
    """A path is its cost in eight digits and its edits, so that the least string is the first of the cheapest."""
    return f"(lpad(CAST(CAST({path}[1:8] AS INT) + {cost} AS VARCHAR), 8, '0') || {path}[9:] || '{letters}')"


_I2 = f"least(b2, {_with_cost('b0', 2, 'I')}, {_with_cost('b1', 2, 'I')}, {_with_cost('b3', 2, 'I')})"
_I3 = f"least(b3, {_with_cost('b2', 2, 'I')}, {_with_cost('b0', 4, 'II')}, {_with_cost('b1', 4, 'II')})"
_STAY = "CASE WHEN fault NOT IN ('blank', 'duplicate') OR fault IS NULL THEN"


def _stay(path: str, letter: str | None, made: bool) -> str:
    """Keep (if the initial is ``letter``) or change of the next turn, behind a path."""
    extra = "CAST(CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS INT)"
    ways = []
    for on, cost, edit in ([(f"r = '{letter}'", 0, "K")] if letter else []) + ([("true", 2, "R")] if made else []):
        ways.append(f"CASE WHEN {on} THEN lpad(CAST(CAST({path}[1:8] AS INT) + {cost} + {extra} AS VARCHAR), 8, '0') || {path}[9:] || '{edit}' END")
    return f"{_STAY} least({', '.join(ways)}) END" if len(ways) > 1 else f"{_STAY} {ways[0]} END"


REPAIR_SQL = rf"""
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
t AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER w AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
f AS (SELECT conv_id, turn, role, text, k, role[1:1] AS r, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY k) AS r0,
  CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (k > 1 AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
b AS (SELECT conv_id, 0::BIGINT AS k, '00000000' AS b0, NULL::VARCHAR AS b1, NULL::VARCHAR AS b2, NULL::VARCHAR AS b3 FROM c
  UNION ALL SELECT conv_id, k, {_with_cost('b0', 3, 'D')}, least({_with_cost('b1', 3, 'D')}, {_stay('b0', 's', False)}),
    least({_with_cost('i2', 3, 'D')}, {_stay('b0', 'u', True)}, {_stay('b1', 'u', True)}, {_stay('i3', 'u', True)}),
    least({_with_cost('i3', 3, 'D')}, {_stay('i2', 'a', True)})
  FROM (SELECT f.conv_id, f.k, f.r, f.fault, b0, b1, {_I2} AS i2, {_I3} AS i3 FROM b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.k = b.k + 1)),
a AS (SELECT c.*, least(b0, b3, {_with_cost('b2', 2, 'I')}, {_with_cost('b1', 4, 'II')}) AS best FROM c JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.k = c.n),
e AS (SELECT conv_id, unnest(string_split(best[9:], '')) AS edit, unnest(range(1, length(best) - 7)) AS i FROM a),
g AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS k,
  sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS j FROM e),
h AS (SELECT g.conv_id, g.i, g.edit, g.j, f.role, f.text, f.r, max(CASE WHEN j = 1 AND edit = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g.conv_id) AS s
  FROM g LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.k = g.k WHERE edit <> 'D'),
z AS (SELECT conv_id, string_agg((CASE WHEN edit = 'K' THEN role WHEN (j - s) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || (CASE WHEN edit = 'I' THEN '' ELSE text END), chr(10) ORDER BY i) AS whole FROM h GROUP BY conv_id)"""


@query("op11_turn_repair", f"""WITH RECURSIVE {REPAIR_SQL}
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best[1:8], '0') AS BIGINT) AS cost, coalesce(best[9:], '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM d.conv_id""")
def _(spark, sf):
    rows = conversations(spark, sf)
    report, repaired = turn_repair.repair(damaged(rows))
    pieces = repaired.select(F.col("conv_id").alias("key"), F.concat_ws(":", "role", "text").alias("piece"))
    digests = turns.joined_sha256(pieces, "\n")
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    both = every.join(report, every["id"].eqNullSafe(report["conv_id"]), "left")
    both = both.join(digests, every["id"].eqNullSafe(digests["key"]), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return both.select(F.col("id").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
                       F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", empty).alias("repaired_sha256"))


TRIE_SQL = rf"""
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY pos) AS own, any_value(conv_id - conv_id % 20) AS host, any_value({crc32_sql('conv_id::VARCHAR')} % 4) AS h FROM t GROUP BY conv_id),
r AS (SELECT a.conv_id, CASE WHEN h.own IS NULL THEN a.own[a.h + 1:] ELSE list_concat(h.own[1:a.h], a.own[a.h + 1:]) END AS path FROM l a LEFT JOIN l h ON h.conv_id = a.host),
p AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM r),
n AS (SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends FROM p GROUP BY 1, 2),
c AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.node[n.depth].text, '{_WORD}')) END AS saved
  FROM n LEFT JOIN c USING (node, depth)),
s AS (SELECT node[1:up] AS node, up AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM v) GROUP BY 1, 2)"""


@query("op13_prefix_trie", f"""WITH {TRIE_SQL}
SELECT v.conv_id, v.depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN s USING (node, depth) LEFT JOIN n q ON q.depth = v.depth - 1 AND q.node = v.node[1:v.depth - 1]""")
def _(spark, sf):
    conv = F.col("conv_id")
    rebuilt, every = prefix_trie.rebuilt(conversations(spark, sf), conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4)
    nodes, ends = prefix_trie.trie(rebuilt, every)
    digests = prefix_trie.member_digests(ends)
    longs = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return nodes.join(digests, ["depth", "key"], "left").select(
        *(F.col(c).cast("long").alias(c) for c in longs), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
