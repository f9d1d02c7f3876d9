"""Quality rules as a bitmask ledger.

Every rule is evaluated once over a whole text. The ledger keeps the measurements and, in `fail_bits`,
one bit per failed rule. Policies are versioned bit masks over the ledger; ablations are counted from
the distinct bit patterns, so no text is read again for a new policy.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, keep, prepare, read_table, stage_of

MEASURES = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_lines:bigint,n_repeat_words:bigint,n_upper_words:bigint>"
#: (rule, SQL over the measurements); a rule's bit is its place. Integers only: every engine agrees.
RULES = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_heavy", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("shouting", "100 * n_upper_words > 50 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
)
_SYMBOLS = b"#*$%&|<>"
_OTHER = bytes(x for x in range(256) if x not in _SYMBOLS)
_CONTINUED = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Policy:
    """A version of the rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        known = [name for name, _ in RULES]
        return sum(1 << known.index(rule) for rule in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_windows"))
CURRENT = Policy("2026-01", tuple(name for name, _ in RULES))


def measure(text: bytes) -> tuple[int, int, int, int, int, int, int]:
    """The measurements of one text (UTF-8), in the order of MEASURES."""
    words = text.split()  # bytes split on exactly the six ASCII blanks
    n = len(words)
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()] if n else []
    seen = set(lines)
    starts: dict = {}
    again = bytearray(n)
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        first = starts.setdefault(window, i)
        if first != i:
            again[i : i + 3] = b"\1\1\1"
            again[first : first + 3] = b"\1\1\1"
    upper = sum(1 for x in words if len(x) > 1 and x.isupper())
    return n, len(joined) - _continued(joined), len(text.translate(None, _OTHER)), len(lines) - len(seen), len(lines), sum(again), upper


def _continued(data: bytes) -> int:
    """Bytes that continue a UTF-8 character."""
    return 0 if data.isascii() else len(data) - len(data.translate(None, _CONTINUED))


def _measured(texts: pa.Array) -> pa.Array:
    rows = [measure(x or b"") for x in texts.cast(pa.binary()).to_pylist()]
    columns = zip(*rows) if rows else [[]] * 7
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper_words")
    return pa.StructArray.from_arrays([pa.array(list(x), pa.int64()) for x in columns], names)


def fail_bits(measures: str) -> Column:
    """The failed rules of a struct column of measurements, one bit each."""
    bits = [f"(CASE WHEN {rule} THEN {1 << i} ELSE 0 END)" for i, (_, rule) in enumerate(RULES)]
    return F.expr(re.sub(r"\b(n_\w+|word_chars)\b", rf"{measures}.\1", " | ".join(bits))).cast("bigint")


def ledger(docs: DataFrame, text: str = "text", measures: str = "measures", bits: str = "fail_bits") -> DataFrame:
    """docs with a column `measures` (measurements) and `bits` (failed rules, one bit each).

    Null and empty texts measure zero and fail too_few_words. Rows are judged one by one: repeated rows
    get the same ledger line each; a column of docs with one of the two names gives way, all others pass through
    untouched. An empty table stays empty.
    """
    prepare(docs.sparkSession)
    return docs.withColumn(measures, arrow(_measured, MEASURES)(F.col(text))).withColumn(bits, fail_bits(measures))


def stored(docs: DataFrame, *columns: str) -> DataFrame:
    """The ledger of docs, written to the shared folder: `columns` of docs, measures, fail_bits. Policies and
    ablations read it; the texts are never measured again."""
    return keep(ledger(docs).select(*columns, "measures", "fail_bits"), "ledger")


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) == 0


def ablations(found: DataFrame, policies: Iterable[Policy] = (BASE, CURRENT)) -> DataFrame:
    """found, a ledger: for each policy and rule the documents that fail it, and those that only it rejects.

    At most 2 ** len(RULES) bit patterns leave the first aggregation, whatever the corpus holds.
    """
    patterns = found.groupBy("fail_bits").agg(F.count("*").alias("n"))
    parts = []
    for policy in policies:
        masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
        for rule in policy.rules:
            bit = Policy("", (rule,)).mask
            parts.append(F.struct(F.lit(policy.version).alias("policy"), F.lit(rule).alias("rule"), (masked.bitwiseAND(F.lit(bit)) != 0).cast("bigint").alias("failed"), (masked == bit).cast("bigint").alias("only")))
    rows = patterns.select("n", F.explode(F.array(*parts)).alias("x")).select("n", "x.*")
    return rows.groupBy("policy", "rule").agg(F.sum(F.col("failed") * F.col("n")).alias("n_failed"), F.sum(F.col("only") * F.col("n")).alias("n_only"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger of all documents under the base and the current policy."""
    found = stored(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return found.select("doc_id", *(f"measures.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), (~passes(BASE)).alias("base_failed"), passes(CURRENT).alias("kept"), "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ablations of both policies over the stored ledger of all documents."""
    return ablations(stored(read_table(spark, sf_dir, "documents").select("text")))


@stage_of("text")
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return ledger(docs, measures="_m", bits="_bits").where(passes(CURRENT, "_bits")).drop("_m", "_bits")


_WORDS = r"[^\x20\x09-\x0D]+"
_CTE = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
g AS (SELECT r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s, i FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY r),
l AS (SELECT r, list_filter(ls, lambda x: regexp_matches(x, '{_WORDS}')) AS ls FROM d),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l.ls) - len(list_distinct(l.ls)))::BIGINT AS n_dup_lines, len(l.ls)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  len(list_filter(w, lambda x: octet_length(encode(x)) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS n_upper_words
  FROM d JOIN l USING (r) LEFT JOIN c USING (r)),
b AS (SELECT *, {" + ".join(f"(CASE WHEN {rule} THEN {1 << i} ELSE 0 END)" for i, (_, rule) in enumerate(RULES))} AS fail_bits FROM f)"""
OP6_SQL = f"""{_CTE}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {BASE.mask}) <> 0 AS base_failed, (fail_bits & {CURRENT.mask}) = 0 AS kept, fail_bits::BIGINT AS fail_bits FROM b"""
ABLATION_SQL = _CTE + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{p.version}' AS policy, '{rule}' AS rule, count(*) FILTER ((fail_bits & {Policy('', (rule,)).mask}) <> 0)::BIGINT AS n_failed, count(*) FILTER ((fail_bits & {p.mask}) = {Policy('', (rule,)).mask})::BIGINT AS n_only FROM b" for p in (BASE, CURRENT) for rule in p.rules
)
