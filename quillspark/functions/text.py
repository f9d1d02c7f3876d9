"""Scalar text functions. Lengths count code points; JS counts UTF-16 units, which differs beyond the BMP."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts in Java's notation.
LATIN, CYRILLIC = r"\p{IsLatin}", r"\p{IsCyrillic}"
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
#: Keys that never leave a run. Fixed values.
REDACTIONS = (
    (r"(?i)(api[_-]?key|authorization|bearer|password|secret|token)\s*[:=]\s*[^\s,;]+", "$1=[redacted]"),
    (r"sk-[A-Za-z0-9_-]{8,}", "[redacted]"),
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body and its lambdas refer to it."""
    return F.transform(F.array(value), body)[0]


def trimmed(c: Column | str) -> Column:
    """Without any Unicode white space at the ends; Spark's trim takes blanks only."""
    return F.regexp_replace(col(c), r"(?U)^\s+|(?U)\s+$", "")


def collapsed(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def clipped(c: Column | str, n: int = 320) -> Column:
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def count_of(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def occurrences(haystack: Column | str, needle: Column | str) -> Column:
    """Non-overlapping occurrences of a substring."""
    h, n = col(haystack), col(needle)
    return F.when(F.length(n) > 0, ((F.length(h) - F.length(F.replace(h, n, F.lit("")))) / F.length(n)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def expected_expansion(c: Column | str) -> Column:
    """How many times as long a faithful translation is: 3 if most characters are CJK."""
    return F.when(count_of(c, CJK) * 2 > F.length(col(c)), 3).otherwise(1)


def dominant_script(c: Column | str) -> Column:
    """latin, cyrillic or cjk, whichever has most letters; none on a tie for the first place."""
    counts = [(count_of(c, p), name) for p, name in ((LATIN, "latin"), (CYRILLIC, "cyrillic"), (CJK, "cjk"))]
    most = F.greatest(*(n for n, _ in counts))
    winners = sum(((n == most).cast("int") for n, _ in counts), F.lit(0))
    named = F.coalesce(*(F.when(n == most, F.lit(name)) for n, name in counts))
    return F.when(winners == 1, named).otherwise("none")


def redacted(c: Column | str) -> Column:
    c = col(c)
    for pattern, by in REDACTIONS:
        c = F.regexp_replace(c, pattern, by)
    return c


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def escaped(c: Column | str) -> Column:
    """With a backslash before each sign that a regular expression reads."""
    return F.regexp_replace(col(c), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def bounded(c: Column | str) -> Column:
    """A pattern for the term as a whole word, wherever it begins or ends like one."""
    c = col(c)
    wordlike = r"[\p{L}\p{N}]"
    left = F.when(F.substring(c, 1, 1).rlike(wordlike), F.lit(r"(?<![\p{L}\p{N}])")).otherwise("")
    right = F.when(F.substring(c, -1, 1).rlike(wordlike), F.lit(r"(?![\p{L}\p{N}])")).otherwise("")
    return F.concat(F.lit("(?iu)"), left, escaped(c), right)


def mentions(text: Column | str, term: Column | str) -> Column:
    """Whether a text holds a term as a whole word, in any case."""
    return F.regexp_like(col(text), bounded(term))


def shared_prefix(a: Column | str, b: Column | str) -> Column:
    """Characters that two words have in common from their start on."""
    a, b = col(a), col(b)
    n = F.least(F.length(a), F.length(b))
    upto = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.array_max(upto)


def base36(c: Column | str) -> Column:
    return F.lower(F.conv(col(c).cast("string"), 10, 36))


def two_decimals(c: Column | str) -> Column:
    """A double rounded by its exact value, ties to even, as printf does in C; Spark's rounds the shortest decimal half up."""
    return F.call_function("format_number", col(c), F.lit("0.00"))


def numbers(c: Column | str) -> Column:
    """Numbers of at most six digits: subscripts count as digits, separators of thousands don't part them."""
    c = F.translate(col(c), "₀₁₂₃₄₅₆₇₈₉", "0123456789")
    # a group is thousands only if its whole run is 1 to 3 digits, then groups of exactly three
    grouped = r"[0-9]{1,3}(?:[.,    '’][0-9]{3})+"
    marked = F.split(F.regexp_replace(c, f"({grouped})", "\x01$1\x02"), "\x01")
    flat = F.transform(marked, lambda x: F.when(F.contains(x, F.lit("\x02")), F.concat(F.regexp_replace(F.substring_index(x, "\x02", 1), "[^0-9]", ""), F.substring_index(x, "\x02", -1))).otherwise(x))
    return F.filter(F.regexp_extract_all(F.array_join(flat, ""), F.lit("([0-9]+)"), 1), lambda x: F.length(x) <= 6)


def removed_once(have: Column, gone: Column) -> Column:
    """The values of one array, in order, that the other doesn't hold as often: a multiset difference."""

    def kept(v: Column) -> Column:
        def step(x: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(v["a"], F.lit(1), i + 1), lambda y: y == x))
            return F.when(before > F.size(F.filter(v["b"], lambda y: y == x)), x)

        return F.filter(F.transform(v["a"], step), lambda x: x.isNotNull())

    return let(F.struct(have.alias("a"), gone.alias("b")), kept)


def last_wins(entries: Column) -> Column:
    """A map of entries (key, value) in which the last of several entries with one key counts, as in an object literal."""
    keys = F.array_distinct(F.transform(entries, lambda x: x["key"]))
    value = lambda k: F.element_at(F.filter(entries, lambda x: x["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, value))


def tolerant_json(c: Column | str, schema: str) -> Column:
    """An answer parsed as it is, else what its fence holds, else from its first brace to its last; null if none parses."""
    c = col(c)
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    parsed = lambda x: F.from_json(F.when(F.get_json_object(x, "$").isNotNull(), x), schema)
    return F.coalesce(parsed(F.trim(c)), parsed(F.trim(fenced)), parsed(braced))


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds to wait that a Retry-After header asks for: a number, or a date; none below zero, null if it is neither."""
    date = F.try_to_timestamp(F.regexp_extract(value, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.when(F.trim(value).rlike(r"^\d+(?:\.\d+)?$"), F.trim(value).cast("double"))
    return let(F.coalesce(seconds, (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double")), lambda x: F.when(x < 0, 0.0).otherwise(x))
