"""Spans of regular expressions in whole texts, by SQL functions alone.

Offsets count code points, ends are exclusive. Matches are wrapped in two control characters, the text is
cut at the first, and the lengths of the pieces are summed up, by blocks, so many matches stay linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"
_BLOCK = 128
SPANS = "array<struct<s:int,e:int,m:string>>"


def plain_text(text: Column) -> Column:
    """The text, '' for null; the two control characters give way to a third. No pattern may match any."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE)), F.translate(text, _OPEN + _CLOSE, _OTHER + _OTHER)).otherwise(text)


def no_spans() -> Column:
    return F.array().cast(SPANS)


def _located(parts: Column) -> Column:
    def add(a: Column, x: Column) -> Column:
        end = a["p"] + F.instr(x, _CLOSE) - 1
        span = F.struct(a["p"].alias("s"), end.alias("e"), F.substring_index(x, _CLOSE, 1).alias("m"))
        return F.struct((a["p"] + F.length(x) - 1).alias("p"), F.concat(a["out"], F.array(span)).alias("out"))

    def add_block(a: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(a["p"].alias("p"), no_spans().alias("out")), add)
        return F.struct(inner["p"].alias("p"), F.concat(a["out"], F.array(inner["out"])).alias("out"))

    last = F.floor((F.size(parts) - 2) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(parts, b * _BLOCK + 2, F.lit(_BLOCK)))
    start = F.struct(F.length(parts[0]).alias("p"), F.array().cast(f"array<{SPANS}>").alias("out"))
    return F.flatten(F.aggregate(blocks, start, add_block)["out"])


def with_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """df with a column of spans for each name: leftmost matches that don't overlap, as a Java pattern finds
    them. A name's condition, if any, says cheaply which texts may match at all."""
    names = list(patterns)
    marked = [F.regexp_replace(F.col(text), patterns[n][0], f"{_OPEN}$0{_CLOSE}") for n in names]
    marked = [m if patterns[n][1] is None else F.when(patterns[n][1], m).otherwise(F.lit("")) for n, m in zip(names, marked)]
    df = df.select("*", *(m.alias(f"_m_{n}") for n, m in zip(names, marked)))
    hit = lambda n: F.contains(F.col(f"_m_{n}"), F.lit(_OPEN))
    df = df.select("*", *(F.when(hit(n), F.split(F.col(f"_m_{n}"), _OPEN)).alias(f"_p_{n}") for n in names))
    df = df.select("*", *(F.when(F.col(f"_p_{n}").isNotNull(), _located(F.col(f"_p_{n}"))).otherwise(no_spans()).alias(n) for n in names))
    return df.drop(*(f"_m_{n}" for n in names), *(f"_p_{n}" for n in names))


def listed(kinds: tuple[str, ...], by_kind: bool) -> Column:
    """kind:start:end of all spans in the columns of these names, comma-joined, by kind or by start first."""

    def one(i: int, kind: str) -> Column:
        place = lambda x: (F.lit(i).alias("i"), x["s"].alias("s")) if by_kind else (x["s"].alias("s"), F.lit(i).alias("i"))
        return F.transform(F.col(kind), lambda x: F.struct(*place(x), x["e"].alias("e"), F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")).alias("n")))

    every = F.concat(*(one(i, k) for i, k in enumerate(kinds)))
    return F.array_join(F.transform(F.array_sort(every), lambda x: x["n"]), ",")


def overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by a rational approximation of erfc (1.2e-7)."""
    x = F.abs(z) / 2**0.5
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.5)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = poly * t + c
    return F.least(F.lit(1.0), t * F.exp(-x * x - 1.26551223 + t * poly))
