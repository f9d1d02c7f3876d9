"""The model surface: a provider answers batches. The default is deterministic and needs no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import redacted

MODES = ("translation", "editing", "audit", "repair", "consistency")


class ProviderError(Exception):
    """kind: temporary, invalid_response, request_too_large or fatal."""

    def __init__(self, kind: str) -> None:
        super().__init__(kind)
        self.kind = kind


def answer(text: str, mode: str) -> str:
    return f"[translated] {text}" if mode == "translation" else '{"issues":[]}' if mode == "audit" else text


def answered(text: Column, mode: str) -> Column:
    """The deterministic provider as a column."""
    return F.concat(F.lit("[translated] "), text) if mode == "translation" else F.lit('{"issues":[]}') if mode == "audit" else text


@dataclass
class Registry:
    """Providers by name; a name is taken once, an instance is made once."""

    makers: dict[str, Callable] = field(default_factory=dict)
    made: dict[str, object] = field(default_factory=dict)

    def add(self, name: str, maker: Callable) -> None:
        if name in self.makers:
            raise ValueError(f"{name} is registered already")
        self.makers[name] = maker

    def get(self, name: str):
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]


def may_retry(kind: str, attempt: int, most: int = 2) -> bool:
    """Temporary failures get two attempts more than invalid answers."""
    return kind == "temporary" and attempt < most + 2 or kind == "invalid_response" and attempt < most


def delay_ms(attempt: int, jitter: float = 1.0) -> float:
    """Doubling from half a second, half a minute at most; jitter from 0.8 to 1.2."""
    return min(30_000.0, 500.0 * 2**attempt) * min(1.2, max(0.8, jitter))


def split_near_middle(text: str) -> tuple[str, str]:
    """Two parts, cut after the blank nearest to the middle, or in it."""
    places = [i + 1 for i, c in enumerate(text[:-1]) if c.isspace()]
    at = min(places, key=lambda i: abs(i - len(text) // 2), default=len(text) // 2)
    return text[:at], text[at:]


def complete(segments: list[tuple[str, str]], call: Callable, most: int = 2) -> list[tuple[str, str]]:
    """Answers for (id, text) in order. Retries what may pass, halves what is too large or stays invalid; a
    single text that is too large is cut near its middle."""
    for attempt in range(most + 3):
        try:
            got = call(segments)
            if [i for i, _ in got] != [i for i, _ in segments] or any(not t for _, t in got):
                raise ProviderError("invalid_response")
            return got
        except ProviderError as e:
            if e.kind == "request_too_large" or not may_retry(e.kind, attempt, most):
                if e.kind not in ("request_too_large", "invalid_response"):
                    raise
                if len(segments) > 1:
                    half = len(segments) // 2
                    return complete(segments[:half], call, most) + complete(segments[half:], call, most)
                (name, text), = segments
                if e.kind == "invalid_response" or len(text) < 2:
                    raise
                parts = complete([(f"{name}~adaptive-{i + 1}", t) for i, t in enumerate(split_near_middle(text))], call, most)
                return [(name, "".join(t for _, t in parts))]
    raise ProviderError("invalid_response")


def run_batches(batches: DataFrame, mode: str, call: Callable | None = None) -> DataFrame:
    """batches: batch_id, segs: array<struct<id, text>>. Answered segments; batches are independent, so each
    Arrow batch asks for its own."""
    ask = call or (lambda segments: [(i, answer(t, mode)) for i, t in segments])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = [(b, i, t) for b, segs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, t in complete([(s["id"], s["text"]) for s in segs], ask)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in ([*zip(*out)] or [()] * 3)], ["batch_id", "seg_id", "text"])

    return batches.select("batch_id", "segs").mapInArrow(run, "batch_id string, seg_id string, text string")


def answers_match(wanted: Column, got: Column) -> Column:
    """Whether answered ids are the requested ones, in order and once each."""
    return (wanted == got) & (F.size(F.array_distinct(got)) == F.size(got))


def or_fallback(edited: Column, draft: Column) -> Column:
    """A blank edit leaves the draft."""
    return F.when(F.trim(F.coalesce(edited, F.lit(""))) == "", draft).otherwise(edited)


def prompt(mode: Column, segments: Column, glossary: Column) -> Column:
    return F.to_json(F.struct(mode.alias("mode"), segments.alias("segments"), glossary.alias("glossary")))


def call_outcome(kind: Column, message: Column) -> Column:
    """How a call ended, for its usage record: kind is null if it went well."""
    return F.when(kind.isNull(), "ok").when(kind.isin("invalid_response", "configuration"), kind).when(F.regexp_like(message, F.lit("(?i)timed out")), "timeout").otherwise("error")


def usage_records(calls: DataFrame) -> DataFrame:
    """calls: call_id, run_id, mode, segments (ids), profile, endpoint, model, prompt_tokens, cached_prompt_tokens, completion_tokens,
    kind, message. One record a call, failed ones too: tokens that aren't whole numbers from 0 on are unknown, a total needs one of the two;
    the message is redacted and cut."""
    tokens = lambda c: F.when((F.col(c) >= 0) & (F.col(c) == F.floor(c)), F.col(c)).cast("bigint")
    prompt, completion = tokens("prompt_tokens"), tokens("completion_tokens")
    total = F.when(prompt.isNotNull() | completion.isNotNull(), F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))).cast("bigint")
    return calls.select(
        "call_id", "run_id", F.col("mode").alias("stage"), F.get("segments", F.lit(0)).alias("operation"), "profile", "endpoint", "model", call_outcome(F.col("kind"), F.col("message")).alias("outcome"),
        F.when(F.col("message") != "", F.substring(redacted("message"), 1, 300)).alias("detail"), prompt.alias("prompt_tokens"), tokens("cached_prompt_tokens").alias("cached_prompt_tokens"), completion.alias("completion_tokens"), total.alias("total_tokens"),
    )


def metered(call: Callable, record: Callable, guard: Callable | None = None) -> Callable:
    """call(segments), after guard(), with record(kind, message, usage) for every call that was sent, whether it went well or not."""

    def run(segments):
        if guard:
            guard()
        try:
            answered_ = call(segments)
        except ProviderError as error:
            record(error.kind, str(error), getattr(error, "usage", None))
            raise
        record(None, "", None)
        return answered_

    return run
