"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models, one after toxic documents, one after ordinary ones. Their highest order is words
after the word before them. What it hasn't seen backs off to a model that spells words character by character, whose
long contexts have counts of their own and whose short ones share continuation counts between the classes: so a
rare expression, or a rare form of one, borrows from what it looks like. A document's evidence is the difference of
its two log-likelihoods by word, and that of its strongest words and pairs by character. A logistic curve fitted on
labelled rows of their own makes it a score.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, keep, prepare, read_table

#: Labelled documents of each class that the models, and the curve, are fitted on at most.
MODEL_DOCS, CURVE_DOCS = 2000, 1000
#: Characters of the longest gram; grams up to SHARED characters have one set of counts.
ORDER, SHARED = 6, 2
#: Order below which probabilities are remembered for all longer grams that end alike.
SHORT = 4
#: Characters of a word that are scored, and remembered, as one.
PIECE = 40
DISCOUNT = 0.75
#: Documents that a pair of words must stand in to be one of the highest order; the mass of others goes to the backoff.
PAIR_DOCS = 2
#: Words, and tokens between blanks, that a worker remembers: some 120 MB.
REMEMBERED = 300_000
#: Grams whose log-ratio a worker remembers, some 100 MB, and whose shorter forms it does.
GRAMS, SHORTS = 500_000, 200_000
STRONGEST = 3
_EDGES = ".,;:!?*#$%&|<>\"'()[]{}«»„“”‘’…-–—"


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, bare of signs around them; those longer than PIECE in pieces of it, which
    share ORDER - 1 characters, so every gram of a word is whole in one of them."""
    step = PIECE - ORDER + 1
    return [w[i : i + PIECE] for x in text.lower().split() if (w := x.strip(_EDGES)) for i in (range(0, len(w) - ORDER + 1, step) if len(w) > PIECE else (0,))]


class KneserNey:
    """Two character models over counts of words: {word: (toxic, ordinary)}, documents that hold it."""

    def __init__(self, words: dict[str, tuple[int, int]]) -> None:
        top = [defaultdict(int), defaultdict(int)]  # grams of full length, or from the word's start
        for word, counts in words.items():
            s = f"\x02{word}\x03"
            for i in range(1, len(s)):
                gram = s[max(0, i + 1 - ORDER) : i + 1]
                for c in (0, 1):
                    if counts[c]:
                        top[c][gram] += counts[c]
        self.levels: list[dict[int, tuple[dict, dict]]] = [{}, {}]
        for c in (0, 1):
            self.levels[c][ORDER] = self._contexts(top[c])
        grams = [top[0], top[1]]
        for n in range(ORDER - 1, 0, -1):
            # continuation counts: how many distinct characters stand before a gram
            below = []
            for c in (0, 1):
                types = defaultdict(int)
                for gram, count in grams[c].items():
                    if len(gram) > n:
                        types[gram[1:]] += 1
                    elif gram[0] == "\x02" or len(gram) <= n:
                        types[gram] += count  # a word's start has nothing before it
                below.append(types)
            if n <= SHARED:
                both = defaultdict(int)
                for types in below:
                    for gram, count in types.items():
                        both[gram] += count
                below = [both, both]
            grams = below
            for c in (0, 1):
                self.levels[c][n] = self._contexts(grams[c])
        self.ratios = _Ratios(self)
        self.short: tuple[dict[str, float], dict[str, float]] = ({}, {})

    @staticmethod
    def _contexts(grams: dict[str, int]) -> tuple[dict, dict]:
        total: dict[str, list] = {}
        for gram, count in grams.items():
            t = total.setdefault(gram[:-1], [0, 0])
            t[0] += count
            t[1] += 1
        return dict(grams), {h: tuple(t) for h, t in total.items()}

    def p(self, c: int, gram: str, n: int) -> float:
        """Probability of the last character of a gram after those before it, in the model of order n of class c."""
        if n == 0:
            return 1 / 256
        if n == SHORT and (x := self.short[c].get(gram)) is not None:
            return x
        counts, contexts = self.levels[c][n]
        known = contexts.get(gram[:-1])
        x = self.p(c, gram[1:] if len(gram) >= n and len(gram) > 1 else gram, n - 1)
        if known is not None:
            total, types = known
            x = max(counts.get(gram, 0) - DISCOUNT, 0) / total + DISCOUNT * types / total * x
        if n == SHORT:
            if len(self.short[c]) > SHORTS:
                self.short[c].clear()
            self.short[c][gram] = x
        return x

    def logs(self, word: str) -> tuple[float, float]:
        """Toxic and ordinary log-likelihood of a word, all characters and its end together."""
        grams = grams_of(word)
        return sum(math.log(self.p(0, g, ORDER)) for g in grams), sum(math.log(self.p(1, g, ORDER)) for g in grams)

    def evidence(self, word: str) -> float:
        """Their difference."""
        if len(self.ratios) > GRAMS:
            self.ratios.clear()
        return sum(map(self.ratios.__getitem__, grams_of(word)))


def grams_of(word: str) -> list[str]:
    """The gram of each character of a word and of its end."""
    s = f"\x02{word}\x03"
    return [s[i - ORDER + 1 if i >= ORDER else 0 : i + 1] for i in range(1, len(s))]


class _Ratios(dict):
    """The log-ratio of the two classes' probabilities by gram."""

    def __init__(self, model: KneserNey) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, gram: str) -> float:
        found = self[gram] = math.log(self.model.p(0, gram, ORDER) / self.model.p(1, gram, ORDER))
        return found


class Pairs:
    """The highest order: evidence of words after the word before, and of a word's backoff for all others.

    pairs: {(first, second): (toxic, ordinary)}, firsts: {first: (toxic, ordinary)}, all pairs that it begins; numbers
    of documents. What pairs lacks of firsts is backoff mass, as are the discounts.
    """

    def __init__(self, model: KneserNey, pairs: dict, firsts: dict) -> None:
        self.after: dict[str, dict[str, float]] = {}
        self.backoff: dict[str, float] = {}
        logs = {w: model.logs(w) for w in {b for _, b in pairs}}
        kept = defaultdict(lambda: [0.0, 0.0])
        for (a, _), counts in pairs.items():
            for c in (0, 1):
                kept[a][c] += max(counts[c] - DISCOUNT, 0.0)
        for a, mass in kept.items():
            total = firsts[a]
            left = [1 - m / n if n else 1.0 for m, n in zip(mass, total)]
            self.backoff[a] = math.log(left[0] / left[1])
            kept[a] = left
        for (a, b), counts in pairs.items():
            p = [(max(counts[c] - DISCOUNT, 0.0) / firsts[a][c] if firsts[a][c] else 0.0) + kept[a][c] * math.exp(max(logs[b][c], -600.0)) for c in (0, 1)]
            self.after.setdefault(a, {})[b] = math.log(p[0] / p[1])


class _Tokens(dict):
    """Ids of the words that tokens between blanks are: NONE for one without letters, SEVERAL for a long one in pieces."""

    NONE, SEVERAL = -1, -2

    def __init__(self, add) -> None:
        super().__init__()
        self.add = add

    def __missing__(self, token: str) -> int:
        words = words_of(token)
        found = self[token] = self.add(words[0]) if len(words) == 1 else self.SEVERAL if words else self.NONE
        return found


class Scorer:
    """Features of texts. Words have ids, what is known of a word stands in arrays under its id."""

    def __init__(self, words: dict[str, tuple[int, int]], pairs: Pairs | None = None) -> None:
        self.model, after = KneserNey(words), pairs.after if pairs else {}
        seconds = sorted({b for follow in after.values() for b in follow})
        self.first, self.second = {w: i for i, w in enumerate(sorted(after))}, {w: i + 1 for i, w in enumerate(seconds)}
        self.stride = len(seconds) + 1
        known = sorted((self.first[a] * self.stride + self.second[b], x) for a, follow in after.items() for b, x in follow.items())
        self.codes, self.values = np.array([c for c, _ in known], np.int64), np.array([x for _, x in known])
        self.backoff = np.array([pairs.backoff[w] for w in self.first]) if pairs else np.empty(0)
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.tokens = _Tokens(self._add)
        #: By id: evidence, characters and the end, place as a first and as a second word of pairs.
        self.evidence_of, self.length_of, self.first_of, self.second_of = np.empty(0), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)

    def _add(self, word: str) -> int:
        if (known := self.ids.get(word)) is not None:
            return known
        i = self.ids[word] = len(self.ids)
        if i >= len(self.evidence_of):
            for name in ("evidence_of", "length_of", "first_of", "second_of"):
                old = getattr(self, name)
                new = np.zeros(max(1024, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.evidence_of[i], self.length_of[i] = self.model.evidence(word), len(word) + 1
        self.first_of[i], self.second_of[i] = self.first.get(word, -1), self.second.get(word, 0)
        return i

    def features(self, text: str) -> list[float]:
        """Strongest words by character, mean by word over all the text, of what speaks for toxic alone, logarithm of
        the number of words, and strongest pair by character."""
        if len(self.ids) > REMEMBERED:
            self._forget()
        elif len(self.tokens) > REMEMBERED:
            self.tokens.clear()
        tokens = text.lower().split()
        ids = np.fromiter(map(self.tokens.__getitem__, tokens), np.int64, len(tokens))
        if (ids == _Tokens.SEVERAL).any():
            ids = np.array([self._add(w) for t in tokens for w in words_of(t)], np.int64)
        ids = ids[ids >= 0]
        if not len(ids):
            return [0.0] * FEATURES
        every, n, strongest = self.evidence_of[ids], len(ids), 0.0
        distinct = np.unique(ids)
        found = np.sort(self.evidence_of[distinct] / self.length_of[distinct])[: -STRONGEST - 1 : -1].tolist()
        if len(self.codes) and n > 1:
            firsts = self.first_of[ids[:-1]]
            at = np.flatnonzero(firsts >= 0)
            if len(at):
                firsts, then = firsts[at], ids[at + 1]
                code = firsts * self.stride + self.second_of[then]
                place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[place] == code
                every[at + 1] = np.where(hit, self.values[place], every[at + 1] + self.backoff[firsts])
                if hit.any():
                    strongest = max(0.0, float((self.values[place[hit]] / self.length_of[then[hit]]).max()))
        return [*found, *[min(found[-1], 0.0)] * (STRONGEST - len(found)), float(every.sum()) / n, float(every[every > 0].sum()) / n, math.log(n), strongest]


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method with a small ridge: (mean, scale, weights)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)) * 0.1
        step = np.linalg.solve(h, z.T @ (y - p) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


FEATURES = STRONGEST + 4
_SCORERS: dict[int, Scorer] = {}


def _scorer(words) -> Scorer:
    """One scorer a worker for the latest model."""
    if words.id not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[words.id] = Scorer(*words.value)
        words.broadcast.__dict__.pop("_value", None)  # the scorer has all it needs; it can be loaded again
    return _SCORERS[words.id]


class _Words:
    """The broadcast counts of words, and pairs, with a name that workers can tell models by."""

    def __init__(self, broadcast) -> None:
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return self.broadcast, self.id

    def __setstate__(self, state):
        self.broadcast, self.id = state

    @property
    def value(self):
        return self.broadcast.value


def with_features(docs: DataFrame, words: _Words, out: str = "_x") -> DataFrame:
    """docs with a column `out`, the features of the text; null texts count as empty."""

    def run(texts: pa.Array) -> pa.Array:
        scorer = _scorer(words)
        return pa.array([scorer.features(t or "") for t in texts.to_pylist()], pa.list_(pa.float64()))

    return docs.withColumn(out, arrow(run, "array<double>")(F.col("text")))


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5


class Model:
    """What train() learns: the word counts and the curve, or a constant where a class has no documents."""

    def __init__(self, words: _Words | None, curve, constant: float = 0.0) -> None:
        self.words, self.curve, self.constant = words, curve, constant


def train(docs: DataFrame, labels: DataFrame, model_docs: int = MODEL_DOCS, curve_docs: int = CURVE_DOCS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Rows of fold 0 are never read.

    Folds 1 to 3 give the word counts, fold 4 the curve. Of each class at most model_docs and curve_docs
    labelled rows count, those with the least hashed ids: the sample is the same in every run, and what
    reaches the driver, its distinct words, and pairs in PAIR_DOCS documents, with counts, is bounded by it.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = labels.select("doc_id", "toxic", fold().alias("f")).where("f <> 0 and toxic in (0, 1)")

    def sample(where: str, n: int) -> DataFrame:
        parts = [known.where(where).where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c in (0, 1)]
        ids = parts[0].unionByName(parts[1])
        return docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id", "toxic")), "doc_id")  # at most 2 n rows

    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("toxic", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words (with no second) and pairs of words of each document, once each."""
        for batch in batches:
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text or "")
                rows = [*((w, None) for w in sorted({*words})), *sorted({*zip(words, words[1:])})]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.string()), pa.array([t] * len(rows), pa.int64()), pa.array([1] * len(rows), pa.int64())], schema=schema)

    def collected(df: DataFrame, keys: int) -> dict:
        table = df.toArrow()
        rows = sorted(zip(*(table.column(i).to_pylist() for i in range(keys + 2))))
        return {r[0] if keys == 1 else r[:2]: r[-2:] for r in rows}

    rows = sample("f < 4", model_docs).select("toxic", "text").mapInArrow(count, "a string, b string, toxic bigint, n bigint")
    both = (F.sum(F.col("toxic") * F.col("n")).alias("t"), F.sum((1 - F.col("toxic")) * F.col("n")).alias("o"))
    table = keep(rows.groupBy("a", "b").agg(*both), "counts")
    counts = collected(table.where("b is null").select("a", "t", "o"), 1)
    if not any(t for t, _ in counts.values()) or not any(o for _, o in counts.values()):
        return Model(None, None, float(any(t for t, _ in counts.values())))
    frequent = table.where(F.col("b").isNotNull() & (F.col("t") + F.col("o") >= PAIR_DOCS))
    firsts = table.where("b is not null").groupBy("a").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.max((F.col("t") + F.col("o") >= PAIR_DOCS).cast("int")).alias("f")).where("f = 1").select("a", "t", "o")
    pairs = Pairs(KneserNey(counts), collected(frequent.select("a", "b", "t", "o"), 2), collected(firsts, 1))
    words = _Words(spark.sparkContext.broadcast((counts, pairs)))
    found = sorted((r.toxic, list(r._x)) for r in with_features(sample("f = 4", curve_docs), words).select("toxic", "_x").collect())
    y = np.array([t for t, _ in found], float)
    if not 0 < y.sum() < len(y):  # a curve needs both classes
        return Model(words, (np.zeros(FEATURES), np.ones(FEATURES), np.array([0.1] * STRONGEST + [0.0] * 4 + [-1.0])))
    return Model(words, fit_curve(np.array([x for _, x in found]), y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score` from 0 to 1, from the text alone. Every row has one; null and empty texts that of no words.

    Rows that repeat have the same score each, an empty table stays empty. A column of docs named score gives way, all
    others pass through untouched.
    """
    if model.words is None:
        return docs.withColumn("score", F.lit(model.constant))
    mean, scale, w = (x.tolist() for x in model.curve)
    x = f"_x{uuid.uuid4().hex}"  # no column of docs
    linear = F.lit(w[-1])
    for i in range(FEATURES):
        linear = linear + (F.col(x)[i] - mean[i]) / scale[i] * w[i]
    linear = F.least(F.greatest(linear, F.lit(-700.0)), F.lit(700.0))
    return with_features(docs, model.words, x).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))).drop(x)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored() over all documents, by a model of the labelled rows outside fold 0."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    held = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    return scored(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
