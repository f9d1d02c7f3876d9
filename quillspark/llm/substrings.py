"""Substring dedup by prefix-partitioned suffix trees.

A window is `WINDOW` consecutive words of a document. Each window has an anchor: of the `PREFIX`-word
sequences inside it, the one with the least hash. Equal windows have equal anchors at equal places, so
neighbouring windows that share an anchor travel as one piece of text, and all of them hold the words of the
anchor: a prefix of `PREFIX` words under which their suffixes meet. A prefix that occurs once in the corpus
holds no repeat: its pieces are dropped before any text moves.

Prefixes have variable length. Where one is too frequent for the memory of a task, its pieces are halved: the
windows of a half share more words, so its prefix is longer (8, 22, 29, 32, 34, 35 words). Pieces that are equal
as a whole are repeats, and one of them goes on for the others to meet; pieces whose longer prefix
stands alone are dropped. So every group ends as one that fits, and gets a suffix tree: sorted suffixes,
common prefixes of neighbours, inner nodes as intervals of leaves. Inner nodes of `WINDOW` words or more whose
leaves have different words before them are the maximal repeats, and the windows in those are repeated.

Steps: (1) anchors of all texts; (2) count prefixes, keep repeated ones; (3) cut the pieces around their
anchors; (4) lengthen frequent prefixes; (5) trees; (6) per document, the words that repeated windows
cover. Of texts that are equal as a whole only one goes through steps 3 to 5.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, grouped, keep, lookup, prepare, read_table, same

WINDOW, PREFIX = 35, 8
#: Pieces of a prefix that one tree takes: some 20 MB. Beyond, the prefix grows.
TREE = 2048
#: Windows of a text that are looked at together.
BLOCK = 1 << 22
_MULT = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sequence_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words, by doubling."""
    if len(h) < n:
        return h[:0]
    out, have, power = None, 0, h
    step = 1
    while True:
        if n & step:
            if out is None:
                out = power
            else:
                m = len(h) - have - step + 1
                out = mixed(out[:m] * _MULT + power[have : have + m])
            have += step
        step *= 2
        if step > n:
            return out
        m = len(power) - step // 2
        power = mixed(power[:m] * _MULT + power[step // 2 : step // 2 + m])


def anchors(words: list[bytes], window: int, prefix: int) -> list[tuple[int, int, int, int]]:
    """(prefix hash, first window, number of windows, words from there to the anchor) of each run of windows
    that share an anchor.

    Of equally low prefixes in a window the leftmost is the anchor, so equal windows never share one.
    """
    if len(words) < window:
        return []
    h, out = sequence_hashes(word_hashes(words), prefix), []
    inside = window - prefix + 1  # prefixes in a window
    for at in range(0, len(words) - window + 1, BLOCK):
        part = h[at : at + BLOCK + inside - 1]
        low = part >> np.uint64(24) << np.uint64(24) | np.arange(len(part), dtype=np.uint64)
        least, step = low, 1
        while step * 2 <= inside:
            least = np.minimum(least[: len(least) - step], least[step:])
            step *= 2
        n = len(part) - inside + 1
        least = np.minimum(least[:n], least[inside - step : inside - step + n]) & np.uint64((1 << 24) - 1)
        runs = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        ends = np.r_[runs[1:], n]
        places = least[runs].astype(np.int64)
        out += zip(part[places].view(np.int64).tolist(), (runs + at).tolist(), (ends - runs).tolist(), (places - runs).tolist())
    return out


class SuffixTree:
    """The suffixes of some texts (words joined by blanks) that have `window` words or more.

    leaves: (text, first word), in the order of the suffixes. nodes: inner nodes of `window` words or more
    as (first leaf, end leaf, depth in words), children before parents.
    """

    def __init__(self, texts: list[bytes], window: int) -> None:
        self.words = [t.split(b" ") for t in texts]
        spelled = []
        for t, text in enumerate(texts):
            ends = [0, *(i + 1 for i, c in enumerate(text) if c == 32), len(text) + 1]
            text += b" "
            spelled += ((text[ends[k] :], t, k, ends[k + window] - ends[k]) for k in range(len(ends) - window))
        spelled.sort()
        self.leaves = [(t, k) for _, t, k, _ in spelled]
        self.nodes: list[tuple[int, int, int]] = []
        open_, below = [(0, 0)], len(spelled)  # (depth, first leaf)
        for i in range(1, below + 1):
            depth = 0
            if i < below:
                (one, t, k, cut), (two, u, j, _) = spelled[i - 1], spelled[i]
                if two.startswith(one[:cut]):
                    depth, a, b = window, self.words[t], self.words[u]
                    while k + depth < len(a) and j + depth < len(b) and a[k + depth] == b[j + depth]:
                        depth += 1
            first = i - 1
            while open_[-1][0] > depth:
                d, first = open_.pop()
                self.nodes.append((first, i, d))
            if open_[-1][0] < depth:
                open_.append((depth, first))

    def maximal_repeats(self) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(words, places (text, first word)) of each sequence that occurs more than once and not always after the same word."""
        for a, b, depth in self.nodes:
            places = self.leaves[a:b]
            before = {self.words[t][k - 1] if k else None for t, k in places}
            if len(before) > 1 or None in before:
                yield depth, places


def group_repeats(rows: list[tuple], window: int) -> Iterator[tuple]:
    """rows: (doc, first window or None, number of windows, words, weight) under one prefix. Yields (doc, first, count)
    runs of windows that occur elsewhere in the group. A weight of 2 says that the words occur again as a whole; such
    a row has no place of its own and is there for others to meet."""
    texts: dict[bytes, list[int]] = {}
    for i, row in enumerate(rows):
        texts.setdefault(row[3], []).append(i)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    if len(texts) > 1:
        for depth, places in SuffixTree([*texts], window).maximal_repeats():
            for t, k in places:
                spans[t].append((k, k + depth - window + 1))
    for found, at in zip(spans, texts.values()):
        whole = sum(rows[i][4] for i in at) > 1
        for i in at:
            doc, first, n, _, _ = rows[i]
            if first is None:
                continue
            if whole:
                yield doc, first, n
            elif found:
                yield from ((doc, first + a, c) for a, c in _runs(sorted({k for a, b in found for k in range(a, min(b, n))})))


def _runs(places: list[int]) -> Iterator[tuple[int, int]]:
    start = last = places[0]
    for x in [*places[1:], -2]:
        if x != last + 1:
            yield start, last - start + 1
            start = x
        last = x


def covered(n_words: int, runs: Iterable[tuple[int, int]], window: int) -> np.ndarray:
    """Which words the windows of the runs (first, number) cover."""
    change = np.zeros(n_words + 1, np.int32)
    for first, n in runs if n_words >= window else ():
        change[first] += 1
        change[min(n_words, first + n - 1 + window)] -= 1
    return np.cumsum(change[:-1]) > 0


def _schema(**kinds) -> pa.Schema:
    return pa.schema([*kinds.items()])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([*zip(*rows)] or [()] * len(schema), schema)], schema=schema)


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, key, text: a row is known by its id and 64 bits of its text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))


def refined(pieces: DataFrame, window: int, prefix: int, tree: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Lengthens the prefixes of pieces (doc_id, key, first, o, n, words) until every group fits a tree.

    o: words from the first window to the anchor. Returns runs that repeat as a whole and the rows of trees. A piece
    stands for the windows whose o is within lo..hi; they all hold window + 1 - (hi - lo) words, the prefix. Each
    round halves lo..hi; beyond the first, only pieces go on that share their prefix with more than `tree` other texts,
    and of equal pieces one. So a round has a few rows a piece at most, and groups of one word sequence never grow.
    """
    runs, trees = [], []
    pieces = pieces.select("doc_id", "key", "first", "o", "n", "words", F.lit(1).alias("weight"), F.lit(0).alias("lo"), F.lit(window - prefix + 1).alias("hi"))
    while True:
        word = F.split("words", " ")
        pieces = keep(pieces.withColumn("h", F.unhex(F.md5(F.concat_ws(" ", "lo", "o", "n", "words")))), "pieces")
        texts = pieces.groupBy("h").agg(F.sum("weight").alias("c"), F.min(F.struct("doc_id", "key", "first")).alias("place"), *(F.first(x).alias(x) for x in ("o", "n", "lo", "hi", "words")))
        core = F.array_join(F.slice(word, F.col("o") - F.col("lo") + 1, window + 1 - F.col("hi") + F.col("lo")), " ")
        texts = keep(texts.withColumn("core", F.unhex(F.md5(F.concat_ws(" ", "lo", core)))), "texts")
        again = lookup(pieces.where("first is not null").select("doc_id", "key", "first", "n", "h"), texts.where("c > 1").select("h", "c"), "h", "c", ("doc_id", "first"))
        runs.append(again.where("c is not null").select("doc_id", "key", "first", "n"))
        cores = keep(texts.groupBy("core").agg(F.count("*").alias("d")).where("d > 1"), "cores")
        shared = keep(lookup(texts, cores, "core", "d", ("h",)).where("d is not null"), "shared")
        alone = F.col("c") == 1
        shared = shared.select(*(F.when(alone, F.col(f"place.{x}")).alias(x) for x in ("doc_id", "key", "first")), "o", "n", "lo", "hi", "words", F.least("c", F.lit(2)).cast("int").alias("weight"), "core", "d")
        trees.append(shared.where(F.col("d") <= tree).select("doc_id", "key", "first", "n", F.xxhash64("core").alias("k"), F.col("words").cast("binary").alias("words"), "weight"))
        more = shared.where(F.col("d") > tree)
        if more.isEmpty():
            return runs, trees
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("l2"), middle.alias("h2")), F.struct(middle.alias("l2"), F.col("hi").alias("h2")))).alias("half")
        more = more.select("*", halves).withColumn("o2", F.least(F.col("half.h2") - 1, "o")).withColumn("n2", F.col("o2") - F.greatest("half.l2", F.col("o") - F.col("n") + 1) + 1).where("n2 > 0")
        skipped = F.col("o") - F.col("o2")
        pieces = more.select(
            "doc_id", "key", (F.col("first") + skipped).alias("first"), F.col("o2").alias("o"), F.col("n2").alias("n"),
            F.array_join(F.slice(word, skipped + 1, F.col("n2") + window - 1), " ").alias("words"), "weight", F.col("half.l2").alias("lo"), F.col("half.h2").alias("hi"),
        )


def twins(docs: DataFrame) -> DataFrame:
    """doc_id, key, first: rows whose whole text occurs in another row; first: whether it is of the least doc_id."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("h"))
    groups = rows.groupBy("h").agg(F.count("*").alias("c"), F.min("doc_id").alias("least")).where("c > 1").withColumnRenamed("h", "h2")
    return rows.join(groups, F.col("h") == F.col("h2")).select("doc_id", "key", same(F.col("doc_id"), F.col("least")).alias("first"))


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, tree: int = TREE) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, key, runs: array<struct<first, n>> of repeated windows.

    Windows are compared word by word, in trees; pieces that are equal as a whole, and whole texts, by 128 bits.
    Rows that repeat id and text are separate documents, so all their windows repeat, and share
    one row here. Documents without repeats have no row; null texts and texts of under `window` words have
    no windows, though the run of a text that occurs twice may say so of all it has.
    """
    prepare(docs.sparkSession)
    found, twin = _identified(docs), keep(twins(docs), "twins")
    mark = _schema(k=pa.int64(), f=pa.int32(), n=pa.int32(), p=pa.int32())

    def mark_texts(texts: pa.Array) -> pa.Array:
        made = [[dict(zip("kfnp", x)) for x in anchors((t or b"").split(), window, prefix)] for t in texts.cast(pa.binary()).to_pylist()]
        return pa.array(made, pa.list_(pa.struct(mark)))

    marks = arrow(mark_texts, "array<struct<k:bigint,f:int,n:int,p:int>>")
    marks = keep(found.select("doc_id", "key", F.explode(marks(F.col("text"))).alias("a")).select("doc_id", "key", "a.*"), "anchors")
    counts = keep(marks.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "prefixes")
    wanted = lookup(marks, counts, "k", "c", ("key", "f")).where("c is not null").select("doc_id", "key", F.struct("k", "f", "n", "p", (F.col("c") > tree).alias("big")).alias("a"))
    wanted = wanted.groupBy(F.col("doc_id").alias("id2"), F.col("key").alias("key2")).agg(F.collect_set("a").alias("marks"))
    later = twin.where("not first").select(F.col("doc_id").alias("id3"), F.col("key").alias("key3")).distinct()
    wanted = wanted.join(later.hint("shuffle_hash"), (F.col("key2") == F.col("key3")) & same(F.col("id2"), F.col("id3")), "left_anti")
    with_text = found.join(wanted.hint("shuffle_hash"), (found["key"] == wanted["key2"]) & same(found["doc_id"], wanted["id2"])).select("doc_id", "key", "text", "marks")

    place = {"doc_id": pa.int64(), "key": pa.int64(), "first": pa.int32(), "n": pa.int32()}
    cut_schema = _schema(**place, k=pa.int64(), o=pa.int32(), big=pa.bool_(), words=pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, key, text, todo in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
                words = text.split()
                rows += ((doc, key, a["f"], a["n"], a["k"], a["p"], a["big"], b" ".join(words[a["f"] : a["f"] + a["n"] + window - 1])) for a in todo)
                if len(rows) > 4000:
                    yield _batch(rows, cut_schema)
                    rows = []
            yield _batch(rows, cut_schema)

    cuts = keep(with_text.mapInArrow(cut, "doc_id bigint, key bigint, first int, n int, k bigint, o int, big boolean, words binary"), "cuts")
    run_schema = _schema(**place)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for group in grouped(batches):
            out += ((*d, f, c) for d, f, c in group_repeats([((doc, key), *row) for _, doc, key, *row in group], window))
            if len(out) > 4000:
                yield _batch(out, run_schema)
                out = []
        yield _batch(out, run_schema)

    run = ("doc_id", "key", "first", "n")
    known, more = refined(cuts.where("big").withColumn("words", F.col("words").cast("string")), window, prefix, tree)
    leaves = [x.select("k", *run, "words", "weight") for x in (cuts.where("not big").withColumn("weight", F.lit(1)), *more)]
    by_tree = functools.reduce(DataFrame.unionByName, leaves).repartition("k").sortWithinPartitions("k").mapInArrow(trees, "doc_id bigint, key bigint, first int, n int")
    equal = twin.select("doc_id", "key", F.lit(0).alias("first"), F.lit(1 << 29).alias("n"))
    every = functools.reduce(DataFrame.unionByName, [by_tree, equal, *known])
    return every.groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "n")).alias("runs"))


def deduplicated(docs: DataFrame, window: int = WINDOW, text: bool = True, **how) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Every word that a repeated window covers is gone; the others are joined by one blank. One row per row
    of docs. Null texts have no words; an empty table stays empty.
    """
    runs = repeats(docs, window, **how).select(F.col("doc_id").alias("_id"), F.col("key").alias("_k"), "runs")
    rows = _identified(docs)
    rows = rows.join(runs.hint("shuffle_hash"), (rows["key"] == runs["_k"]) & same(rows["doc_id"], runs["_id"]), "left")
    names = ["n_words", "n_removed", "kept_sha256", "kept_text"][: 3 + text]

    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for data, found in zip(texts.cast(pa.binary()).to_pylist(), runs.to_pylist()):
            words = data.split()
            kept = words
            if found:
                gone = covered(len(words), [(x["first"], x["n"]) for x in found], window)
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            joined = b" ".join(kept)
            out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *((joined.decode(),) if text else ())))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip([*zip(*out)] or [()] * len(names), kinds)], names)

    done = arrow(cut, "struct<n_words:bigint,n_removed:bigint,kept_sha256:string" + ",kept_text:string" * text + ">")
    return rows.withColumn("_cut", done(F.col("text"), F.col("runs"))).select("doc_id", "_cut.*")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deduplicated() over all documents: doc_id, n_words, n_removed, kept_sha256, one row a row."""
    return deduplicated(read_table(spark, sf_dir, "documents"), text=False)
