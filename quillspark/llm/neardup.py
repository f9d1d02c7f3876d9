"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words, weighted by tf * idf. The idf is damped to 1..2: 2 for shingles in under RARE of
all documents, 1 + ln(N / df) / ln(1 / RARE) for others, so that frequent passages weigh less but copies of a large
group still look alike. It depends on shares of the corpus, never on its size. Document frequencies are exact
and over all documents: hashed counters tell which shingles may be frequent, those are then counted one by one. Weighted
samples of a document are hashed in bands; documents of a bucket are compared with its leader by their
sketches, then each with the one of another class that it resembles most, then all that are still in
different classes with each other. Every pair so found is verified by the exact weighted Jaccard similarity
of the whole texts. Classes are the connected components of verified pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH_ROWS, arrow, components, keep, prepare, read_table, same, stage_of
from .substrings import sequence_hashes, word_hashes

SHINGLE, LEAST = 5, 0.8
#: Misses a pair at 0.8 with probability (1 - 0.8 ** ROWS) ** BANDS, 4e-5.
BANDS, ROWS = 14, 3
#: Share of the documents from which a shingle counts as frequent. At most (distinct shingles of a mean document) / RARE are.
RARE = 1e-3
#: Hashed counters of a task, and counters in a row that they travel in.
COUNTERS, CHUNK = 1 << 20, 1 << 12
#: Of the sketch's places, how many must agree for a pair to be verified: four deviations below 0.8.
SKETCH_LEAST = 0.55
#: Members that meet one copy of their leader; documents of a bucket that a task compares with as many others.
MEET, BLOCK = 256, 512


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each occurs; a shorter text is one shingle."""
    return np.unique(_hashes(text), return_counts=True)


def _buckets(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(COUNTERS - 1)).astype(np.int64)


def _hashes(text: bytes) -> np.ndarray:
    """Shingles as they come, repeats included."""
    words = text.split()
    return sequence_hashes(word_hashes(words), min(SHINGLE, len(words))) if words else np.empty(0, np.uint64)


def frequent_buckets(texts: DataFrame, least: float) -> np.ndarray:
    """Which hashed counters reach `least` occurrences over all texts; the shingles of others are rarer than that."""
    made, sums = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]), pa.schema([("b", pa.int32())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            data = batch.column(0).cast(pa.binary())
            for i in range(0, len(data), 128):
                np.add.at(total, _buckets(np.concatenate([_hashes(t or b"") for t in data.slice(i, 128).to_pylist()])), 1)
        chunks = [(i, c.tobytes()) for i, c in enumerate(total.reshape(-1, CHUNK)) if c.any()]
        yield from _batches(iter(chunks), made, 64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(*(c.to_pylist() for c in batch.columns)):
                held[chunk] = held.get(chunk, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        yield from _batches(((chunk * CHUNK + b,) for chunk, n in held.items() for b in np.flatnonzero(n >= least).tolist()), sums)

    chunks = texts.mapInArrow(count, "chunk int, counts binary").repartition("chunk")
    out = np.zeros(COUNTERS, bool)
    out[chunks.mapInArrow(add, "b int").toArrow().column(0).to_numpy()] = True
    return out


def document_frequencies(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (ascending) in RARE of all n documents or more, and in how many each is."""
    maybe = texts.sparkSession.sparkContext.broadcast(np.packbits(frequent_buckets(texts, RARE * n)))
    schema = pa.schema([("s", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(maybe.value).astype(bool)
        for batch in batches:
            data = batch.column(0).cast(pa.binary())
            for i in range(0, len(data), BATCH_ROWS):
                found = [np.unique(h[may[_buckets(h)]]) for h in (_hashes(t or b"") for t in data.slice(i, BATCH_ROWS).to_pylist())]
                of, times = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(of.view(np.int64)), pa.array(times.astype(np.int64))], schema=schema)

    sums = texts.mapInArrow(count, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= RARE * n).toArrow()
    found, df = (sums.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(found.view(np.uint64))
    return found.view(np.uint64)[order], df[order]


class Idf:
    """Weights of shingles: those of frequent ones by name, 2 for all others."""

    def __init__(self, found: np.ndarray, df: np.ndarray, n: int) -> None:
        self.found, self.weight = found, np.clip(1 + np.log(n / np.maximum(df, 1)) / math.log(1 / RARE), 1.0, 2.0)

    def of(self, s: np.ndarray) -> np.ndarray:
        if not len(self.found):
            return np.full(len(s), 2.0)
        at = np.minimum(np.searchsorted(self.found, s), len(self.found) - 1)
        return np.where(self.found[at] == s, self.weight[at], 2.0)


def weigh(text: bytes, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    s, tf = shingles(text)
    return s, tf * idf.of(s)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    low = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def _gamma2(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) in the middle of n equal parts, by bisection."""
    q = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - np.exp(-x) * (1 + x) < q
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


class Sampler:
    """Consistent weighted samples with tabled random variables, the same on every machine."""

    def __init__(self, k: int = BANDS * ROWS) -> None:
        gamma = _gamma2()
        rng = np.random.default_rng(20260101)
        self.r = gamma.astype(np.float32)
        self.inverse = (1 / gamma).astype(np.float32)
        self.log_c = np.log(gamma).astype(np.float32)
        self.beta = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
        self.seeds = rng.integers(1, 1 << 32, (2, 1, k), dtype=np.uint32)
        self.odd = rng.integers(1, 1 << 32, (2, 1, k), dtype=np.uint32) | np.uint32(1)

    def samples(self, s: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For each hash function, a 64-bit value that stands for (shingle, t)."""
        k = self.seeds.shape[-1]
        best, which, levels = np.full(k, np.inf, np.float32), np.zeros(k, np.int64), np.zeros(k, np.int64)
        log_w = np.log(w).astype(np.float32)
        for i in range(0, len(s), 512):
            part = s[i : i + 512]
            a = (part.astype(np.uint32)[:, None] ^ self.seeds[0]) * self.odd[0]
            b = ((part >> np.uint64(32)).astype(np.uint32)[:, None] ^ self.seeds[1]) * self.odd[1]
            a ^= b >> np.uint32(15)
            a *= np.uint32(0x846CA68B)
            b ^= a >> np.uint32(16)
            b *= np.uint32(0x7FEB352D)
            at = (a >> np.uint32(16)).astype(np.intp)
            r = self.r[at]
            beta = self.beta[(b >> np.uint32(16)).astype(np.intp)]
            t = np.floor(log_w[i : i + 512, None] * self.inverse[at] + beta)
            log_a = self.log_c[((a ^ b) & np.uint32(0xFFFF)).astype(np.intp)] - r * (t - beta + 1)
            low = log_a.argmin(0)
            value = log_a[low, np.arange(k)]
            better = value < best
            best[better], which[better], levels[better] = value[better], low[better] + i, t[low, np.arange(k)][better].astype(np.int64)
        h = s[which] ^ (levels.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def sketch(self, s: np.ndarray, w: np.ndarray) -> tuple[list[int], bytes]:
        """Band keys and a byte of each sample."""
        x = self.samples(s, w).reshape(BANDS, ROWS)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)
        for j in range(ROWS):
            keys = (keys ^ x[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(31)
        return keys.view(np.int64).tolist(), (x >> np.uint64(40)).astype(np.uint8).tobytes()


_SAMPLER: list[Sampler] = []


def sampler() -> Sampler:
    if not _SAMPLER:
        _SAMPLER.append(Sampler())
    return _SAMPLER[0]


def _agree(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (sketches == one).mean(-1)


_PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])
_MEMBER = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("node", pa.binary()), ("block", pa.int32()), ("class", pa.binary()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])
_MEMBER_SQL = "key bigint, i int, j int, node binary, block int, class binary, sketch binary, keys array<bigint>"


class _Cell:
    """Two blocks of a bucket's members, or one with itself: which of left and right resemble each other, are in
    different classes and share no earlier bucket. Rows: node, block, class, sketch, keys."""

    def __init__(self, key: int, i: int, j: int, rows: list) -> None:
        self.place, self.rows, at = (key, i, j), rows, np.arange(len(rows))
        block = np.array([r[1] for r in rows])
        sketches = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        classes = np.unique(np.array([r[2] for r in rows], object), return_inverse=True)[1]
        band = rows[0][4].index(key)
        earlier = np.array([r[4][:band] for r in rows], np.int64).reshape(len(rows), band)
        self.left, self.right = at[block == i], at[block == j]
        self.like = np.zeros((len(self.left), len(self.right)), np.float32)
        for x, one in enumerate(self.left.tolist()):
            other = (classes[self.right] != classes[one]) & ~(earlier[self.right] == earlier[one]).any(1)
            if i == j:
                other &= self.right > one
            to = np.flatnonzero(other)
            self.like[x, to] = _agree(sketches[self.right[to]], sketches[one])
        self.near = self.like >= SKETCH_LEAST

    def members(self) -> list:
        """The rows of which a pair has to be verified."""
        return [self.rows[x] for x in sorted({*self.left[self.near.any(1)].tolist(), *self.right[self.near.any(0)].tolist()})]

    def most_alike(self) -> Iterator[tuple[bytes, bytes]]:
        """Pairs of each member with the one it resembles most."""
        if self.near.any():
            first = np.zeros_like(self.near)
            first[np.arange(len(self.left)), self.like.argmax(1)] = True
            first[self.like.argmax(0), np.arange(len(self.right))] = True
            for x, y in zip(*(z.tolist() for z in np.nonzero(self.near & first))):
                yield self.rows[self.left[x]][0], self.rows[self.right[y]][0]

    def links(self, weighed: list, least: float) -> Iterator[tuple[bytes, bytes]]:
        """Pairs at `least` or more that make the classes of the cell; those that others have joined are left out."""
        root = list(range(len(self.rows)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x, y in zip(*(z.tolist() for z in np.nonzero(self.near))):
            x, y = int(self.left[x]), int(self.right[y])
            if find(x) != find(y) and weighted_jaccard(weighed[x], weighed[y]) >= least - 1e-9:
                root[find(x)] = find(y)
                yield self.rows[x][0], self.rows[y][0]


def _cells(batches: Iterator[pa.RecordBatch], extra=lambda batch: ()) -> Iterator[tuple[_Cell, list]]:
    """Cells of rows sorted by key, i, j, each with what extra() makes of its rows."""
    at, held, more = None, [], []
    for batch in batches:
        made = extra(batch) or [None] * batch.num_rows
        for (key, i, j, *row), x in zip(zip(*(batch.column(c).to_pylist() for c in range(8))), made):
            if (key, i, j) != at:
                if len(held) > 1:
                    yield _Cell(*at, held), more
                at, held, more = (key, i, j), [], []
            held.append(row)
            more.append(x)
    if len(held) > 1:
        yield _Cell(*at, held), more


def _batches(rows: Iterator, schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part), schema)], schema=schema)


def shared_buckets(texts: DataFrame) -> DataFrame:
    """texts: node, keys, sketch; one row per distinct text. Rows of the buckets of several texts, with their leader."""
    buckets = texts.select("node", "sketch", "keys", F.explode("keys").alias("key"))
    order = F.hash("node", F.col("key") % 2)  # two leaders for the buckets of a group, not one each
    leaders = buckets.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "sketch")).alias("l"), F.count("*").alias("c")).where("c > 1")
    leaders = leaders.select(F.col("key").alias("k"), F.col("l.node").alias("leader"), F.col("l.sketch").alias("leads"))
    return buckets.join(leaders, F.col("key") == F.col("k")).select("key", "node", "sketch", "keys", "leader", "leads")


def leader_pairs(shared: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a bucket's leader and a member that resembles it."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, leads = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for i in (1, 3))
            like = pa.array(_agree(mine, leads) >= SKETCH_LEAST)
            yield pa.RecordBatch.from_arrays([batch.column(2).filter(like), batch.column(0).filter(like)], schema=_PAIR)

    met = shared.where("node <> leader").select("node", "sketch", "leader", "leads")
    return met.mapInArrow(compare, "a binary, b binary").distinct()


def cells(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that hold several classes of roots, by cell (key, i, j), sorted.

    Of a bucket the members of its largest class meet the others, those meet each other too, in cells of
    two blocks of about BLOCK members, so that no task has more.
    """
    known = roots.withColumnRenamed("node", "n2")
    rows = shared.select("key", "node", "sketch", "keys").join(known, F.col("node") == F.col("n2"), "left").select("key", "node", "sketch", "keys", F.coalesce("root", "node").alias("class"))
    sizes = rows.groupBy("key", "class").agg(F.count("*").alias("c"))
    split = sizes.groupBy("key").agg(F.max(F.struct("c", "class")).alias("l"), F.sum("c").alias("n"), F.count("*").alias("classes")).where("classes > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    split = split.select(F.col("key").alias("k"), F.col("l.class").alias("largest"), blocks(F.col("n") - F.col("l.c")).alias("others"), blocks(F.col("l.c")).alias("mine"))
    rows = rows.join(split, F.col("key") == F.col("k"))
    largest = F.col("class") == F.col("largest")
    block = F.when(largest, F.col("others") + F.pmod(F.hash("node"), F.col("mine"))).otherwise(F.pmod(F.hash("node"), F.col("others")))
    last = F.when(largest, F.col("others")).otherwise(F.col("others") + F.col("mine")) - 1
    rows = rows.select("key", "node", "sketch", "keys", "class", block.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("with"))
    rows = rows.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "block", "class", "sketch", "keys")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")


def most_alike_pairs(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct pairs (a, b): members of a bucket with the one of another class that they resemble most in a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((pair for cell, _ in _cells(batches) for pair in cell.most_alike()), _PAIR)

    return cells(shared, roots).mapInArrow(run, "a binary, b binary").distinct()


def remaining_links(shared: DataFrame, roots: DataFrame, texts: DataFrame, docs: DataFrame, idf, least: float) -> DataFrame:
    """Links (u, v) of similarity `least` or more that join whatever classes of roots share a bucket and belong together.

    All pairs of members of different classes that resemble each other are verified, each in the first bucket they
    share, unless others of the cell have joined them. A text goes to a cell once, not once a pair.
    """

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for cell, _ in _cells(batches):
                yield from ((*cell.place, *row) for row in cell.members())

        yield from _batches(rows(), _MEMBER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighed = lambda batch: [weigh(t, idf.value) for t in batch.column(8).cast(pa.binary()).to_pylist()]
        yield from _batches((pair for cell, w in _cells(batches, weighed) for pair in cell.links(w, least)), _PAIR)

    members = keep(cells(shared, roots).mapInArrow(needed, _MEMBER_SQL), "members")
    rows = with_text(members, texts, docs).select(*_MEMBER.names, "text")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(run, "u binary, v binary")


def with_text(needed: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """needed, whose rows name a node, with the text of it."""
    needed = needed.join(texts.select(F.col("node").alias("n2"), "rep"), F.col("node") == F.col("n2")).drop("n2")
    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("h"), "text")
    return rows.join(needed, (rows["h"] == needed["node"]) & same(rows["doc_id"], needed["rep"]))


def verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, idf, least: float) -> DataFrame:
    """Pairs (a, b, similarity) whose weighted Jaccard similarity is at least `least`.

    Members meet their leader `a` in groups of about MEET; a leader of many has a copy in each group.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEET).cast("int").alias("groups"))
    members = pairs.join(many.withColumnRenamed("a", "a2"), F.col("a") == F.col("a2")).select(F.col("b").alias("node"), "a", F.lit(1).alias("role"), F.pmod(F.hash("b"), F.col("groups")).alias("g"))
    leaders = many.select(F.col("a").alias("node"), "a", F.lit(0).alias("role"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"))
    rows = with_text(members.unionByName(leaders), texts, docs).select("a", "g", "role", "node", "text")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leader = None, None
        for batch in batches:
            out = []
            for a, g, role, node, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4).cast(pa.binary()).to_pylist()):
                if (a, g) != at:
                    at, leader = (a, g), None
                if role == 0:
                    leader = leader or weigh(text, idf.value)
                elif (x := weighted_jaccard(leader, weigh(text, idf.value))) >= least - 1e-9:
                    out.append((a, node, x))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([*zip(*out)] or [()] * 3, schema)], schema=schema)

    return rows.repartition("a", "g").sortWithinPartitions("a", "g", "role").mapInArrow(run, "a binary, b binary, similarity double")


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, h (128 bits of the text), class_id, kept_h: a row per row of docs.

    class_id is the least doc_id of the class (null if all are null); (class_id, kept_h) names the row that
    stands for it. Null and empty texts are copies of each other, and like no other text.
    Texts of under five words are one shingle. Ties and repeated rows fall in one class as copies do.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    idf = spark.sparkContext.broadcast(Idf(*document_frequencies(docs.select("text"), n), n))  # under 16 bytes / RARE a shingle of a mean document

    def sketch(texts: pa.Array) -> pa.Array:
        keys, bytes_ = [], []
        for text in texts.cast(pa.binary()).to_pylist():
            s, w = weigh(text, idf.value)
            k, b = sampler().sketch(s, w) if len(s) else (None, None)
            keys.append(k)
            bytes_.append(b)
        return pa.StructArray.from_arrays([pa.array(keys, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())], ["keys", "sketch"])

    made = arrow(sketch, "struct<keys:array<bigint>,sketch:binary>")
    rows = keep(docs.select("doc_id", F.unhex(F.md5("text")).alias("h"), made(F.col("text")).alias("s")).select("doc_id", "h", "s.*"), "sketches")
    texts = keep(rows.groupBy("h").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")).withColumnRenamed("h", "node"), "texts")
    shared = keep(shared_buckets(texts.where("keys is not null")), "shared")
    links = lambda pairs: verified(keep(pairs, "pairs"), texts, docs, idf, least).select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(links(leader_pairs(shared)))
    known = lambda: roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    roots = components(known().unionByName(links(most_alike_pairs(shared, roots))))
    roots = components(known().unionByName(remaining_links(shared, roots, texts, docs, idf, least)))
    rooted = texts.select("node", "rep").join(roots.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("z"), "rep", "node")).alias("m")).select(F.col("root").alias("r2"), F.col("m.rep").alias("class_id"), F.col("m.node").alias("kept_h"))
    named = rooted.join(first, F.col("root") == F.col("r2")).select(F.col("node").alias("n2"), "class_id", "kept_h")
    return rows.select("doc_id", "h").join(named, F.col("h") == F.col("n2")).select("doc_id", "h", "class_id", "kept_h")


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classes() of all documents: doc_id and the least doc_id of its class, one row a row."""
    return classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@stage_of("doc_id", "text")
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: the one with its least doc_id."""
    kept = classes(docs).where("h = kept_h and doc_id <=> class_id").groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.count("*").alias("_n"))
    rows = docs.withColumn("_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    rows = rows.join(kept, (rows["_key"] == kept["_h"]) & same(rows["doc_id"], kept["_id"]))
    repeated = rows.where("_n > 1").withColumn("_r", F.row_number().over(Window.partitionBy("_h", "_id").orderBy("_n"))).where("_r = 1").drop("_r")
    return rows.where("_n = 1").unionByName(repeated).select(*docs.columns)
