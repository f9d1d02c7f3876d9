"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same fractional number of copies, target / source size. Its
whole part is sure; the rest is a probability. Two documents with fractional probabilities exchange
words: a random direction, chosen so that both keep their expectation, moves as much as fits, after
which one of them is integral. Buckets of a source do this each for itself, their one survivor goes up
a reduction tree, and the root rounds the last survivor to the nearer whole copy. A source's few very
long documents come first, by falling size; what rounding their survivors adds or takes is handed to all
smaller documents of the source through their common probability. So the words taken from a source
differ from its target by half of a short document at most, wherever it has short ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import grouped, keep, lookup, prepare, read_table, same, stage_of, text_key

#: Documents of a source that one task pairs, and survivors that meet in a node of the tree.
BUCKET, FAN_IN = 4096, 64
#: Ranges of code points by which the sources are sorted.
RANGES = 16
#: Documents with over 1 / HEAVY of their source's words are rounded before the others: under HEAVY a source.
HEAVY = 512
WEIGHTS, SHARE, MOST = (5, 2, 1), Fraction(3, 2), 2


def size_of(text):
    """Number of words, runs of other than the six ASCII blanks; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """A text that is never null and differs for each source."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def ranked(sources: DataFrame) -> DataFrame:
    """sources(source, ...) with `place`, from 0, by code point, null last: sorted by ranges, counted by range."""
    sources = sources.repartitionByRange(RANGES, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    sources = keep(sources.sortWithinPartitions(F.col("source").asc_nulls_last()), "sources")
    rows, total = [], 0
    for range_, n in sorted((r.range, r["count"]) for r in sources.groupBy("range").count().collect()):  # a row a range
        rows.append((range_, total))
        total += n
    before = F.broadcast(sources.sparkSession.createDataFrame(rows, "r int, before bigint"))  # as many
    within = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return sources.join(before, F.col("range") == F.col("r")).withColumn("place", F.col("before") + within - 1).drop("range", "r", "before")


def with_targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """sources(source, words, ...) with `weight` and `target`, the words to take: share of all by weight, at most
    `most` times the source's.

    Sources go by code point, null last; the weights repeat along them. What a full source can't take is
    shared again by weight among the others, until none is above. Sums by weight are all that the driver
    reads in a round; it keeps exact fractions, so a source is full if its words are up to a whole number.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = keep(ranked(sources).withColumn("weight", weight), "weights")
    limits: dict[int, int] = {w: -1 for w in weights}  # a source of weight w is full if it has up to limits[w] words
    full = lambda: F.col("words") <= F.coalesce(*(F.when(F.col("weight") == w, F.lit(x)) for w, x in limits.items()))
    total = sources.agg(F.sum("words")).first()[0] or 0
    while True:
        sums = sources.groupBy("weight").agg(F.sum(F.when(full(), F.col("words")).otherwise(0)).alias("full"), F.sum(F.when(full(), 0).otherwise(1)).alias("open")).collect()
        open_ = sum(r.weight * r.open for r in sums)
        unit = (share * total - most * sum(r.full for r in sums)) / open_ if open_ else Fraction(0)
        now = {w: max(limits[w], math.ceil(unit * w / most) - 1) for w in limits}
        if now == limits or not open_:
            break
        limits = now
    units = F.coalesce(*(F.when(F.col("weight") == w, F.lit(float(unit * w))) for w in limits))
    return sources.withColumn("target", F.when(full(), (F.col("words") * most).cast("double")).otherwise(units)).drop("place")


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> int:
    """Rounds the probabilities in place, keeping their sum weighted by size; returns the survivor or -1.

    Documents without words carry no mass: they are rounded on their own.
    """
    draws, a = rng.random(len(p)), -1
    for b in range(len(p)):
        if not 0 < p[b] < 1:
            continue
        if not size[b]:
            p[b] = float(draws[b] < p[b])
            continue
        if a < 0:
            a = b
            continue
        up = min((1 - p[a]) * size[a], p[b] * size[b])  # words that can move from b to a
        down = min(p[a] * size[a], (1 - p[b]) * size[b])
        moved = up if draws[b] * (up + down) < down else -down
        p[a] += moved / size[a]
        p[b] -= moved / size[b]
        for i in (a, b):
            if p[i] < 1e-9 or p[i] > 1 - 1e-9:
                p[i] = round(p[i])
        if p[a] in (0, 1):
            a = b if 0 < p[b] < 1 else -1
    return a


#: Columns of a unit that is to be rounded; doc_id is text here, as a null or long one must come back as it was.
_UNIT = "sk string, bucket int, id string, source string, text_key string, size bigint, source_size bigint, target double, copies int, p double"
_UNITS = pa.schema([(c, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[t]) for c, t in (x.split() for x in _UNIT.split(", "))])


def _tie(row: tuple) -> int:
    """A hash by which documents of one size are ordered."""
    return xxhash.xxh3_64_intdigest(b"\0".join(x or b"\1" for x in (row[2], row[4])))


def _batch(rows: list[tuple], copies: Iterator[int], p: Iterator[float]) -> pa.RecordBatch:
    columns = [[x.decode() if isinstance(x, bytes) else x for x in c] for c in zip(*rows)]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([*columns[:8], [*copies], [*p]], _UNITS)], schema=_UNITS)


def _rounding(level: int, last: bool):
    """Rounds nodes of the tree, rows by sk and bucket; a node's survivor keeps a probability, at the root none does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 2):
            group.sort(key=lambda r: (-r[5], _tie(r)))
            p, size = np.array([r[9] for r in group]), np.array([r[5] for r in group], float)
            survivor = pivot(p, size, np.random.default_rng([level, group[0][1], *group[0][0]]))
            if survivor >= 0 and last:
                p[survivor] = round(p[survivor])
            whole = (p == 0) | (p == 1)
            yield _batch(group, (r[8] + int(x) for r, x in zip(group, np.where(whole, p, 0))), np.where(whole, 0.0, p))

    return run


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rounds the long documents of each source, by powers of two of their size, longest first."""
    for group in grouped(batches, 1):
        group.sort(key=lambda r: (-math.frexp(r[5])[1], _tie(r)))
        octaves = np.array([math.frexp(r[5])[1] for r in group])
        rng = np.random.default_rng([99, *group[0][0]])
        words, goal = group[0][6], group[0][7]
        size, copies = np.array([r[5] for r in group], float), np.zeros(len(group), "int32")
        for octave in sorted({*octaves.tolist()}, reverse=True):
            at = np.flatnonzero(octaves == octave)
            f = min(max(goal / words, 0.0), float(MOST))
            p = np.full(len(at), f - math.floor(f))
            survivor, left = pivot(p, size[at], rng), words - size[at].sum()
            if survivor >= 0:
                p[survivor] = float(rng.random() < p[survivor]) if left else round(p[survivor])
            copies[at] = math.floor(f) + p.astype("int32")
            goal, words = goal - float((copies[at] * size[at]).sum()), int(left)
        yield _batch(group, copies.tolist(), [0.0] * len(group))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """docs: doc_id, text, source. Returns doc_id, source, text_key, size, source_size, target, copies.

    One row per row of docs; repeated rows are separate documents, ties among them fall alike in every
    run. Null texts have size 0, null ids are documents too, null sources form one source, the last. Sources are a
    table like any other: there may be as many as documents. An empty table stays empty; other columns aren't read.
    """
    prepare(docs.sparkSession)
    rows = keep(docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").cast("string").alias("source"), text_key(F.col("text")).alias("text_key"), size_of(F.col("text")).alias("size"), source_key(F.col("source")).alias("sk")), "sizes")
    sources = rows.groupBy("sk").agg(F.first("source").alias("source"), F.sum("size").alias("words"), F.count("*").alias("n"))
    sources = keep(with_targets(sources, weights, share, most).select("sk", "words", "n", "target"), "targets")
    long = F.col("size") * HEAVY > F.col("source_size")
    known = lookup(rows, sources.select("sk", F.col("words").alias("source_size"), "n", "target"), "sk", "n", ("id", "text_key")).drop("n")
    unit = lambda df, **made: df.select(*(made.get(c, F.col(c)) for c in _UNITS.names))
    zero = {"bucket": F.lit(0).alias("bucket"), "copies": F.lit(0).alias("copies"), "p": F.lit(0.0).alias("p")}
    heavy = unit(known.where(long), **zero).repartition("sk").sortWithinPartitions("sk").mapInArrow(_heavy, _UNIT)
    heavy = keep(heavy, "heavy")
    spent = heavy.groupBy("sk").agg(F.sum("size").alias("long"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.count("*").alias("n_long"))
    # what is left of a source's target, as the copies that all its other documents start with
    left = sources.join(spent.withColumnRenamed("sk", "sk2"), F.col("sk") == F.col("sk2"), "left").na.fill(0, ["long", "taken", "n_long"])
    f = F.when(F.col("words") > F.col("long"), (F.col("target") - F.col("taken")) / (F.col("words") - F.col("long"))).otherwise(0.0)
    left = left.select("sk", F.col("words").alias("source_size"), "target", F.greatest(F.lit(0.0), F.least(f, F.lit(float(most)))).alias("f"), (F.col("n") - F.col("n_long")).alias("n"))
    left = keep(left.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).cast("int")), "left")
    units = lookup(rows, left, "sk", "n", ("id", "text_key")).where(~long)
    bucket = F.pmod(F.xxhash64(F.lit(17), "id", "text_key"), F.col("buckets")).cast("int").alias("bucket")
    units = unit(units, bucket=bucket, copies=F.floor("f").cast("int").alias("copies"), p=(F.col("f") - F.floor("f")).alias("p"))
    level, most_buckets, done = 0, left.agg(F.max("buckets")).first()[0] or 0, heavy
    while True:
        last = most_buckets <= 1
        out = keep(units.repartition("sk", "bucket").sortWithinPartitions("sk", "bucket").mapInArrow(_rounding(level, last), _UNIT), f"mix{level}")
        done = done.unionByName(out if last else out.where("p = 0"))
        if last:
            return done.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("source").cast(docs.schema["source"].dataType).alias("source"), "text_key", "size", "source_size", "target", "copies")
        units = unit(out.where("p > 0"), bucket=F.floor(F.col("bucket") / FAN_IN).cast("int").alias("bucket"))
        level, most_buckets = level + 1, math.ceil(most_buckets / FAN_IN)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() over all documents: the words that the mix takes of each row, repeats counted."""
    mixed = mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@stage_of("doc_id", "text", "source")
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, each row as often as the mix takes it. Equal rows share their copies evenly."""
    taken = mix(docs).groupBy("doc_id", "source", "text_key").agg(F.sum("copies").alias("_c"), F.count("*").alias("_n"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_s"), F.col("text_key").alias("_k"), "_c", "_n")
    found = docs.withColumn("_key", text_key(F.col("text")))
    found = found.join(taken, (found["_key"] == taken["_k"]) & same(found["doc_id"], taken["_id"]) & same(found["source"], taken["_s"]))
    even = found.where("_c % _n = 0").withColumn("_copies", F.expr("cast(_c div _n as int)"))
    place = F.row_number().over(Window.partitionBy("_k", "_id", "_s").orderBy("_n"))  # of equal rows: few
    uneven = found.where("_c % _n <> 0").withColumn("_copies", (F.expr("_c div _n") + (place <= F.expr("_c % _n")).cast("int")).cast("int"))
    both = even.unionByName(uneven).where("_copies > 0")
    return both.withColumn("_one", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select(*docs.columns)
