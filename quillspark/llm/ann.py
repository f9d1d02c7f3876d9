"""Approximate nearest neighbours by a hierarchical k-means tree.

Largest inner products become least distances by one more component, sqrt(m * m - |x| * |x|) for rows and
0 for queries, m being the longest row. A tree of k-means splits is fitted on a bounded sample; every row goes
to a leaf. A query walks the tree best bin first: a priority queue holds branches by the distance to their
centres, and the nearest is opened next. How many leaves are visited is calibrated: it widens until sampled
queries, compared with all rows, find as much as is asked for. Scores are exact, on the given vectors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, read_table

#: Rows the tree is fitted on; branches of a node; rows of a leaf aimed at, and leaves, at most.
SAMPLE, BRANCHES, LEAF, LEAVES = 20_000, 8, 64, 4096
#: Queries that calibrate the visits; the recall they must reach.
PROBES, RECALL = 128, 0.95
#: Rows that one task holds while the queries that visit their leaves stream by.
GROUP = 16_384
K = 20


class Tree:
    """centres[i]: the centres of node i's branches; below[i]: their nodes, or -1 - leaf."""

    def __init__(self, x: np.ndarray, leaves: int, seed: int = 5) -> None:
        self.centres: list[np.ndarray] = []
        self.below: list[list[int]] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.most = max(1, math.ceil(len(x) / max(leaves, 1)))
        self._grow(x, rng)

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> int:
        node = len(self.centres)
        self.centres.append(np.empty(0))
        self.below.append([])
        centres, nearest = _k_means(x, min(BRANCHES, max(1, math.ceil(len(x) / self.most))), rng)
        self.centres[node] = centres
        for j in range(len(centres)):
            part = x[nearest == j]
            if len(part) > self.most and len(centres) > 1 and len(part) < len(x):
                self.below[node].append(self._grow(part, rng))
            else:
                self.below[node].append(-1 - self.leaves)
                self.leaves += 1
        return node

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest centre at every level."""
        out = np.empty(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            nearest = _distances(x[at], self.centres[node]).argmin(1)
            for j, below in enumerate(self.below[node]):
                part = at[nearest == j]
                if below < 0:
                    out[part] = -1 - below
                elif len(part):
                    todo.append((below, part))
        return out

    def visit(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, rows: int = 0) -> list[int]:
        """The first leaves of a query, best bin first: `most`, and more until they hold `rows` rows."""
        queue, found, held = [(0.0, 0)], [], 0
        while queue and (len(found) < most or held < rows):
            _, node = heapq.heappop(queue)
            if node < 0:
                found.append(-1 - node)
                held += rows if sizes is None else int(sizes[-1 - node])
                continue
            for d, below in zip(_distances(q[None], self.centres[node])[0].tolist(), self.below[node]):
                heapq.heappush(queue, (d, below))
        return found


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres * centres).sum(1) - 2 * (x @ centres.T)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = np.unique(x[rng.choice(len(x), k, replace=False)], axis=0)
    for _ in range(rounds):
        nearest = _distances(x, centres).argmin(1)
        centres = np.array([x[nearest == j].mean(0) for j in range(len(centres)) if (nearest == j).any()])
    return centres, _distances(x, centres).argmin(1)


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed alike wherever a row stands, so equal rows tie."""
    return (x * q).sum(1)


def best(parts: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, own: int, k: int) -> list[tuple[int, float]]:
    """(place among all, inner product) of the k rows of parts (ids, rows) with the largest inner products, ties to the
    smaller id, without those of the query's own id."""
    ids = np.concatenate([p[0] for p in parts])
    rough = np.concatenate([p[1] @ q for p in parts])
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        edge = np.partition(rough[at], len(at) - k)[len(at) - k]
        at = at[rough[at] >= edge - 1e-9 * max(1.0, abs(edge))]
    ends = np.cumsum([len(p[0]) for p in parts])
    part = np.searchsorted(ends, at, side="right")
    x = np.array([parts[i][1][j - ends[i] + len(parts[i][0])] for i, j in zip(part.tolist(), at.tolist())]).reshape(len(at), len(q))
    exact = scores(x, q)
    order = np.lexsort((ids[at], -exact))[:k]
    return list(zip(at[order].tolist(), exact[order].tolist()))


def usable(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) as doubles; without null or zero ones and those with null, infinite or NaN parts."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select("vec_id", x.alias("x")).where("vec_id is not null and x is not null")
    return rows.where(finite & F.exists("x", lambda v: v != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(float) if len(column) else np.empty((0, 0))


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))]


def exact_search(rows: DataFrame, queries: list[tuple[int, int]], x: np.ndarray, k: int) -> dict[int, list[tuple[int, float, int]]]:
    """A stated set of queries (row, vec_id) with vectors x against all rows(vec_id, x, leaf) in blocks; each block sends
    k rows a query at most. By the query's row: (vec_id, score, leaf) of the nearest."""
    found = rows.sparkSession.sparkContext.broadcast((queries, x))
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("leaf", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, leaf, x = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(1))
            out = [(row, int(own[i]), score, int(leaf[i])) for (row, q), v in zip(*found.value) for i, score in best([(own, x)], v, q, k)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*zip(*out)] or [()] * 4, schema)], schema=schema)

    merged = rows.select("vec_id", "x", "leaf").mapInArrow(run, "row bigint, vec_id bigint, score double, leaf int")
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "leaf"))), 1, k)
    return {r.row: [(x.vec_id, -x.s, x.leaf) for x in r.t] for r in merged.groupBy("row").agg(top.alias("t")).collect()}


def search(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """vectors: vec_id, embedding. Queries are the rows whose id is divisible by `every`, candidates all
    other rows. Returns query_id, rank, vec_id, score: k rows a query, all candidates if there are fewer.

    Vectors that usable() leaves out take no part; all others have one length. Ties go to the smaller
    vec_id. Rows of a query's own id are no candidates. Rows that repeat an id are a vector each, with a place of its
    own in the results of others, and a query each: its k rows come once for each of them. Other columns aren't read.
    An empty table gives none. A query opens leaves, best first, until it has opened as many as calibrated and
    these hold k rows besides its own id's. The tree is fitted on SAMPLE rows at most, but holds all.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = keep(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")  # written, so rows keep their numbers
    n, longest = rows.agg(F.count("*"), F.sqrt(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)))).first()
    if not n:
        return empty
    repeated = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    sample = rows.select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    x = _matrix(sample.column(1).combine_chunks())
    tree = Tree(_lifted(x, longest), min(LEAVES, math.ceil(n / LEAF)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = index.value.place(_lifted(_matrix(batch.column(1)), longest)) if batch.num_rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["vec_id", "x", "row", "leaf"])

    index = spark.sparkContext.broadcast(tree)
    rows = keep(rows.mapInArrow(placed, "vec_id bigint, x array<double>, row bigint, leaf int"), "placed")
    queries = rows.where(F.col("vec_id") % every == 0)
    # calibration: the leaves of the true neighbours of some queries, in the order of their visits
    probes = queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id", "row").limit(PROBES).toArrow()
    visits = 1
    if probes.num_rows:
        q = _matrix(probes.column(1).combine_chunks())
        asked = list(zip(probes.column(2).to_pylist(), probes.column(0).to_pylist()))
        true = exact_search(rows, asked, q, k)
        need: list[int] = []
        for (row, _), v in zip(asked, q):
            order = {x: j + 1 for j, x in enumerate(tree.visit(np.r_[v, 0.0], tree.leaves))}
            need += (order[leaf] for _, _, leaf in true.get(row, []))
        need.sort()
        visits = need[min(len(need) - 1, math.ceil(RECALL * len(need)) - 1)] if need else 1

    # neighbouring leaves share a group; a leaf with very many rows, equal ones perhaps, has several
    sizes = {r.leaf: r.n for r in rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # LEAVES of them
    groups, last, room = {}, -1, 0
    for leaf in range(tree.leaves):
        size = sizes.get(leaf, 0)
        if size > GROUP:
            groups[leaf] = (last + 1, math.ceil(size / GROUP))
            last, room = last + groups[leaf][1], 0
            continue
        if size > room:
            last, room = last + 1, GROUP
        groups[leaf], room = (max(last, 0), 1), room - size
    dealt = spark.sparkContext.broadcast((groups, np.array([sizes.get(leaf, 0) for leaf in range(tree.leaves)])))
    enough = k + repeated

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, group, leaves = [], [], []
            groups, sizes = dealt.value
            for j, v in enumerate(_matrix(batch.column(1))):
                asked: dict[int, list[int]] = {}
                for leaf in index.value.visit(np.r_[v, 0.0], visits, sizes, enough):
                    first, chunks = groups[leaf]
                    for g in range(first, first + chunks):
                        asked.setdefault(g, []).append(leaf)
                at += [j] * len(asked)
                group += asked
                leaves += asked.values()
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(leaves, pa.list_(pa.int32()))], names=["g", "vec_id", "x", "row", "leaves"])

    place = F.broadcast(spark.createDataFrame([(leaf, *p) for leaf, p in groups.items()], "leaf int, f int, c int"))  # LEAVES rows
    members = rows.join(place, "leaf").select((F.col("f") + F.pmod(F.xxhash64("vec_id"), F.col("c")).cast("int")).alias("g"), F.lit(1).alias("role"), "leaf", "vec_id", "x", "row", F.lit(None).cast("array<int>").alias("leaves"))
    asked = queries.select("vec_id", "x", "row").mapInArrow(visiting, "g int, vec_id bigint, x array<double>, row bigint, leaves array<int>").select("g", F.lit(2).alias("role"), F.lit(-1).alias("leaf"), "vec_id", "x", "row", "leaves")
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("found", pa.list_(pa.struct([("s", pa.float64()), ("vec_id", pa.int64())])))])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, data = None, [], {}
        for batch in batches:
            g, role, leaf, vec = (batch.column(i).to_numpy() for i in range(4))
            x, row, wanted, out = _matrix(batch.column(4)), batch.column(5).to_numpy(), batch.column(6), []
            cuts = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(role) != 0) | (np.diff(leaf) != 0)) + 1).tolist(), len(g)]
            for a, b in zip(cuts, cuts[1:]) if len(g) else ():
                if g[a] != at:
                    at, held, data = g[a], [], {}
                if role[a] == 1:
                    held.append((int(leaf[a]), vec[a:b], x[a:b]))
                    continue
                if held:
                    for i in {h[0] for h in held}:
                        data[i] = np.concatenate([h[1] for h in held if h[0] == i]), np.concatenate([h[2] for h in held if h[0] == i])
                    held = []
                for j in range(a, b):
                    parts = [data[i] for i in wanted[j].as_py() if i in data]
                    if parts:
                        ids = np.concatenate([p[0] for p in parts])
                        out.append((int(row[j]), int(vec[j]), [{"s": -s, "vec_id": int(ids[i])} for i, s in best(parts, x[j], int(vec[j]), k)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*zip(*out)] or [()] * 3, schema)], schema=schema)

    met = members.unionByName(asked).repartition("g").sortWithinPartitions("g", "role", "leaf").mapInArrow(answer, "row bigint, query_id bigint, found array<struct<s:double,vec_id:bigint>>")
    top = met.groupBy("row", "query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("t")).select("query_id", F.posexplode("t").alias("i", "r"))
    return top.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), (-F.col("r.s")).alias("score"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search() over all embeddings: query_id, rank, vec_id, score."""
    return search(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
