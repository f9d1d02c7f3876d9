"""What the training-data operators share: sessions, shared tables, identity of rows, components."""

from __future__ import annotations

import atexit
import functools
import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Documents of 100 kB each then need 25 MB, not 1 GB.
BATCH_ROWS = 256
#: Keys that hold more than 1 / HOT of the rows are joined by broadcast; there are fewer than HOT.
HOT = 20_000


def prepare(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds; long documents would fill a Python worker else."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def arrow(function, schema: str):
    """An Arrow UDF that a plan evaluates once, though filters and projections use its result."""
    return F.arrow_udf(function, schema).asNondeterministic()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if
    all run on this machine, else an error: executors don't see each other's disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended already
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/quillspark-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it back: lineage ends there."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; a null text counts as an empty one."""
    return F.md5(F.coalesce(text, F.lit("")))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def grouped(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[list[tuple]]:
    """Rows of sorted batches by their first `keys` columns, a group at a time; strings come as bytes."""
    plain = lambda c: (c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist()
    rows = (row for batch in batches for row in zip(*map(plain, batch.columns)))
    for _, group in itertools.groupby(rows, lambda row: row[:keys]):
        yield [*group]


def lookup(rows: DataFrame, table: DataFrame, key: str, n: str, spread: tuple[str, ...]) -> DataFrame:
    """rows with the other columns of table, null where it lacks their key.

    table has one row a key, kept in a file; n is how many of the rows have that key. The fewer than HOT keys
    with over 1 / HOT of all are broadcast, and their rows dealt by a hash of `spread` instead, so no task of the
    join gets a hot key. Keys are never null.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    value = F.struct(*(c for c in table.columns if c != key))
    often = F.col(n) * HOT > total
    hot = F.broadcast(table.where(often).select(F.col(key).alias("_hk"), value.alias("_hot")))
    cold = table.where(~often).select(F.col(key).alias("_ck"), value.alias("_cold"))
    elsewhere = F.concat(F.lit("\0"), F.xxhash64(*spread).cast("string")).cast(rows.schema[key].dataType) if rows.schema[key].dataType.typeName() != "long" else F.xxhash64(*spread)
    rows = rows.join(hot, F.col(key) == F.col("_hk"), "left").withColumn("_k", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(elsewhere))
    rows = rows.join(cold.hint("shuffle_hash"), F.col("_k") == F.col("_ck"), "left").withColumn("_v", F.coalesce("_hot", "_cold"))
    return rows.drop("_hk", "_hot", "_k", "_ck", "_cold").select("*", "_v.*").drop("_v")


def stage_of(*used: str):
    """Makes a stage of a function (spark, docs, sf_dir) that needs only the columns `used`.

    All other columns, whatever they are called, travel in one struct and come back as they were and in
    their order; columns that the stage adds stand at the end, in place of any of the same name.
    """

    def wrap(function):
        @functools.wraps(function)
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            names = docs.columns
            quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in names}
            rest = [quoted[c].alias(f"c{i}") for i, c in enumerate(names) if c not in used]
            out = function(spark, docs.select(*used, F.struct(F.lit(0).alias("z"), *rest).alias("_rest")), sf_dir)
            new = [c for c in out.columns if c not in (*used, "_rest")]
            back = [F.col(c) if c in used else F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(names) if c not in new]
            return out.select(*back, *new)

        return stage

    return wrap


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges(u, v) by alternating large-star and small-star steps.

    Returns (node, root), root being the component's least node; nodes without an edge to another
    node are left out. Every step aggregates with partial sums and joins back on the node, so a node
    with very many neighbours is split by the adaptive skew join. Each step's edges are written to the
    shared folder; only their count and a checksum reach the driver. Empty edges give an empty result.
    """
    edges = edges.select("u", "v").where("u <> v")
    edges = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large star: neighbours above a node move to the least node around it
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its neighbours below move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = keep(small.where("u <> v").distinct(), "edges")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
