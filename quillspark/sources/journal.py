"""NDJSON journals, strict ledgers, job folders and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target))


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a journal; blank lines and lines that don't parse are skipped, a missing file is empty."""
    wanted = T._parse_datatype_string(schema)
    if not _exists(spark, path):
        return spark.createDataFrame([], wanted)
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", T.StructType([*wanted.fields, T.StructField("_corrupt_record", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return rows.select("r.*").where("_corrupt_record is null").drop("_corrupt_record")


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger; any malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jobs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """job.json of every folder, those that parse, the latest first."""
    try:
        rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", "true").json(f"{root}/*/job.json")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.where("_corrupt_record is null and id is not null").drop("_corrupt_record").orderBy(F.desc("updated_at"))


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object; none if the file is unreadable."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", "true").json(path).where("_corrupt_record is null").drop("_corrupt_record")


def append(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Appends records as lines, times to the microsecond. Spark commits whole files, so no torn tail is ever read."""
    time = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # by default Spark cuts them to milliseconds
    rows.write.mode(mode).options(timestampFormat=f"{time}XXXXX", timestampNTZFormat=time).json(path)


def without_batch(journal: DataFrame, batch_id: str) -> DataFrame:
    return journal.where(F.col("batch_id") != batch_id)


def imported_glossary(own: DataFrame, other: DataFrame, named_only: bool = False, named: tuple[str, ...] = ("person", "place", "ship", "organization")) -> DataFrame:
    """Another job's entries of the same languages whose source, in any case, this job lacks."""
    rows = other.where(F.col("category").isin(*named)) if named_only else other
    pair = ["source_language", "target_language"]
    have = own.select(*pair, F.lower("source").alias("_k"))
    langs = own.select(*pair).distinct()
    return rows.join(langs, pair, "left_semi").withColumn("_k", F.lower("source")).join(have, [*pair, "_k"], "left_anti").drop("_k")
