"""Event and usage streams: replay, running reports, changes, numbering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from ..operators import reports
from ..sources.journal import append

EVENT = "id bigint, job_id string, type string, timestamp timestamp, message string, data string"


def replay(spark: SparkSession, path: str, after: int | None = 0, job: str | None = None, schema: str | T.StructType = EVENT) -> DataFrame:
    """The event log as a stream: what was there after an id, then what is added; of one job or of all. After None,
    all of it, whatever the ids."""
    rows = spark.readStream.schema(schema).json(path)
    rows = rows if after is None else rows.where(F.col("id") > after)
    return rows if job is None else rows.where(F.col("job_id") == job)


def usage_report(usage: DataFrame) -> DataFrame:
    """The running breakdown; each micro-batch updates sums instead of reading the journal again."""
    return usage.groupBy(*reports.GROUP).agg(F.count("*").alias("requests"), F.sum(F.when(F.col("outcome") != "ok", 1).otherwise(0)).alias("failed_requests"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in reports.SUMS))


def windowed_usage(usage: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tokens by hour and stage; records later than the watermark are dropped and state with them."""
    return usage.withWatermark("recorded_at", late).groupBy(F.window("recorded_at", width).alias("w"), "stage").agg(F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens")).select(F.col("w.start").alias("start"), "stage", "total_tokens")


def changed(events: DataFrame, value: str = "type") -> DataFrame:
    """Events that change the value of their job, by keyed state of one value a job; order within a
    micro-batch is by id."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("id")
        keep = rows[value].ne(rows[value].shift(fill_value=last))
        if last is None and len(rows):
            keep.iloc[0] = True
        state.update((rows[value].iloc[-1],))
        yield rows[keep][["id", "job_id", value]]

    out = f"id bigint, job_id string, {value} string"
    return events.select("id", "job_id", value).groupBy("job_id").applyInPandasWithState(update, out, "last string", "append", "NoTimeout")


def numbered_sink(events: DataFrame, path: str, checkpoint: str, first: int = 1) -> StreamingQuery:
    """Appends events with ids that go on from the last one, in order of time, job and type, nulls last. A batch
    that is written again gets the same ids: the number after each batch stands in a small file of its own, and a
    batch starts from that of the one before."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        schema = "epoch bigint, following bigint"
        known = spark.read.schema(schema).json(f"{path}/_following/epoch={epoch - 1}").first() if epoch else None
        start = known.following if known else first
        order = [F.col(c).asc_nulls_last() for c in ("timestamp", "job_id", "type")]
        rows = batch.repartitionByRange(8, *order).withColumn("_p", F.spark_partition_id()).persist()  # sorted by ranges, counted by range
        try:
            counts = {r["_p"]: r["count"] for r in rows.groupBy("_p").count().collect()}
            before, total = {}, start
            for p in sorted(counts):
                before[p], total = total, total + counts[p]
            offset = F.coalesce(*(F.when(F.col("_p") == p, F.lit(n)) for p, n in before.items()), F.lit(start))
            place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
            append(rows.withColumn("id", (offset + place).cast("bigint")).drop("_p"), f"{path}/epoch={epoch}", "overwrite")
            append(spark.createDataFrame([(epoch, total)], schema), f"{path}/_following/epoch={epoch}", "overwrite")
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
