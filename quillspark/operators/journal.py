"""Append-only journals: the last write wins, keys address content, stages invalidate what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What each stage makes stale: itself and all after it.
FLOORS = {"translation": ("translation", "editing", "audit", "repair"), "editing": ("editing", "audit", "repair"), "audit": ("audit", "repair")}
#: States a job may go to from each state. Fixed values.
TRANSITIONS = {
    "draft": ("uploaded",),
    "uploaded": ("analyzing",),
    "analyzing": ("ready", "failed"),
    "ready": ("running", "analyzing"),
    "running": ("stopping", "completed", "needs_attention", "failed"),
    "stopping": ("paused", "failed"),
    "paused": ("running",),
    "needs_attention": ("running",),
    "failed": ("analyzing", "running"),
}
INTERRUPTED = ("running", "stopping", "analyzing")


def last_write_wins(journal: DataFrame, *key: str) -> DataFrame:
    """The latest record of each key; max_by combines before it shuffles, so long histories stay cheap."""
    rest = [c for c in journal.columns if c not in key]
    return journal.groupBy(*key).agg(F.max_by(F.struct(*rest), "append_seq").alias("r")).select(*key, "r.*")


def checkpoint_key(*parts: Column) -> Column:
    """Hash of everything that an answer depends on, as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def compatible(journal: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """Batches whose recorded segment ids equal the wanted ones, in order."""
    ids = journal.select(*key, F.col("ids").alias("_have"))
    return wanted.join(ids, list(key), "left").select(*key, F.coalesce(F.col("_have") == F.col("ids"), F.lit(False)).alias("compatible"))


def hits_and_misses(wanted: DataFrame, journal: DataFrame) -> DataFrame:
    """Wanted batches: hit if a record has their key, compatible if one has their id, else to compute."""
    keys = journal.select(F.col("checkpoint_key").alias("k")).distinct()
    ids = journal.select(F.col("batch_id").alias("b")).distinct()
    rows = wanted.join(keys, F.col("checkpoint_key") == F.col("k"), "left").join(ids, F.col("batch_id") == F.col("b"), "left")
    state = F.when(F.col("k").isNotNull(), "hit").when(F.col("b").isNotNull(), "compatible").otherwise("compute")
    return rows.select("batch_id", "checkpoint_key", state.alias("state"))


def invalidate(journal: DataFrame, floor: str, batch: Column | None = None) -> DataFrame:
    """What stays when work from a stage on, of all batches or of one, is thrown away."""
    stale = F.col("stage").isin(*FLOORS[floor])
    return journal.where(~(stale if batch is None else stale & (F.col("batch_id") == batch)))


def may_recover(before: Column, now: Column) -> Column:
    """Work is reused only if the source is known to be the same, or was never fingerprinted."""
    return before.isNull() | (before == now)


def recovered_status(status: Column) -> Column:
    return F.when(status.isin(*INTERRUPTED), "paused").otherwise(status)


def legal(before: Column, after: Column) -> Column:
    return F.coalesce(*(F.when(before == k, after.isin(*v)) for k, v in TRANSITIONS.items()), F.lit(False))


def workspace_hash(chapters: DataFrame) -> DataFrame:
    """chapters: job_id, position, slug, title, text. One hash over all chapters in order; line ends and
    byte order marks don't matter."""
    text = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r\n?", "\n")
    line = F.concat_ws("\n", "slug", "title", text, F.lit(""))
    rows = chapters.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("l"))
    return rows.select("job_id", F.sha2(F.array_join(F.transform("l", lambda x: x["line"]), ""), 256).alias("hash"))


def changes(events: DataFrame, job: str, order: str, value: str) -> DataFrame:
    """Only events that change a counter of their job; its first event counts as a change."""
    before = F.lag(value).over(Window.partitionBy(job).orderBy(order))
    return events.withColumn("_b", before).where(~F.col("_b").eqNullSafe(F.col(value))).drop("_b")


def delegation_hash(*fields: tuple[str, Column]) -> Column:
    """sha256 of a delegation's canonical JSON: keys in order, without null ones and without revoked_at."""
    kept = sorted(((k, v) for k, v in fields if k != "revoked_at"), key=lambda x: x[0])
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*(v.alias(k) for k, v in kept))), 256))
