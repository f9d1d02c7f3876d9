"""Aggregations over usage, journals and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STAGE_ORDER = ("translation", "editing", "audit", "repair", "consistency")
GROUP = ("stage", "profile", "endpoint", "model")
SUMS = ("prompt_tokens", "cached_prompt_tokens", "completion_tokens", "total_tokens")
COUNTS = ("requests", "logical_operations", "retried_operations", "requests_with_usage", "failed_requests", "invalid_responses", "timeouts")


def stage_rank(stage: str = "stage") -> Column:
    """A stage's place in the pipeline; unknown ones come first, as rank 0."""
    return F.array_position(F.array(*map(F.lit, STAGE_ORDER)), F.col(stage)).cast("int")


def usage_breakdown(usage: DataFrame) -> DataFrame:
    """One row per stage, profile, endpoint and model. Attempts are summed by operation first, so both
    levels combine before they shuffle; a record without an operation is one of its own."""
    some = lambda c: F.sum(F.when(c, 1).otherwise(0))
    failed = F.col("outcome") != "ok"
    by_operation = usage.groupBy(*GROUP, F.coalesce("operation", "call_id").alias("op")).agg(
        F.count("*").alias("requests"), some(F.col("total_tokens").isNotNull()).alias("requests_with_usage"), some(failed).alias("failed_requests"),
        some(F.col("outcome") == "invalid_response").alias("invalid_responses"), some(F.col("outcome") == "timeout").alias("timeouts"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in SUMS),
    )
    return by_operation.groupBy(*GROUP).agg(
        F.sum("requests").alias("requests"), F.count("*").alias("logical_operations"), some(F.col("requests") > 1).alias("retried_operations"),
        *(F.sum(c).alias(c) for c in (*COUNTS[3:], *SUMS)),
    )


def usage_totals(breakdown: DataFrame) -> DataFrame:
    """Sums over the breakdown: operations count once per group, not once overall."""
    return breakdown.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*COUNTS, *SUMS)))


def latest_run(usage: DataFrame) -> DataFrame:
    """Records of the run that was appended to last; all records if none names a run."""
    last = usage.agg(F.max_by("run_id", F.when(F.col("run_id").isNotNull(), F.col("append_seq"))).alias("last"))
    return usage.join(F.broadcast(last), F.col("last").isNull() | (F.col("run_id") == F.col("last"))).drop("last")  # one row


def lifetime(usage: DataFrame) -> DataFrame:
    """What all runs cost, if there are two or more."""
    runs = usage.groupBy(F.coalesce("run_id", F.lit("")).alias("r")).agg(F.count("*").alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in SUMS))
    return runs.agg(F.count("*").alias("runs"), F.sum("n").alias("requests"), *(F.sum(c).alias(c) for c in SUMS)).where("runs >= 2")


def model_stage_report(usage: DataFrame) -> DataFrame:
    """Per model and stage over all runs; `bad` counts invalid answers twice, as failed and as invalid."""
    per_run = usage_breakdown_by_run(usage)
    out = per_run.groupBy("model", "stage").agg(F.countDistinct("run_id").alias("runs"), *(F.sum(c).alias(c) for c in ("requests", "failed_requests", "invalid_responses", *SUMS)))
    return out.select(
        "model", "stage", "runs", "requests", (F.col("failed_requests") + F.col("invalid_responses")).alias("bad"),
        F.when(F.col("prompt_tokens") > 0, F.round(F.col("cached_prompt_tokens") * 100.0 / F.col("prompt_tokens"), 6)).alias("cached_percent"),
        F.floor(F.col("completion_tokens") / F.col("requests") + 0.5).alias("output_per_request"), "total_tokens",
    )


def usage_breakdown_by_run(usage: DataFrame) -> DataFrame:
    some = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return usage.groupBy("run_id", *GROUP).agg(F.count("*").alias("requests"), some(F.col("outcome") != "ok").alias("failed_requests"), some(F.col("outcome") == "invalid_response").alias("invalid_responses"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in SUMS))


def failure_reasons(usage: DataFrame, detail: Column) -> DataFrame:
    """Failures by outcome and reason; ids and numbers of a reason don't tell it apart."""
    reason = F.substring(F.regexp_replace(F.regexp_replace(detail, r"document-[0-9]+[:#][^\s,;]*", "<segment>"), "[0-9]+", "N"), 1, 80)
    return usage.where("outcome <> 'ok'").groupBy("outcome", reason.alias("reason")).agg(F.count("*").alias("n"))


def quality_by_run(usage: DataFrame) -> DataFrame:
    """Audited and flagged requests of each run, and the model of its first editing record."""
    audit = F.col("stage") == "audit"
    out = usage.groupBy("run_id").agg(
        F.sum(F.when(audit, 1).otherwise(0)).alias("audited"), F.sum(F.when(audit & (F.col("outcome") != "ok"), 1).otherwise(0)).alias("flagged"),
        F.min_by("model", F.when(F.col("stage") == "editing", F.col("append_seq"))).alias("editing_model"),
    )
    return out.withColumn("flagged_share", F.when(F.col("audited") > 0, F.round(F.col("flagged") / F.col("audited"), 6)))


def manifest_units(journal: DataFrame, total: Column, high_quality: bool = True) -> DataFrame:
    """Done and pending batches by stage; an audit counts only in the high quality mode, repairs have no target."""
    done = journal.groupBy("stage").agg(F.countDistinct("batch_id").alias("done"))
    goal = F.when(F.col("stage") == "repair", F.col("done")).when((F.col("stage") == "audit") & F.lit(not high_quality), F.lit(0)).otherwise(total)
    return done.select("stage", "done", goal.cast("bigint").alias("total"), F.greatest(F.lit(0), goal - F.col("done")).cast("bigint").alias("pending"))


def checkpoint_progress(journal: DataFrame) -> DataFrame:
    return journal.groupBy("stage").agg(F.countDistinct("batch_id").alias("batches"))


def job_results(journal: DataFrame) -> DataFrame:
    return journal.groupBy("stage").agg(F.countDistinct("batch_id").alias("batches"), F.count("*").alias("records"), F.sum(F.coalesce("attempts", F.lit(1))).alias("attempts"), F.countDistinct("checkpoint_key").alias("keys"))


def spending(reserve: DataFrame, settle: DataFrame) -> DataFrame:
    """Spent under each delegation: what was settled, else what is still reserved."""
    rows = reserve.join(settle, "reservation_id", "left")
    return rows.groupBy("delegation_id").agg(F.count("*").alias("reservations"), F.count("cost").alias("settled"), F.sum(F.coalesce("cost", "amount")).cast("decimal(18,2)").alias("spent"))


def budget_check(spent: DataFrame, limit: Column, estimate: Column) -> DataFrame:
    return spent.select("delegation_id", "spent", limit.alias("budget"), (F.col("spent") + estimate <= limit).alias("allowed"))


def cost_estimate(chars: Column, price: Column) -> Column:
    """Cents, rounded up, of so many characters at a price per million; null without a price."""
    return F.when(price.isNotNull(), F.ceil(F.round(chars / 1e6 * price * 100, 6)) / 100)


def frontier(active: DataFrame) -> DataFrame:
    """Of each job, the batch that comes first in the book among those still active."""
    return active.groupBy("job_id").agg(F.min_by("batch_id", "book_order").alias("batch_id"), F.min("book_order").alias("book_order"))


def shares(df: DataFrame, value: str, over: str) -> DataFrame:
    return df.withColumn("share", F.round(F.col(value) / F.sum(value).over(Window.partitionBy(over)), 6))


def delegation_fault(workspace: Column, now: Column, longest: str = "7 days") -> Column:
    """Why a delegation (workspace, granted_by, granted_at, expires_at, allow, revoked_at; dates as text) doesn't hold now; null if it does."""
    date = lambda c: F.try_to_timestamp(F.col(c))
    granted, expires, revoked = date("granted_at"), date("expires_at"), date("revoked_at")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(blank("workspace") | blank("granted_by") | F.col("allow").isNull() | granted.isNull() | expires.isNull(), "incomplete")
        .when(F.col("workspace") != workspace, "another workspace")
        .when(expires > granted + F.expr(f"interval {longest}"), "too long")
        .when(now < granted, "not valid yet")
        .when(now >= expires, "expired")
        .when(revoked <= now, "revoked")
    )
