"""Samples, rules and reviews that judge a run."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapsed

BUCKETS = (240, 700)


def corpus_candidates(drafts: DataFrame, least: int = 80, most: int = 1800) -> DataFrame:
    """drafts: doc_id, pos, original, draft. Changed segments of fit length, the first of each wording."""
    rows = drafts.where("draft is not null and original <> draft").where(F.length("original").between(least, most))
    key = F.lower(collapsed("original"))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("doc_id", "pos"))).where("_r = 1").drop("_r")


def stratified(rows: DataFrame, seed: str, n: int, key: str = "id", length: str = "length") -> DataFrame:
    """n rows, one of each length bucket in turn, in the order of a seeded hash."""
    bucket = F.when(F.col(length) < BUCKETS[0], 0).when(F.col(length) < BUCKETS[1], 1).otherwise(2)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    ranked = rows.withColumn("bucket", bucket).withColumn("turn", F.row_number().over(Window.partitionBy("bucket").orderBy(digest)))
    return ranked.orderBy("turn", "bucket").limit(n)


def rule_checks(cases: DataFrame) -> DataFrame:
    """cases: id, draft, edited, forbidden, required_any: arrays of patterns. Which checks fail."""
    hit = lambda p: F.regexp_like("edited", F.concat(F.lit("(?iu)"), p))
    return cases.select(
        "id", (F.trim("edited") != "").alias("not_empty"), (F.col("edited") != F.col("draft")).alias("changed"),
        (~F.exists("forbidden", hit)).alias("none_forbidden"), ((F.size("required_any") == 0) | F.exists("required_any", hit)).alias("has_required"),
    ).withColumn("passed", F.expr("not_empty and changed and none_forbidden and has_required"))


def eval_summary(results: DataFrame) -> DataFrame:
    """results: passed, error. Rates over completed cases, 0 if there are none."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    done = F.col("error").isNull()
    out = results.agg(F.count("*").alias("total"), n(done).alias("completed"), n(~done).alias("errors"), n(done & F.col("passed")).alias("passed"))
    return out.withColumn("pass_rate", F.when(F.col("completed") > 0, F.round(F.col("passed") / F.col("completed"), 6)).otherwise(F.lit(0.0)))


def accepted(summary: DataFrame, floor: float, whole: bool) -> DataFrame:
    """The floor holds only for runs over the whole corpus."""
    return summary.withColumn("accepted", (F.lit(not whole)) | (F.col("pass_rate") >= floor))


def review_summary(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("verdict").agg(F.count("*").alias("n"))


def checked_reviews(reviews: DataFrame, cases: DataFrame) -> DataFrame:
    """Reviews with their cases; those of unknown cases, doubles and other fingerprints say so."""
    many = F.count("*").over(Window.partitionBy("case_id"))
    rows = reviews.withColumn("_n", many).join(cases.select(F.col("case_id").alias("_c"), F.col("fingerprint").alias("_f")), F.col("case_id") == F.col("_c"), "left")
    fault = F.when(F.col("_c").isNull(), "unknown case").when(F.col("_n") > 1, "duplicate case").when(F.col("fingerprint") != F.col("_f"), "other fingerprint")
    return rows.withColumn("fault", fault).drop("_n", "_c", "_f")


def blind_swap(created: Column, case: Column) -> Column:
    """Whether version B is shown first: the parity of a hash's first byte."""
    digest = F.sha2(F.concat(created.cast("string"), F.lit(":"), case.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % 2 == 1


def blinded(cases: DataFrame, swap: Column) -> DataFrame:
    return cases.withColumn("_s", swap).select("id", F.when(F.col("_s"), F.col("b")).otherwise(F.col("a")).alias("first"), F.when(F.col("_s"), F.col("a")).otherwise(F.col("b")).alias("second"))


def fingerprints(cases: DataFrame, *parts: str) -> DataFrame:
    """A hash of canonical JSON, keys sorted."""
    kind = "struct<" + ",".join(f"{p}:string" for p in sorted(parts)) + ">"

    def run(column: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for x in column.to_pylist()], pa.string())

    return cases.withColumn("fingerprint", F.arrow_udf(run, "string")(F.struct(*(F.col(p).cast("string").alias(p) for p in sorted(parts))).cast(kind)))


def segment_trace(source: DataFrame, journal: DataFrame, final: DataFrame) -> DataFrame:
    """source: seg_id, locator, text; journal: seg_id, stage, text, append_seq; final: locator, text. Each
    segment through all stages, the last record of each; the final text is found by place, not by id."""
    stages = ("translation", "editing", "audit", "repair")
    last = journal.groupBy("seg_id").agg(*(F.max_by("text", F.when(F.col("stage") == s, F.col("append_seq"))).alias(s) for s in stages))
    rows = source.join(last, "seg_id", "left").join(final.select("locator", F.col("text").alias("final")), "locator", "left")
    return rows.select("seg_id", F.col("text").alias("source"), *stages, "final")
