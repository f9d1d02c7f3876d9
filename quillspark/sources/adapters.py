"""The driver's tables as the engine's: usage, pairs, segments, journal, ledger, glossary.

Every function has a twin in SQL under the same name in SQL, a common table expression over the same
tables, so queries and oracles start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import base36

STAGES = ("translation", "editing", "audit", "repair", "consistency")
EVENT_STAGE = dict(zip(("click", "view", "purchase", "signup", "error"), STAGES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENT_STAGE.items()))
    outcome = F.when(F.col("event_type") != "error", "ok").otherwise(F.element_at(F.array(*map(F.lit, ("timeout", "invalid_response", "error"))), (F.col("event_id") % 3 + 1).cast("int")))
    tokens = lambda factor: F.when(F.col("value") >= 0, F.floor(F.col("value") * factor)).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("append_seq"), F.col("ts").alias("recorded_at"), F.concat(F.lit("call-"), F.col("event_id")).alias("call_id"),
        F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("run_id"), stage.alias("stage"), F.concat(F.lit("document-"), F.col("user_id"), F.lit(":0")).alias("operation"),
        F.lit("default").alias("profile"), F.lit("local").alias("endpoint"), F.concat(F.lit("model-"), F.col("user_id") % 3).alias("model"), outcome.alias("outcome"),
        tokens(10).alias("prompt_tokens"), tokens(2).alias("cached_prompt_tokens"), tokens(1).alias("completion_tokens"), (tokens(10) + tokens(1)).alias("total_tokens"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the assistant's right after it; no reply gives an empty target."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("r2"), F.lead("text").over(w).alias("t2"))
    return rows.where("role = 'user'").select(
        F.concat(F.lit("document-"), "conv_id").alias("doc_id"), F.col("turn").alias("seg_pos"), F.concat(F.lit("document-"), "conv_id", F.lit(":"), base36("turn")).alias("seg_id"),
        F.coalesce("text", F.lit("")).alias("source"), F.when(F.col("r2") == "assistant", F.coalesce("t2", F.lit(""))).otherwise("").alias("target"),
    )


def aligned(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """sources(seg_id, source, ...) with the target of targets(seg_id, target); '' where there is none."""
    return sources.join(targets, "seg_id", "left").withColumn("target", F.coalesce("target", F.lit("")))


def audit_inputs(originals: DataFrame, drafts: DataFrame, edited: DataFrame) -> DataFrame:
    """originals(seg_id, text) with their draft and edited translation by id; '' where there is none."""
    text = lambda df, name: df.select("seg_id", F.col("text").alias(name))
    rows = text(originals, "original").join(text(drafts, "initial_translation"), "seg_id", "left").join(text(edited, "edited_translation"), "seg_id", "left")
    return rows.na.fill("", ["initial_translation", "edited_translation"])


def latest_drafts(prepared: DataFrame, journal: DataFrame) -> DataFrame:
    """prepared(doc_id, pos, seg_id, original) with the draft that the journal(seg_id, append_seq, text) has last for each."""
    last = journal.groupBy("seg_id").agg(F.max_by("text", "append_seq").alias("draft"))
    return prepared.join(last, "seg_id", "left")


def by_position(originals: DataFrame, drafts: DataFrame, doc: str = "doc_id", order: str = "seg_pos") -> DataFrame:
    """originals and drafts of a document joined by their rank in it, whatever their ids."""
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(order))
    return originals.withColumn("_i", rank).join(drafts.withColumn("_i", rank).drop(order), [doc, "_i"]).drop("_i")


def pairs_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents; the target of even ids has lost their digits."""
    rows = table(spark, sf_dir, "documents")
    lost = F.regexp_replace("text", "[0-9]+", "")
    return rows.select(F.col("doc_id").cast("string").alias("seg_id"), F.col("text").alias("source"), F.when(F.col("doc_id") % 2 == 0, lost).otherwise(F.col("text")).alias("target"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, in order."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("document-"), "doc_id").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("seg_pos", "text"))
    return rows.select("doc_id", "seg_pos", F.concat("doc_id", F.lit(":"), base36("seg_pos")).alias("seg_id"), "text")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint records: a batch is an order, appended once a line; the stage follows the line number."""
    stages = F.array(*map(F.lit, STAGES[:4]))
    return table(spark, sf_dir, "lineitem").select(
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")).cast("bigint").alias("append_seq"),
        F.element_at(stages, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("stage"), F.col("l_orderkey").alias("batch_id"),
        F.col("l_quantity").cast("bigint").alias("attempts"), F.col("l_partkey").alias("payload"), F.sha2(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")), 256).alias("checkpoint_key"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reservations are orders; those with status F are settled by what their lines cost."""
    orders = table(spark, sf_dir, "orders")
    reserve = orders.select(F.col("o_orderkey").alias("reservation_id"), F.col("o_custkey").alias("delegation_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    done = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("reservation_id"), F.round(F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")), 2).cast("decimal(18,2)").alias("cost"))
    settle = lines.join(done, F.col("reservation_id") == F.col("k"), "left_semi").groupBy("reservation_id").agg(F.sum("cost").alias("cost"))
    return reserve, settle


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("source"), F.upper("n_name").alias("target"), F.lit("place").alias("category"), (F.col("n_nationkey") % 5 != 4).alias("enabled"))


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_STAGE.items())
SQL = {
    "usage": f"""usage AS (SELECT event_id AS append_seq, ts AS recorded_at, 'call-' || event_id AS call_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS run_id,
  CASE event_type {_CASES} END AS stage, 'document-' || user_id || ':0' AS operation, 'default' AS profile, 'local' AS endpoint, 'model-' || (user_id % 3) AS model,
  CASE WHEN event_type <> 'error' THEN 'ok' WHEN event_id % 3 = 0 THEN 'timeout' WHEN event_id % 3 = 1 THEN 'invalid_response' ELSE 'error' END AS outcome,
  CASE WHEN value >= 0 THEN floor(value * 10)::BIGINT END AS prompt_tokens, CASE WHEN value >= 0 THEN floor(value * 2)::BIGINT END AS cached_prompt_tokens,
  CASE WHEN value >= 0 THEN floor(value)::BIGINT END AS completion_tokens, CASE WHEN value >= 0 THEN floor(value * 10)::BIGINT + floor(value)::BIGINT END AS total_tokens FROM events)""",
    "pairs": """pairs AS (SELECT 'document-' || conv_id AS doc_id, turn AS seg_pos, 'document-' || conv_id || ':' || lower(to_base(turn, 36)) AS seg_id, coalesce(text, '') AS source,
  CASE WHEN r2 = 'assistant' THEN coalesce(t2, '') ELSE '' END AS target
  FROM (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')""",
    "pairs_numeric": """pairs_numeric AS (SELECT doc_id::VARCHAR AS seg_id, text AS source, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '[0-9]+', '', 'g') ELSE text END AS target
  FROM documents)""",
    "segments": """segments AS (SELECT 'document-' || doc_id AS doc_id, i - 1 AS seg_pos, 'document-' || doc_id || ':' || lower(to_base(i - 1, 36)) AS seg_id, l[i] AS text
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))""",
    "journal": """journal AS (SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)::BIGINT AS append_seq,
  ['translation', 'editing', 'audit', 'repair'][l_linenumber % 4 + 1] AS stage, l_orderkey AS batch_id, l_quantity::BIGINT AS attempts, l_partkey AS payload,
  sha256(l_orderkey || ':' || l_partkey) AS checkpoint_key FROM lineitem)""",
    "ledger": """reserve AS (SELECT o_orderkey AS reservation_id, o_custkey AS delegation_id, o_totalprice::DECIMAL(18,2) AS amount FROM orders),
settle AS (SELECT l_orderkey AS reservation_id, sum(round(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)), 2)::DECIMAL(18,2)) AS cost FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1)""",
    "glossary": """glossary AS (SELECT n_nationkey AS ordinal, n_name AS source, upper(n_name) AS target, 'place' AS category, n_nationkey % 5 <> 4 AS enabled FROM nation)""",
}


def with_(*names: str, rest: str = "") -> str:
    """WITH ... over the adapters named, and further expressions."""
    return "WITH " + ",\n".join([SQL[n] for n in names] + [rest] * bool(rest)) + "\n"
