"""Usage, journal and ledger queries."""

from pyspark.sql import functions as F

from ..operators import journal as J
from ..operators import reports as R
from ..sources import adapters as A
from ..sources.adapters import table, with_
from .registry import query

_GROUPED = """ops AS (SELECT stage, profile, endpoint, model, coalesce(operation, call_id) AS op, count(*) AS requests, count(total_tokens) AS requests_with_usage,
  count(*) FILTER (outcome <> 'ok') AS failed_requests, count(*) FILTER (outcome = 'invalid_response') AS invalid_responses, count(*) FILTER (outcome = 'timeout') AS timeouts,
  sum(coalesce(prompt_tokens, 0)) AS prompt_tokens, sum(coalesce(cached_prompt_tokens, 0)) AS cached_prompt_tokens, sum(coalesce(completion_tokens, 0)) AS completion_tokens,
  sum(coalesce(total_tokens, 0)) AS total_tokens FROM {source} GROUP BY ALL),
b AS (SELECT stage, profile, endpoint, model, sum(requests)::BIGINT AS requests, count(*)::BIGINT AS logical_operations, count(*) FILTER (requests > 1)::BIGINT AS retried_operations,
  sum(requests_with_usage)::BIGINT AS requests_with_usage, sum(failed_requests)::BIGINT AS failed_requests, sum(invalid_responses)::BIGINT AS invalid_responses, sum(timeouts)::BIGINT AS timeouts,
  sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(cached_prompt_tokens)::BIGINT AS cached_prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(total_tokens)::BIGINT AS total_tokens
  FROM ops GROUP BY ALL)"""
_LAST = "last AS (SELECT * FROM usage WHERE run_id = (SELECT arg_max(run_id, append_seq) FROM usage WHERE run_id IS NOT NULL))"
_TOTALS = "SELECT " + ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in (*R.COUNTS, *R.SUMS)) + " FROM b"


@query(with_("usage", rest=_GROUPED.format(source="usage")) + f"SELECT *, list_position({list(R.STAGE_ORDER)}, stage)::INTEGER AS stage_rank FROM b")
def usage_breakdown(spark, sf_dir):
    return R.usage_breakdown(A.usage(spark, sf_dir)).withColumn("stage_rank", R.stage_rank())


@query(with_("usage", rest=_GROUPED.format(source="usage")) + _TOTALS)
def usage_totals(spark, sf_dir):
    return R.usage_totals(R.usage_breakdown(A.usage(spark, sf_dir)))


@query(with_("usage", rest=_LAST + ",\n" + _GROUPED.format(source="last")) + "SELECT * FROM b")
def usage_latest_run(spark, sf_dir):
    return R.usage_breakdown(R.latest_run(A.usage(spark, sf_dir)))


@query(with_("usage") + "SELECT count(DISTINCT coalesce(run_id, ''))::BIGINT AS runs, count(*)::BIGINT AS requests, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in R.SUMS) + " FROM usage HAVING count(DISTINCT coalesce(run_id, '')) >= 2")
def usage_lifetime(spark, sf_dir):
    return R.lifetime(A.usage(spark, sf_dir))


@query(
    with_("usage")
    + """SELECT model, stage, count(DISTINCT run_id)::BIGINT AS runs, count(*)::BIGINT AS requests, (count(*) FILTER (outcome <> 'ok') + count(*) FILTER (outcome = 'invalid_response'))::BIGINT AS bad,
  CASE WHEN sum(prompt_tokens) > 0 THEN round(sum(cached_prompt_tokens) * 100.0 / sum(prompt_tokens), 6) END AS cached_percent,
  floor(sum(completion_tokens) / count(*) + 0.5)::BIGINT AS output_per_request, sum(total_tokens)::BIGINT AS total_tokens FROM usage GROUP BY model, stage"""
)
def model_stage_report(spark, sf_dir):
    return R.model_stage_report(A.usage(spark, sf_dir))


@query(
    with_("usage")
    + r"""SELECT outcome, substr(regexp_replace(regexp_replace(outcome || ' in ' || operation || ' after ' || total_tokens || ' tokens', 'document-[0-9]+[:#][^\s,;]*', '<segment>', 'g'), '[0-9]+', 'N', 'g'), 1, 80) AS reason, count(*)::BIGINT AS n
FROM usage WHERE outcome <> 'ok' GROUP BY ALL"""
)
def failure_reasons(spark, sf_dir):
    return R.failure_reasons(A.usage(spark, sf_dir), F.expr("outcome || ' in ' || operation || ' after ' || total_tokens || ' tokens'"))


@query(
    with_("usage")
    + """SELECT run_id, count(*) FILTER (stage = 'audit')::BIGINT AS audited, count(*) FILTER (stage = 'audit' AND outcome <> 'ok')::BIGINT AS flagged, arg_min(model, append_seq) FILTER (stage = 'editing') AS editing_model,
  CASE WHEN count(*) FILTER (stage = 'audit') > 0 THEN round(count(*) FILTER (stage = 'audit' AND outcome <> 'ok') / count(*) FILTER (stage = 'audit'), 6) END AS flagged_share FROM usage GROUP BY run_id"""
)
def quality_by_run(spark, sf_dir):
    return R.quality_by_run(A.usage(spark, sf_dir))


@query(with_("journal") + "SELECT stage, done, total, greatest(0, total - done)::BIGINT AS pending FROM (SELECT stage, count(DISTINCT batch_id)::BIGINT AS done, CASE WHEN stage = 'repair' THEN count(DISTINCT batch_id) ELSE 20000 END::BIGINT AS total FROM journal GROUP BY stage)")
def run_manifest_units(spark, sf_dir):
    return R.manifest_units(A.journal(spark, sf_dir), F.lit(20000))


@query(with_("journal") + "SELECT stage, count(DISTINCT batch_id)::BIGINT AS batches FROM journal GROUP BY stage")
def checkpoint_progress(spark, sf_dir):
    return R.checkpoint_progress(A.journal(spark, sf_dir))


@query(with_("journal") + "SELECT stage, count(DISTINCT batch_id)::BIGINT AS batches, count(*)::BIGINT AS records, sum(coalesce(attempts, 1))::BIGINT AS attempts, count(DISTINCT checkpoint_key)::BIGINT AS keys FROM journal GROUP BY stage")
def job_results(spark, sf_dir):
    return R.job_results(A.journal(spark, sf_dir))


_SPENT = "spent AS (SELECT delegation_id, count(*)::BIGINT AS reservations, count(cost)::BIGINT AS settled, sum(coalesce(cost, amount))::DECIMAL(18,2) AS spent FROM reserve LEFT JOIN settle USING (reservation_id) GROUP BY 1)"


@query(with_("ledger", rest=_SPENT) + "SELECT * FROM spent")
def spend_by_delegation(spark, sf_dir):
    return R.spending(*A.ledger(spark, sf_dir))


@query(with_("ledger", rest=_SPENT) + "SELECT delegation_id, spent, 2000000::DECIMAL(18,2) AS budget, spent + 500 <= 2000000 AS allowed FROM spent")
def budget_check(spark, sf_dir):
    return R.budget_check(R.spending(*A.ledger(spark, sf_dir)), F.lit(2000000).cast("decimal(18,2)"), F.lit(500))


@query("SELECT source, sum(length(text))::BIGINT AS chars, ceil(round(sum(length(text)) / 1e6 * 2.5 * 100, 6)) / 100 AS cost FROM documents GROUP BY source")
def cost_estimate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars"))
    return rows.select("source", "chars", R.cost_estimate(F.col("chars"), F.lit(2.5)).alias("cost"))


@query("SELECT o_custkey AS job_id, arg_min(o_orderkey, o_orderkey) AS batch_id, min(o_orderkey) AS book_order FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def frontier(spark, sf_dir):
    active = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return R.frontier(active.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("batch_id"), F.col("o_orderkey").alias("book_order")))


@query(with_("usage") + "SELECT run_id, stage, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY run_id), 6) AS share FROM usage GROUP BY run_id, stage")
def progress_shares(spark, sf_dir):
    return R.shares(A.usage(spark, sf_dir).groupBy("run_id", "stage").agg(F.count("*").alias("n")), "n", "run_id")


@query(with_("journal") + "SELECT batch_id, stage, arg_max(append_seq, append_seq) AS append_seq, arg_max(attempts, append_seq) AS attempts, arg_max(payload, append_seq) AS payload, arg_max(checkpoint_key, append_seq) AS checkpoint_key FROM journal GROUP BY batch_id, stage")
def last_write_wins(spark, sf_dir):
    return J.last_write_wins(A.journal(spark, sf_dir), "batch_id", "stage")


@query("""SELECT o_orderkey AS batch_id, sha256('{"prompt_version":3,"mode":"translation","batch":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS checkpoint_key FROM orders""")
def checkpoint_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("batch_id"), J.checkpoint_key(F.lit(3).alias("prompt_version"), F.lit("translation").alias("mode"), F.col("o_orderkey").alias("batch"), F.col("o_orderstatus").alias("status")).alias("checkpoint_key"))


@query(
    """WITH have AS (SELECT l_orderkey AS batch_id, list(l_linenumber ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY 1)
SELECT o_orderkey AS batch_id, coalesce(ids = range(1, (o_orderkey % 7 + 2)::BIGINT), false) AS compatible FROM orders LEFT JOIN have ON batch_id = o_orderkey"""
)
def compatible_recovery(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("bigint"))).alias("ids"))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), F.sequence(F.lit(1).cast("bigint"), F.col("o_orderkey") % 7 + 1).alias("ids"))
    return J.compatible(have, wanted, "batch_id")


@query(
    with_("journal")
    + """SELECT w.batch_id, w.checkpoint_key, CASE WHEN k.checkpoint_key IS NOT NULL THEN 'hit' WHEN b.batch_id IS NOT NULL THEN 'compatible' ELSE 'compute' END AS state
FROM (SELECT o_orderkey AS batch_id, sha256(o_orderkey || ':' || (o_orderkey % 2000 + 1)) AS checkpoint_key FROM orders) w
LEFT JOIN (SELECT DISTINCT checkpoint_key FROM journal) k USING (checkpoint_key) LEFT JOIN (SELECT DISTINCT batch_id FROM journal) b ON b.batch_id = w.batch_id"""
)
def cache_hits_misses(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), F.sha2(F.concat_ws(":", F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 2000 + 1).cast("string")), 256).alias("checkpoint_key"))
    return J.hits_and_misses(wanted, A.journal(spark, sf_dir))


@query(with_("journal") + "SELECT stage, count(*)::BIGINT AS n, count(DISTINCT batch_id)::BIGINT AS batches FROM journal WHERE stage = 'translation' OR batch_id <> 7 GROUP BY stage")
def invalidated_journal(spark, sf_dir):
    return J.invalidate(A.journal(spark, sf_dir), "editing", F.lit(7)).groupBy("stage").agg(F.count("*").alias("n"), F.countDistinct("batch_id").alias("batches"))


@query(with_("journal") + "SELECT DISTINCT batch_id FROM journal WHERE batch_id <> 7")
def journal_without_batch(spark, sf_dir):
    return A.journal(spark, sf_dir).where("batch_id <> 7").select("batch_id").distinct()


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'O' THEN true ELSE o_orderkey % 3 = o_custkey % 3 END AS may_recover, CASE o_orderstatus WHEN 'O' THEN 'paused' WHEN 'P' THEN 'paused' ELSE 'completed' END AS status FROM orders")
def startup_recovery(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "analyzing").otherwise("completed")
    before = F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey") % 3)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), J.may_recover(before, F.col("o_custkey") % 3).alias("may_recover"), J.recovered_status(status).alias("status"))


_STATES = ["draft", "uploaded", "analyzing", "ready", "running", "stopping", "paused", "needs_attention", "failed", "completed"]
_EDGES = ", ".join(f"('{a}', '{b}')" for a, v in J.TRANSITIONS.items() for b in v)


@query(
    f"""WITH e AS (SELECT event_id, ({_STATES})[event_id % 10 + 1] AS before, ({_STATES})[(event_id + user_id) % 10 + 1] AS after FROM events)
SELECT event_id, before, after, (before, after) IN ({_EDGES}) AS legal FROM e"""
)
def state_transitions(spark, sf_dir):
    states = F.array(*map(F.lit, _STATES))
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(states, (F.col("event_id") % 10 + 1).cast("int")).alias("before"), F.element_at(states, ((F.col("event_id") + F.col("user_id")) % 10 + 1).cast("int")).alias("after"))
    return rows.withColumn("legal", J.legal(F.col("before"), F.col("after")))


@query("SELECT source AS job_id, sha256(string_agg('s' || doc_id || chr(10) || lang || chr(10) || text || chr(10), '' ORDER BY doc_id)) AS hash FROM documents GROUP BY 1")
def workspace_hashes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("job_id"), F.col("doc_id").alias("position"), F.concat(F.lit("s"), "doc_id").alias("slug"), F.col("lang").alias("title"), "text")
    return J.workspace_hash(rows)


@query("SELECT event_id AS id, 'job-' || user_id AS job_id, event_type AS type FROM events WHERE event_id > 500 AND user_id % 10 = 3")
def event_replay(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_id > 500 and user_id % 10 = 3").select(F.col("event_id").alias("id"), F.concat(F.lit("job-"), "user_id").alias("job_id"), F.col("event_type").alias("type"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def progress_events(spark, sf_dir):
    return J.changes(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'incomplete' WHEN o_orderkey % 7 = 1 THEN 'another workspace' WHEN o_orderkey % 7 = 2 THEN 'too long' WHEN o_orderkey % 7 = 3 THEN 'not valid yet' WHEN o_orderkey % 7 = 4 THEN 'expired' WHEN o_orderkey % 7 = 5 AND o_orderkey % 2 = 0 THEN 'revoked' END AS fault FROM orders""")
def delegation_faults(spark, sf_dir):
    k = F.col("o_orderkey") % 7
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(k == 1, "w2").otherwise("w1").alias("workspace"), F.lit("g").alias("granted_by"), F.array(F.lit("x")).alias("allow"),
        F.when(k == 0, "soon").when(k == 3, "2026-03-09T00:00:00Z").otherwise("2026-03-02T00:00:00Z").alias("granted_at"), F.when(k == 2, "2026-03-10T00:00:00Z").when(k == 3, "2026-03-11T00:00:00Z").when(k == 4, "2026-03-04T00:00:00Z").otherwise("2026-03-09T00:00:00Z").alias("expires_at"),
        F.when(k == 5, F.when(F.col("o_orderkey") % 2 == 0, "2026-03-03T00:00:00Z").otherwise("2026-03-08T00:00:00Z")).alias("revoked_at"),
    )
    return rows.select("id", R.delegation_fault(F.lit("w1"), F.lit("2026-03-05T00:00:00Z").cast("timestamp")).alias("fault"))
