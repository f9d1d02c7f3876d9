"""Queries on typography, samples, reviews and the deterministic pipeline."""

from pyspark.sql import functions as F

from .. import models as M
from ..operators import evals as V
from ..operators import ingest as I
from ..operators import quality as Q
from ..operators import typography as T
from ..sources import adapters as A
from ..sources.adapters import table, with_
from .registry import query

_N = lambda p, c="text": f"len(regexp_extract_all({c}, '{p}'))"


@query(f"""SELECT doc_id, {_N("«")}::INTEGER AS opening, {_N("»")}::INTEGER AS closing, {_N('"')}::INTEGER AS straight, {_N(T.HYBRID)}::INTEGER AS hybrid, {_N(T.DOUBLED)}::INTEGER AS doubled FROM documents""")
def quote_report(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.quote_report("text").alias("q")).select("doc_id", "q.*")


@query(
    with_("segments")
    + """SELECT translate(lower(word), 'éèê', 'eee') AS key, list_sort(list_distinct(list(lower(word)))) AS variants, count(*)::BIGINT AS uses FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}]+')) AS word FROM segments) GROUP BY 1 HAVING count(DISTINCT lower(word)) > 1"""
)
def spelling_variants(spark, sf_dir):
    words = A.segments(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}]+)"), 1)).alias("word"))
    return T.spelling_variants(words, "éèê", "eee")


@query(
    with_("segments")
    + """, s AS (SELECT *, sum(contains(lower(text), 'é')::INT) OVER (PARTITION BY doc_id ORDER BY seg_pos) AS island FROM segments),
r AS (SELECT doc_id, island, sum(CASE WHEN contains(lower(text), 'é') THEN 0 ELSE length(text) END) AS run, sum(len(regexp_extract_all(lower(text), 'é'))) AS n FROM s GROUP BY ALL)
SELECT doc_id, max(run)::BIGINT AS longest, sum(n)::BIGINT AS letters, sum(n) >= 3 AND max(run) >= 4000 AS drift FROM r GROUP BY doc_id"""
)
def longest_run_without(spark, sf_dir):
    return T.longest_run_without(A.segments(spark, sf_dir), "é")


@query(
    """WITH w AS (SELECT doc_id, s AS i, substr(text, (s * 4000 + 1)::BIGINT, 4000) AS t FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 4000 + 1)) AS s FROM documents WHERE text <> '')),
c AS (SELECT doc_id, i, len(regexp_extract_all(t, '[\\p{L}]+')) AS words, len(regexp_extract_all(lower(t), 'é')) AS uses FROM w) SELECT doc_id, i::INTEGER AS i, words::INTEGER AS words, uses::INTEGER AS uses, words >= 300 AND uses = 0 AND sum(uses) OVER (PARTITION BY doc_id) >= 3 AS bare FROM c"""
)
def letter_windows(spark, sf_dir):
    return T.letter_windows(table(spark, sf_dir, "documents"), "é")


@query("SELECT user_id AS doc_id, sum(CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 1 ELSE 0 END)::BIGINT AS warnings FROM events GROUP BY 1")
def warning_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_type") == "error").cast("int").alias("e"), (F.col("event_type") == "signup").cast("int").alias("s"))
    return T.warning_counts(rows, {"e": 3, "s": 1})


@query()
def guillemet_faults(spark, sf_dir):
    quoted = F.regexp_replace(F.regexp_replace("text", r"\bthe\b", "«the"), r"\band\b", "and»")
    return table(spark, sf_dir, "documents").select("doc_id", T.guillemet_faults(quoted).alias("faults"))


@query(
    with_("segments")
    + """, w AS (SELECT seg_id, unnest(regexp_extract_all(lower(text), '[\\p{L}]{5,}')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\\p{L}]{5,}'), 1) AS i FROM segments),
l AS (SELECT *, substr(w, 1, 5) AS stem, lag(i) OVER (PARTITION BY seg_id, substr(w, 1, 5) ORDER BY i) AS b FROM w)
SELECT seg_id, stem, count(*)::BIGINT AS n, count(DISTINCT w)::BIGINT AS spellings FROM l GROUP BY seg_id, stem HAVING count(*) >= 2 AND (count(DISTINCT w) > 1 OR bool_or(coalesce(i - b = 1, false)))"""
)
def repeated_stems(spark, sf_dir):
    return T.repeated_stems(A.segments(spark, sf_dir), "seg_id")


@query()
def duplicated_fragments(spark, sf_dir):
    return A.segments(spark, sf_dir).select("seg_id", T.duplicated_fragments("text").alias("fragments")).where(F.size("fragments") > 0)


@query()
def quote_mechanics(spark, sf_dir):
    """All documents' segments after the mechanical rules, read over whole documents."""
    return T.mechanics(A.segments(spark, sf_dir)).select("seg_id", F.sha2("text", 256).alias("hash"), "applied")


@query()
def document_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), "lang", "text")
    return T.audit(rows, "en-GB")


_DRAFTS = "d AS (SELECT doc_id, seg_pos AS pos, seg_id AS id, text AS original, CASE WHEN seg_pos % 5 = 0 THEN text WHEN seg_pos % 7 = 0 THEN NULL ELSE '[translated] ' || text END AS draft FROM segments)"
_CANDIDATES = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(regexp_replace(original, '[ \\t\\r\\n]+', ' ', 'g'))) ORDER BY doc_id, pos) AS r FROM d WHERE draft IS NOT NULL AND original <> draft AND length(original) BETWEEN 80 AND 1800) WHERE r = 1)"


def _candidates(spark, sf_dir):
    draft = F.when(F.col("seg_pos") % 5 == 0, F.col("text")).when(F.col("seg_pos") % 7 == 0, None).otherwise(F.concat(F.lit("[translated] "), "text"))
    return V.corpus_candidates(A.segments(spark, sf_dir).select("doc_id", F.col("seg_pos").alias("pos"), F.col("seg_id").alias("id"), F.col("text").alias("original"), draft.alias("draft")))


@query(with_("segments", rest=f"{_DRAFTS},\n{_CANDIDATES}") + "SELECT id, original, draft FROM c")
def corpus_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("id", "original", "draft")


@query(
    with_("segments", rest=f"{_DRAFTS},\n{_CANDIDATES}")
    + """, b AS (SELECT id, CASE WHEN length(original) < 240 THEN 0 WHEN length(original) < 700 THEN 1 ELSE 2 END AS bucket FROM c), t AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha256('42:' || id)) AS turn FROM b)
SELECT id, bucket, turn::INTEGER AS turn FROM t ORDER BY turn, bucket LIMIT 60"""
)
def stratified_sample(spark, sf_dir):
    return V.stratified(_candidates(spark, sf_dir).withColumn("length", F.length("original")), "42", 60).select("id", "bucket", "turn")


@query(
    """WITH e AS (SELECT doc_id AS id, trim(text) <> '' AS not_empty, doc_id % 9 <> 0 AS changed, NOT (regexp_matches(lower(text), 'license') OR regexp_matches(text, '[0-9]{6}')) AS none_forbidden, regexp_matches(lower(text), 'the|der|que') AS has_required FROM documents)
SELECT *, not_empty AND changed AND none_forbidden AND has_required AS passed FROM e"""
)
def rule_evaluation(spark, sf_dir):
    return V.rule_checks(_cases(spark, sf_dir))


def _cases(spark, sf_dir):
    draft = F.when(F.col("doc_id") % 9 == 0, F.col("text")).otherwise("draft")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), draft.alias("draft"), F.col("text").alias("edited"), F.array(F.lit("license"), F.lit("[0-9]{6}")).alias("forbidden"), F.array(F.lit("the|der|que")).alias("required_any"))


@query("SELECT count(*)::BIGINT AS total, count(*) FILTER (toxic = 0)::BIGINT AS completed, count(*) FILTER (toxic = 1)::BIGINT AS errors, count(*) FILTER (toxic = 0 AND quality = 1)::BIGINT AS passed, round(count(*) FILTER (toxic = 0 AND quality = 1) / count(*) FILTER (toxic = 0), 6) AS pass_rate, count(*) FILTER (toxic = 0 AND quality = 1) / count(*) FILTER (toxic = 0) >= 0.85 AS accepted FROM labels")
def eval_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("passed"), F.when(F.col("toxic") == 1, "failed").alias("error"))
    return V.accepted(V.eval_summary(rows), 0.85, True)


@query("SELECT CASE doc_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'tie' ELSE 'both_bad' END AS verdict, count(*)::BIGINT AS n FROM labels GROUP BY 1")
def review_summary(spark, sf_dir):
    verdict = F.element_at(F.array(*map(F.lit, ("a", "b", "tie", "both_bad"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return V.review_summary(table(spark, sf_dir, "labels").select(verdict.alias("verdict")))


@query("""WITH r AS (SELECT doc_id % 200 AS case_id, quality::VARCHAR AS f FROM labels) SELECT case_id, CASE WHEN case_id >= 150 THEN 'unknown case' WHEN count(*) OVER (PARTITION BY case_id) > 1 THEN 'duplicate case' WHEN f <> '1' THEN 'other fingerprint' END AS fault FROM r""")
def checked_reviews(spark, sf_dir):
    reviews = table(spark, sf_dir, "labels").select((F.col("doc_id") % 200).alias("case_id"), F.col("quality").cast("string").alias("fingerprint"))
    return V.checked_reviews(reviews, spark.range(150).select(F.col("id").alias("case_id"), F.lit("1").alias("fingerprint"))).select("case_id", "fault")


@query("SELECT doc_id AS id, CASE WHEN s THEN 'b' ELSE 'a' END AS first, CASE WHEN s THEN 'a' ELSE 'b' END AS second FROM (SELECT doc_id, ('0x' || substr(sha256('2026:' || doc_id), 1, 2))::INTEGER % 2 = 1 AS s FROM documents)")
def blind_order(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("a").alias("a"), F.lit("b").alias("b"))
    return V.blinded(rows, V.blind_swap(F.lit("2026"), F.col("id")))


@query("""SELECT n_nationkey AS id, sha256('{"name":"' || n_name || '","region":"' || n_regionkey || '"}') AS fingerprint FROM nation""")
def comparison_fingerprints(spark, sf_dir):
    return V.fingerprints(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("name")), "region", "name").select("id", "fingerprint")


@query(
    with_("journal")
    + """SELECT o_orderkey AS seg_id, 's' || o_orderkey AS source, arg_max('t' || payload, append_seq) FILTER (stage = 'translation') AS translation, arg_max('t' || payload, append_seq) FILTER (stage = 'editing') AS editing,
  arg_max('t' || payload, append_seq) FILTER (stage = 'audit') AS audit, arg_max('t' || payload, append_seq) FILTER (stage = 'repair') AS repair, any_value(c_name) AS final
FROM orders LEFT JOIN journal ON batch_id = o_orderkey LEFT JOIN customer ON c_custkey = o_orderkey GROUP BY o_orderkey"""
)
def segment_trace(spark, sf_dir):
    source = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seg_id"), F.col("o_orderkey").alias("locator"), F.concat(F.lit("s"), "o_orderkey").alias("text"))
    journal = A.journal(spark, sf_dir).select(F.col("batch_id").alias("seg_id"), "stage", F.concat(F.lit("t"), "payload").alias("text"), "append_seq")
    return V.segment_trace(source, journal, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("locator"), F.col("c_name").alias("text")))


@query(
    with_("segments")
    + """, d AS (SELECT text AS s, '[translated] ' || text AS t FROM segments WHERE trim(text) <> '') SELECT count(*) FILTER (length(s) >= 80 AND (length(t) / length(s) < 0.5 OR length(t) / length(s) > 2))::BIGINT AS length_ratio, 0::BIGINT AS empty FROM d"""
)
def deterministic_pipeline(spark, sf_dir):
    """Documents to segments to batches, answered by the deterministic provider, scanned and counted."""
    segments = A.segments(spark, sf_dir).select("doc_id", "seg_pos", "seg_id", "text")
    rows = I.with_batches(segments).select("doc_id", "seg_pos", "seg_id", "text")
    defects = Q.scan(rows.select("seg_id", F.col("text").alias("source"), M.answered(F.col("text"), "translation").alias("target")))
    count = lambda k: F.coalesce(F.sum((F.col("kind") == k).cast("int")), F.lit(0)).cast("bigint").alias(k)
    return defects.agg(count("length_ratio"), count("empty"))


@query(with_("segments") + "SELECT seg_id, '[translated] ' || text AS text FROM segments")
def provider_answers(spark, sf_dir):
    batches = I.with_batches(A.segments(spark, sf_dir)).groupBy("doc_id", "batch_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_pos", "seg_id", "text"))), lambda s: F.struct(s["seg_id"].alias("id"), s["text"].alias("text"))).alias("segs"))
    return M.run_batches(batches.withColumn("batch_id", F.concat("doc_id", F.lit("-batch-"), "batch_no")), "translation").select("seg_id", "text")


@query("SELECT o_orderkey AS batch_id, o_orderkey % 3 <> 1 AND o_orderkey % 5 <> 2 AS valid FROM orders")
def response_contract(spark, sf_dir):
    k = F.col("o_orderkey")
    wanted = F.array(k, k + 1)
    got = F.when(k % 3 == 1, F.array(k + 1, k)).when(k % 5 == 2, F.array(k)).otherwise(F.array(k, k + 1))
    return table(spark, sf_dir, "orders").select(k.alias("batch_id"), M.answers_match(wanted, got).alias("valid"))
