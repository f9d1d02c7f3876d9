"""Queries on parallel texts."""

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources import adapters as A
from ..sources.adapters import with_
from .registry import query

_N = "n AS (SELECT *, trim(regexp_replace(source, '[ \\t\\r\\n]+', ' ', 'g')) AS s, trim(regexp_replace(target, '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM {0})"
_PAIRS = with_("pairs", rest=_N.format("pairs"))
_CJK = "[\\p{Han}\\p{Hiragana}\\p{Katakana}]"
_EXP = f"CASE WHEN len(regexp_extract_all(s, '{_CJK}')) * 2 > length(s) THEN 3 ELSE 1 END"
_DEFECTS = f"""d AS (SELECT seg_id, CASE WHEN t = '' THEN 'empty' WHEN length(s) >= 40 AND lower(s) = lower(t) AND regexp_matches(s, '\\p{{L}}{{2,}}') THEN 'untranslated'
  WHEN length(s) >= 80 AND (length(t) / length(s) < 0.5 * ({_EXP}) OR length(t) / length(s) > 2 * ({_EXP})) THEN 'length_ratio' END AS kind, length(t) / length(s) AS ratio FROM n WHERE s <> '')"""


@query(_PAIRS + "SELECT seg_id FROM n WHERE s <> '' AND t = ''")
def pair_empty(spark, sf_dir):
    return Q.scan(A.pairs(spark, sf_dir)).where("kind = 'empty'").select("seg_id")


@query(with_("pairs_numeric", rest=_N.format("pairs_numeric")) + "SELECT seg_id FROM n WHERE t <> '' AND length(s) >= 40 AND lower(s) = lower(t) AND regexp_matches(s, '\\p{L}{2,}')")
def pair_untranslated(spark, sf_dir):
    return Q.scan(A.pairs_numeric(spark, sf_dir)).where("kind = 'untranslated'").select("seg_id")


@query(_PAIRS.rstrip() + f",\n{_DEFECTS}\nSELECT seg_id, 'translation is ' || printf('%.2f', ratio) || '× the length of the original' AS detail FROM d WHERE kind = 'length_ratio'")
def pair_length_ratio(spark, sf_dir):
    return Q.scan(A.pairs(spark, sf_dir)).where("kind = 'length_ratio'").select("seg_id", "detail")


def _numbers(c: str) -> str:
    """Numbers of a text as functions.text.numbers finds them, in DuckDB."""
    flat = f"list_transform(string_split(regexp_replace(translate({c}, '₀₁₂₃₄₅₆₇₈₉', '0123456789'), '([0-9]{{1,3}}(?:[{_SEPARATORS}][0-9]{{3}})+)', chr(1) || '\\1' || chr(2), 'g'), chr(1)), lambda x: CASE WHEN contains(x, chr(2)) THEN regexp_replace(split_part(x, chr(2), 1), '[^0-9]', '', 'g') || split_part(x, chr(2), 2) ELSE x END)"
    return f"list_filter(regexp_extract_all(array_to_string({flat}, ''), '[0-9]+'), lambda x: length(x) <= 6)"


_SEPARATORS = ".,    ''’"
_PLAIN = "CASE WHEN len(regexp_extract_all({0}, '\\p{{Latin}}')) > greatest(len(regexp_extract_all({0}, '\\p{{Cyrillic}}')), len(regexp_extract_all({0}, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}]'))) THEN regexp_replace({0}, '(^|[^\\p{{L}}\\p{{N}}])1([ \\t\\r\\n]+\\p{{L}})', '\\1I\\2', 'g') ELSE {0} END".format
_GONE = f"""m AS (SELECT seg_id, s, t, {_numbers(_PLAIN("s"))} AS ns, {_numbers("t")} AS nt FROM n),
g AS (SELECT seg_id FROM m WHERE s <> '' AND t <> '' AND NOT (length(s) >= 40 AND lower(s) = lower(t) AND regexp_matches(s, '\\p{{L}}{{2,}}'))
  AND len(list_filter(list_distinct(ns), lambda v: len(list_filter(ns, lambda x: x = v)) > len(list_filter(nt, lambda x: x = v)) AND NOT (length(v) = 2 AND regexp_matches(t, '(^|[^0-9])(19|20)' || v || '($|[^0-9])')))) > 0)"""
_ALL = f"""{_DEFECTS}, {_GONE}, k AS (SELECT seg_id, kind FROM d WHERE kind IS NOT NULL UNION ALL SELECT seg_id, 'missing_numbers' FROM g)"""


@query(with_("pairs_numeric") + f"SELECT seg_id, {_numbers(_PLAIN('source'))} AS numbers FROM pairs_numeric")
def source_numbers(spark, sf_dir):
    from ..functions.text import dominant_script, numbers

    plain = F.when(dominant_script("source") == "latin", F.regexp_replace("source", r"(?<![\p{L}\p{N}])1(?=[ \t\r\n]+\p{L})", "I")).otherwise(F.col("source"))
    return A.pairs_numeric(spark, sf_dir).select("seg_id", numbers(plain).alias("numbers"))


@query(with_("pairs_numeric", rest=_N.format("pairs_numeric")).rstrip() + f",\n{_GONE}\nSELECT seg_id FROM g")
def pair_missing_numbers(spark, sf_dir):
    return Q.scan(A.pairs_numeric(spark, sf_dir)).where("kind = 'missing_numbers'").select("seg_id")


@query(_PAIRS.rstrip() + f",\n{_ALL}\nSELECT seg_id, kind FROM k")
def scan_defects(spark, sf_dir):
    return Q.scan(A.pairs(spark, sf_dir)).select("seg_id", "kind")


_KINDS = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS {k}" for k in Q.KINDS)


@query(_PAIRS.rstrip() + f",\n{_ALL}\nSELECT count(DISTINCT seg_id)::BIGINT AS defect_segments, count(DISTINCT seg_id) FILTER (kind <> 'source_residue')::BIGINT AS actionable_segments, count(DISTINCT seg_id) FILTER (kind = 'source_residue')::BIGINT AS advisory_segments, {_KINDS} FROM k")
def scan_report(spark, sf_dir):
    return Q.scan_report(Q.scan(A.pairs(spark, sf_dir)))


@query(
    with_("pairs", rest="w AS (SELECT *, lead(source) OVER (PARTITION BY doc_id ORDER BY seg_pos) AS nx FROM pairs), l AS (SELECT *, length(source) AS o, length(target) AS a, length(nx) AS x FROM w WHERE nx IS NOT NULL)")
    + """SELECT seg_id, CASE WHEN (a / o < 0.5 OR a / o > 2.2) AND a / x BETWEEN 0.75 AND 1.5 THEN 'shifted' ELSE 'glued' END AS shape FROM l WHERE o >= 40 AND x >= 40 AND a >= 40
AND (((a / o < 0.5 OR a / o > 2.2) AND a / x BETWEEN 0.75 AND 1.5) OR (a / o >= 1.6 AND a / (o + x) BETWEEN 0.8 AND 1.25))"""
)
def misaligned_pairs(spark, sf_dir):
    return Q.misaligned(A.pairs(spark, sf_dir), "doc_id", "seg_pos").select("seg_id", "shape")


@query(with_("pairs") + "SELECT seg_id, 'Suspicious length for ' || seg_id AS warning FROM pairs WHERE length(target) > greatest(1000, 4 * length(source)) UNION ALL SELECT seg_id, 'Service boilerplate in ' || seg_id FROM pairs WHERE contains(target, 'As an AI')")
def soft_warnings(spark, sf_dir):
    return Q.soft_warnings(A.pairs(spark, sf_dir))


@query(_PAIRS.rstrip() + f",\n{_DEFECTS}\nSELECT seg_id, kind FROM d JOIN (SELECT seg_id AS i, s FROM n) ON i = seg_id WHERE kind = 'untranslated' OR (kind = 'length_ratio' AND length(s) >= 200 AND ratio < 0.55)")
def escalated_defects(spark, sf_dir):
    pairs = A.pairs(spark, sf_dir)
    found = Q.scan(pairs).select("seg_id", "kind").join(pairs.select("seg_id", F.trim(F.regexp_replace("source", r"\s+", " ")).alias("s"), F.trim(F.regexp_replace("target", r"\s+", " ")).alias("t")), "seg_id")
    return Q.escalated(found, F.col("s"), Q.length_ratio(F.col("s"), F.col("t"))).select("seg_id", "kind")


@query(with_("pairs") + "SELECT seg_id, (len(regexp_extract_all(source, '«')) - len(regexp_extract_all(source, '»')))::BIGINT AS imbalance, len(regexp_extract_all(source, '[A-Za-z]{3,}'))::BIGINT AS latin_runs FROM pairs")
def quote_and_latin_counts(spark, sf_dir):
    return A.pairs(spark, sf_dir).select("seg_id", Q.quote_imbalance("source").cast("bigint").alias("imbalance"), Q.latin_runs("source").cast("bigint").alias("latin_runs"))


@query()
def adjacent_repetitions(spark, sf_dir):
    return A.segments(spark, sf_dir).select("seg_id", Q.adjacent_repetitions("text").alias("repetitions")).where("repetitions > 0")


@query()
def repair_review(spark, sf_dir):
    """Every reply taken as a repair of its question: why it is refused, null if it isn't."""
    return A.pairs(spark, sf_dir).select("seg_id", Q.repair_rejection(F.col("source"), F.col("target"), F.col("source")).alias("rejection"))


_FINDINGS = """f AS (SELECT event_id AS seg_id, event_type IN ('error', 'signup') AS flagged, event_type = 'error' AS unresolved, event_id % 3 AS rejected_issues, CASE WHEN event_id % 50 = 0 THEN 'invalid_issues' END AS audit_error FROM events)"""


@query(f"WITH {_FINDINGS} SELECT count(*)::BIGINT AS audited, count(*) FILTER (flagged)::BIGINT AS flagged, count(*) FILTER (flagged AND NOT unresolved)::BIGINT AS repaired, count(*) FILTER (unresolved)::BIGINT AS remaining, count(audit_error)::BIGINT AS audit_errors, sum(rejected_issues)::BIGINT AS rejected_issues FROM f")
def quality_report(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").selectExpr("event_id as seg_id", "event_type in ('error', 'signup') as flagged", "event_type = 'error' as unresolved", "event_id % 3 as rejected_issues", "case when event_id % 50 = 0 then 'invalid_issues' end as audit_error")
    return Q.quality_report(rows)


@query(_PAIRS.rstrip() + f",\n{_ALL}\nSELECT seg_id, bool_or(kind <> 'missing_numbers') AS hard FROM k GROUP BY seg_id")
def hard_defects(spark, sf_dir):
    return Q.has_hard_defect(Q.scan(A.pairs(spark, sf_dir)), "seg_id")


@query("""SELECT conv_id, turn, lag(text) OVER w AS ctx_before, lead(text) OVER w AS ctx_after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY turn % 2 = 1""")
def segment_neighbours(spark, sf_dir):
    rows = Q.with_neighbours(A.table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return rows.where("turn % 2 = 1").select("conv_id", "turn", "ctx_before", "ctx_after")


@query(
    """WITH a AS (SELECT o_custkey AS batch_id, o_orderpriority AS seg_id, count(*) AS n, min(o_orderkey) AS k FROM orders GROUP BY ALL), e AS (SELECT DISTINCT o_custkey AS batch_id, p AS seg_id FROM orders, (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS p))
SELECT e.batch_id, e.seg_id, CASE WHEN n = 1 AND k % 2 = 0 THEN 's' || k END AS span, CASE WHEN n = 1 AND k % 2 = 0 THEN NULL ELSE 'invalid_issues' END AS audit_error FROM e LEFT JOIN a USING (batch_id, seg_id)"""
)
def critic_answers(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderpriority").alias("seg_id"), "o_orderkey")
    issues = F.when(F.col("o_orderkey") % 2 == 0, F.format_string('[{"span":"s%d","type":"x","severity":"high","reason":"r"}]', "o_orderkey")).otherwise("nothing")
    priorities = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    expected = orders.select("batch_id").distinct().select("batch_id", F.explode(priorities).alias("seg_id"))
    found = Q.critic_answers(orders.withColumn("issues", issues), expected)
    return found.select("batch_id", "seg_id", F.col("issues")[0]["span"].alias("span"), "audit_error")


@query("SELECT doc_id, (2 - CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END - CASE WHEN contains(text, lang) THEN 1 ELSE 0 END)::INTEGER AS rejected_issues FROM documents")
def validated_findings(spark, sf_dir):
    rows = A.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("edited"), F.array(F.struct(F.lit("the").alias("span")), F.struct(F.col("lang").alias("span"))).alias("issues"))
    return Q.validated(rows).select("doc_id", "rejected_issues")


@query(
    """WITH c AS (SELECT user_id AS seg_id, list('c' || event_id ORDER BY event_id) AS a FROM events WHERE event_type = 'error' GROUP BY 1), s AS (SELECT user_id AS seg_id, list('s' || event_id ORDER BY event_id) AS b FROM events WHERE event_type = 'signup' AND event_id % 5 = 0 GROUP BY 1)
SELECT coalesce(c.seg_id, s.seg_id) AS seg_id, array_to_string(list_concat(coalesce(a, []), coalesce(b, [])), ',') AS issues FROM c FULL JOIN s ON c.seg_id = s.seg_id"""
)
def merged_findings(spark, sf_dir):
    def issues(kind: str, where: str):
        rows = A.table(spark, sf_dir, "events").where(where).groupBy(F.col("user_id").alias("seg_id"))
        return rows.agg(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: F.concat(F.lit(kind), x)).alias("issues"))

    found = Q.merged_findings(issues("c", "event_type = 'error'"), issues("s", "event_type = 'signup' and event_id % 5 = 0"))
    return found.select("seg_id", F.array_join("issues", ",").alias("issues"))


@query("SELECT o_orderkey AS seg_id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN 'repaired ' || o_orderkey ELSE 'edited ' || o_orderkey END AS text FROM orders")
def repaired_segments(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders")
    edited = orders.select(F.col("o_orderkey").alias("seg_id"), F.concat(F.lit("edited "), "o_orderkey").alias("text"))
    repairs = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("seg_id"), F.concat(F.lit("repaired "), "o_orderkey").alias("text"), F.when(F.col("o_orderkey") % 3 == 0, "empty repair").alias("rejection"))
    return Q.repaired(edited, repairs)
