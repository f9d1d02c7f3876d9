"""Queries on the consistency of a translated book, its findings, its run's warnings and its calls."""

from pyspark.sql import functions as F

from .. import models as M
from ..functions import text as X
from ..operators import consistency as C
from ..operators import journal as J
from ..operators import quality as Q
from ..operators import typography as T
from ..sources import adapters as A
from ..sources.adapters import table, with_
from .registry import query

#: A glossary for the driver's texts: ordinal, source, target, enabled.
_GLOSSARY = ((0, "the", "der", True), (1, "license", "Lizenz", True), (2, "apache license", "", None), (3, "que", "qué", False), (4, "", " ", True), (5, "der", None, True))
_BOUND = lambda t: f"(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])"
_ON = [(i, t) for i, s, g, on in _GLOSSARY if on is not False for t in (s, g) if t and t.strip()]
_FLAT = "s AS (SELECT doc_id, seg_id, lower(regexp_replace(text, '[\\s]+', ' ', 'g')) AS t, text FROM segments)"


def _glossary(spark):
    return spark.createDataFrame(_GLOSSARY, "ordinal int, source string, target string, enabled boolean")


@query(with_("segments", rest=_FLAT) + " UNION ".join([f"SELECT doc_id, {i} AS ordinal FROM s WHERE regexp_matches(lower(text), '{_BOUND(t.lower())}')" for i, t in _ON] + ["SELECT doc_id, 4 FROM s"]))
def batch_glossary(spark, sf_dir):
    return C.relevant_glossary(A.segments(spark, sf_dir), _glossary(spark))


_DECIDED = ("the", "apache license", "der")


@query(with_("segments", rest=_FLAT) + " UNION ALL ".join(f"SELECT seg_id, '{t}' AS term FROM s WHERE regexp_matches(t, '{_BOUND(t)}')" for t in _DECIDED))
def decision_segments(spark, sf_dir):
    terms = spark.createDataFrame([(t,) for t in _DECIDED], "term string")
    return C.decision_segments(A.segments(spark, sf_dir).select("seg_id", "text"), terms).select("seg_id", "term")


#: form, name, category; known entities: source, occurrences.
_CANON = (("license", "Licence", "work"), ("the", "the", "person"), ("der", "der", "person"), ("Lorem", "Lorem", "place"), ("house", "house", "place"))


@query(
    with_("segments", rest="w AS (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS w FROM segments)")
    + "SELECT 'Lorem' AS source, 3::BIGINT AS occurrences, 'place' AS category_hint, NULL AS same_as"
    + "".join(
        f" UNION ALL SELECT '{f}', count(*)::BIGINT, '{c}', {'NULL' if f == n else repr(n)} FROM w WHERE regexp_matches(w, '^({f}{'|' + f[:-1] + '[\\p{L}]{0,3}' if len(f) > 3 else ''})$') HAVING count(*) > 0"
        for f, n, c in _CANON
        if f != "Lorem"
    )
)
def canon_names(spark, sf_dir):
    canon = spark.createDataFrame(_CANON, "form string, name string, category string")
    return C.canon_names(A.segments(spark, sf_dir), canon, spark.createDataFrame([("Lorem", 3)], "source string, occurrences long"))


@query("""WITH g AS (SELECT lower(n_name) AS k, arg_min('t' || n_nationkey, n_nationkey) AS expected_target FROM nation WHERE n_nationkey % 5 <> 4 GROUP BY 1)
SELECT c_custkey, n_name AS source, expected_target, 'r' || r_regionkey AS reading FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN g ON lower(n_name) = k LEFT JOIN region ON r_name = n_name""")
def expected_targets(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    entities = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("source"))  # 25 rows
    glossary = nation.select(F.col("n_nationkey").alias("ordinal"), F.upper("n_name").alias("source"), F.concat(F.lit("t"), "n_nationkey").alias("target"), (F.col("n_nationkey") % 5 != 4).alias("enabled"))
    readings = table(spark, sf_dir, "region").select(F.col("r_name").alias("term"), F.concat(F.lit("r"), "r_regionkey").alias("reading"))
    return C.with_readings(C.with_expected_targets(entities, glossary), readings)


_PLACES = "(Street|St\\.|Avenue|Ave\\.|Road|Rd\\.|Lane|Square|Place)"


@query(f"""WITH c AS (SELECT c_custkey, c_custkey % 3 = 0 AS street, 'Met ' || c_name || CASE c_custkey % 3 WHEN 0 THEN ' in Baker' || chr(97 + (c_custkey % 26)::INTEGER) || ' Street.' WHEN 1 THEN ' on a street.' ELSE ' of the Queen of Hearts' END AS text FROM customer)
SELECT c_custkey, regexp_extract(text, '(\\p{{Lu}}[\\p{{L}}\\p{{M}}]+) {_PLACES}', 0) AS place FROM c WHERE street""")
def place_names(spark, sf_dir):
    k = F.col("c_custkey")
    tail = F.when(k % 3 == 0, F.concat(F.lit(" in Baker"), F.char(97 + k % 26), F.lit(" Street."))).when(k % 3 == 1, " on a street.").otherwise(" of the Queen of Hearts")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k).alias("doc_id"), k.cast("int").alias("seg_pos"), F.concat(F.lit("Met "), "c_name", tail).alias("text"))
    return C.name_streams(rows).where("high").select(F.col("seg_pos").cast("bigint").alias("c_custkey"), F.col("source").alias("place"))


@query()
def entity_streams(spark, sf_dir):
    """Mentions of every candidate by all streams, over all documents."""
    rows = C.name_streams(A.segments(spark, sf_dir)).groupBy(F.lower("source").alias("key"))
    return rows.agg(F.count("*").alias("mentions"), F.sum(F.col("within").cast("bigint")).alias("within"), F.sum(F.col("isolated").cast("bigint")).alias("isolated"), F.bool_or("high").alias("high"))


@query()
def entity_report(spark, sf_dir):
    return C.entity_report(A.segments(spark, sf_dir))


def _book(spark, sf_dir):
    """Orders as a book: a clerk's name in the source, its rendering in the target, every seventh one misspelt."""
    orders = table(spark, sf_dir, "orders")
    k, who = F.col("o_orderkey"), F.col("o_custkey") % 4
    name = F.element_at(F.array(*map(F.lit, ("Alice", "Hatter", "Dormouse", "Nobody"))), (who + 1).cast("int"))
    right = F.element_at(F.array(*map(F.lit, ("Алиса", "Шляпник", "Соня", "Никто"))), (who + 1).cast("int"))
    wrong = F.element_at(F.array(*map(F.lit, ("Алесу", "Шлепник", "Соня", "Никто"))), (who + 1).cast("int"))
    ids = (F.concat(F.lit("document-"), F.col("o_custkey")).alias("doc_id"), k.cast("int").alias("seg_pos"), F.concat(F.lit("s"), k).alias("seg_id"))
    source = orders.select(*ids, F.concat(F.lit("There "), name, F.lit(" came again")).alias("text"))
    target = orders.select(*ids, F.concat(F.lit("Вот "), F.when(k % 7 == 0, wrong).when(k % 7 == 1, F.when(who == 0, "Алису").otherwise(right)).otherwise(right), F.lit(" снова тут")).alias("text"))
    return source, target


_BOOK = """b AS (SELECT o_orderkey AS k, o_custkey % 4 AS who FROM orders)"""


@query(f"""WITH {_BOOK} SELECT 's' || k AS seg_id, 'Вот ' || CASE WHEN k % 7 = 0 THEN ['Алису', 'Шляпник', 'Соня', 'Никто'][who + 1] WHEN k % 7 = 1 AND who = 0 THEN 'Алису' ELSE ['Алиса', 'Шляпник', 'Соня', 'Никто'][who + 1] END || ' снова тут' AS text,
  (k % 7 = 0 AND who < 2)::INTEGER AS applied FROM b""")
def aligned_glossary(spark, sf_dir):
    source, target = _book(spark, sf_dir)
    glossary = spark.createDataFrame([(0, "alice", "Алиса", True), (1, "Hatter", "Шляпник", True), (2, "Nobody", "Никто", False)], "ordinal int, source string, target string, enabled boolean")
    return C.replaced(target, C.glossary_replacements(source, target, glossary)).select("seg_id", "text", "applied")


@query(f"""WITH {_BOOK} SELECT 's' || k AS seg_id, 'Вот ' || CASE WHEN who = 1 THEN 'Шлюпник' WHEN k % 7 = 0 THEN ['Алесу', '', 'Соня', 'Никто'][who + 1] WHEN k % 7 = 1 AND who = 0 THEN 'Алису' ELSE ['Алиса', '', 'Соня', 'Никто'][who + 1] END || ' снова тут' AS text, (who = 1)::INTEGER AS applied FROM b""")
def applied_decisions(spark, sf_dir):
    source, target = _book(spark, sf_dir)
    # a canonical of another decision, another word's rendering and a form the book lacks are not replaced
    decisions = spark.createDataFrame([(0, "Hatter", "Шлюпник", ["Шляпник", "Шлепник", "Соня"]), (1, "Dormouse", "Соня", ["Никто", "Сонь"]), (2, "Nobody", "Никто", ["Никто"])], "ord int, source string, canonical string, variants array<string>")
    return C.replaced(target, C.decided_replacements(source, target, decisions)).select("seg_id", "text", "applied")


@query(f"""WITH {_BOOK} SELECT 's' || k AS seg_id, 'Вот ' || CASE WHEN k % 7 = 0 THEN ['Алису', 'Шляпник', 'Соня', 'Никто'][who + 1] WHEN k % 7 = 1 AND who = 0 THEN 'Алису' ELSE ['Алиса', 'Шляпник', 'Соня', 'Никто'][who + 1] END || ' снова тут' AS text,
  0 AS first_mechanics, (k % 7 = 0 AND who = 1)::INTEGER AS decided, (k % 7 = 0 AND who = 0)::INTEGER AS aligned, 0 AS labelled, 0 AS last_mechanics FROM b""")
def consistency_pass(spark, sf_dir):
    source, target = _book(spark, sf_dir)
    glossary = spark.createDataFrame([(0, "alice", "Алиса", True)], "ordinal int, source string, target string, enabled boolean")
    decisions = spark.createDataFrame([(0, "Hatter", "Шляпник", ["Шлепник"])], "ord int, source string, canonical string, variants array<string>")
    none = spark.createDataFrame([], "doc_id string, role string")
    return C.consistency_pass(source, target, glossary, decisions, none, "ru-RU")["texts"].drop("doc_id", "seg_pos")


@query()
def consistency_report(spark, sf_dir):
    """Entities of all documents with their expected targets, under a Russian glossary."""
    segments = A.segments(spark, sf_dir)
    return C.report(segments, segments, _glossary(spark), "ru")[0]


@query()
def consistency_diagnostics(spark, sf_dir):
    return C.capabilities("ru")["diagnose"](A.segments(spark, sf_dir))


_VALUES = {1: "перв", 2: "двух", 12: "двенадцать", 21: "двадцать одна", 40: "сорок", 100: "сто", 342: "трёхсот сорок двух", 1000: "тысяча", 5017: "пять тысяч семнадцать", 120000: "120 тысяч", 3000000: "3 миллиона"}


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS written FROM orders")
def written_numbers(spark, sf_dir):
    n = (F.col("o_orderkey") % len(_VALUES)).cast("int")
    value = F.element_at(F.array(*(F.lit(str(v)) for v in _VALUES)), n + 1)
    text = F.when(F.col("o_orderkey") % 2 == 0, F.element_at(F.array(*map(F.lit, _VALUES.values())), n + 1)).otherwise("ничего такого")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.written_out(value, text).alias("written"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN (c_custkey % 90) || '° 15′' WHEN 1 THEN (c_custkey % 90) || '°15''' ELSE (c_custkey % 90) || ' ° 15 ′' END AS value, (c_custkey % 90) || '° 15′' AS canonical, c_custkey % 3 = 0 AS is_canonical FROM customer""")
def coordinates(spark, sf_dir):
    k = F.col("c_custkey")
    d = (k % 90).cast("string")
    text = F.concat(F.lit("at "), F.when(k % 3 == 0, F.concat(d, F.lit("° 15′"))).when(k % 3 == 1, F.concat(d, F.lit("°15'"))).otherwise(F.concat(d, F.lit(" ° 15 ′"))), F.lit(" N"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(T.coordinates(text)).alias("x")).select("c_custkey", "x.*")


@query("SELECT c_nationkey AS doc_id, 'оксфо' AS stem FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey % 2) = 2")
def street_conventions(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 2 == 0, "На Оксфорд-стрит").otherwise("У улицы Оксфордской")
    return T.street_conventions(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), text.alias("text")))


@query()
def name_clusters(spark, sf_dir):
    """Near spellings among capitalised words within sentences, of all documents of a source."""
    texts = table(spark, sf_dir, "documents").select("source", "text")
    return T.name_clusters(T.names_within(texts, "source", r"[A-Z][a-z]{2,}", ()), "source")


@query("""WITH t AS (SELECT c_nationkey AS book, c_custkey AS doc_id FROM customer)
SELECT book, doc_id || ': 1 straight double quote(s)' AS warning FROM t WHERE doc_id % 4 = 1 UNION ALL SELECT book, doc_id || ': unbalanced guillemets' FROM t WHERE doc_id % 4 = 2
UNION ALL SELECT DISTINCT book, 'non-canonical coordinates' FROM t WHERE doc_id % 4 = 3""")
def language_audit(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, "«слово»").when(k % 4 == 1, 'сло"во').when(k % 4 == 2, "«слово").otherwise("на 5°15' юга")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("book"), k.alias("doc_id"), text.alias("text"))
    return C.capabilities("ru-RU")["audit"](rows)


_REASONS = ("Wrong tense.", "This is borderline.", "Перевод в данном сегменте верен", "Quote stands outside the quotes", "Missing negation", "Отсутствует слово «кот»")


@query("SELECT o_orderkey, o_orderkey % 6 = 0 OR (o_orderkey % 6 = 3 AND o_orderkey % 2 = 0) OR (o_orderkey % 6 = 5 AND o_orderkey % 4 <> 1) AS actionable FROM orders")
def actionable_findings(spark, sf_dir):
    k = F.col("o_orderkey")
    reason = F.element_at(F.array(*map(F.lit, _REASONS)), (k % 6 + 1).cast("int"))
    span = F.when(k % 6 == 3, F.when(k % 2 == 0, "слово»,").otherwise("слово.»")).when(k % 6 == 5, F.when(k % 4 == 1, "Кот пришёл").otherwise("Пёс пришёл")).otherwise("a span")
    issue = F.struct(span.alias("span"), F.lit("style").alias("type"), F.lit("high").alias("severity"), reason.alias("reason"))
    return table(spark, sf_dir, "orders").select("o_orderkey", Q.actionable(issue, F.lit("He did not go."), F.lit("Он пошёл.")).alias("actionable"))


_EV = "SELECT user_id % 50 AS run_id, event_id, event_type, user_id FROM events"


@query(
    f"""WITH e AS ({_EV}), p AS (SELECT run_id, count(*) FILTER (event_type = 'click') * 2 AS a, count(*) FILTER (event_type = 'error' AND event_id % 2 = 0) AS b, count(*) FILTER (event_type = 'signup') AS c,
  count(DISTINCT user_id) FILTER (event_type = 'view' AND event_id % 3 <> 0) AS d, count(DISTINCT (user_id, event_id % 4)) FILTER (event_type = 'purchase') AS f, count(*) FILTER (event_id % 5 = 0) AS g FROM e GROUP BY 1)
SELECT run_id, (a + b + c + d + f + g)::BIGINT AS warnings FROM p WHERE a + b + c + d + f + g > 0"""
)
def run_warnings(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("run_id"), "event_id", "event_type", "user_id")
    of = lambda kind: e.where(F.col("event_type") == kind)
    return Q.run_warnings(
        of("click").select("run_id", F.lit(2).alias("warnings")), of("error").select("run_id", F.when(F.col("event_id") % 2 == 0, "invalid_issues").alias("audit_error")), of("signup").select("run_id"),
        of("view").select("run_id", F.col("user_id").alias("seg_id"), F.when(F.col("event_id") % 3 == 0, "source_residue").otherwise("empty").alias("kind")),
        of("purchase").select("run_id", F.col("user_id").alias("batch_id"), (F.col("event_id") % 4).alias("seg_id")), e.where("event_id % 5 = 0").select("run_id", F.lit(1).alias("warnings")),
    )


@query("""SELECT o_orderkey AS seg_id, CASE WHEN o_orderkey % 3 = 0 THEN 'same' WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'old' ELSE 'new' END AS text, o_orderkey % 3 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0) AS reverted FROM orders""")
def verified_repairs(spark, sf_dir):
    k = F.col("seg_id")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seg_id"))
    before = orders.withColumn("text", F.when(k % 3 == 0, "same").otherwise("old"))
    after = orders.withColumn("text", F.when(k % 3 == 0, "same").otherwise("new"))
    issues = orders.withColumn("severity", F.when(k % 5 == 0, "high").otherwise("low"))
    defects = orders.withColumn("kind", F.when(k % 7 == 0, "untranslated").otherwise("length_ratio"))
    return Q.verified_repairs(before, after, issues, defects)


@query("""WITH b AS (SELECT o_orderkey AS k FROM orders), s AS (SELECT count(*) AS n, count(*) FILTER (k % 4 = 0) AS changed, count(*) FILTER (k % 4 IN (1, 2)) AS rejected, count(*) FILTER (k % 4 = 3) AS failed FROM b WHERE k % 2 = 0 OR k % 3 = 0)
SELECT n::BIGINT AS attempted, changed::BIGINT AS changed, rejected::BIGINT AS rejected, failed::BIGINT AS failed FROM s""")
def interference_repair(spark, sf_dir):
    k = F.col("o_orderkey")
    inside = (k % 2 == 0) | (k % 3 == 0)
    pairs = table(spark, sf_dir, "orders").select(k.cast("string").alias("seg_id"), F.col("o_custkey").alias("doc_id"), k.alias("seg_pos"), F.lit("he bowed formally to her").alias("source"), F.when(inside, "он formally поклонился ей").otherwise("он церемонно поклонился ей").alias("target"))

    def repair(rows):
        n = F.col("seg_id").cast("bigint") % 4
        text = F.when(n == 0, "он церемонно поклонился ей").when(n == 1, "").otherwise(F.col("target"))
        return rows.where(n < 3).select("seg_id", text.alias("text"))

    return Q.interference_repair(pairs, repair, "ru")[1]


@query("""SELECT 'call-' || event_id AS call_id, CASE WHEN event_type <> 'error' THEN 'ok' ELSE ['timeout', 'invalid_response', 'error'][event_id % 3 + 1] END AS outcome, CASE WHEN event_type = 'error' THEN ['it timed out', 'token=[redacted]', 'no'][event_id % 3 + 1] END AS detail,
  CASE WHEN event_id % 4 > 0 THEN event_id END::BIGINT AS prompt_tokens, CASE WHEN event_id % 4 > 0 OR event_id % 5 > 0 THEN (CASE WHEN event_id % 4 > 0 THEN event_id ELSE 0 END) + (CASE WHEN event_id % 5 > 0 THEN event_id % 5 ELSE 0 END) END::BIGINT AS total_tokens FROM events""")
def usage_records(spark, sf_dir):
    k, wrong = F.col("event_id"), F.col("event_type") == "error"
    pick = lambda *x: F.when(wrong, F.element_at(F.array(*map(F.lit, x)), (k % 3 + 1).cast("int")))
    calls = table(spark, sf_dir, "events").select(
        F.concat(F.lit("call-"), k).alias("call_id"), F.lit("r").alias("run_id"), F.lit("editing").alias("mode"), F.array(F.lit("s0")).alias("segments"), F.lit("p").alias("profile"), F.lit("e").alias("endpoint"), F.lit("m").alias("model"),
        F.when(k % 4 > 0, k).otherwise(-1.5).alias("prompt_tokens"), F.lit(None).cast("double").alias("cached_prompt_tokens"), F.when(k % 5 > 0, k % 5).alias("completion_tokens"),
        pick("temporary", "invalid_response", "fatal").alias("kind"), pick("it timed out", "token: abc", "no").alias("message"),
    )
    return M.usage_records(calls).select("call_id", "outcome", "detail", "prompt_tokens", "total_tokens")


@query("""SELECT c_custkey, 'sha256:' || sha256('{"id":' || c_custkey || ',"segment":"' || c_mktsegment || '"}') AS hash FROM customer""")
def delegation_hashes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", J.delegation_hash(("segment", F.col("c_mktsegment")), ("revoked_at", F.col("c_name")), ("id", F.col("c_custkey")), ("none", F.lit(None).cast("string"))).alias("hash"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE 'v' || o_orderkey END AS v FROM orders")
def tolerant_answers(spark, sf_dir):
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"v":"v'), k, F.lit('"}'))
    text = F.when(k % 4 == 0, body).when(k % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone"))).when(k % 4 == 2, F.concat(F.lit("The answer is "), body, F.lit(" as asked"))).otherwise("nothing")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.tolerant_json(text, "v string")["v"].alias("v"))


@query("SELECT o_orderkey, 'z' || o_orderkey AS a, 'y' AS b FROM orders")
def last_map_entries(spark, sf_dir):
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    made = X.last_wins(F.array(entry("a", F.lit("x")), entry("b", F.lit("y")), entry("a", F.concat(F.lit("z"), "o_orderkey"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", made["a"].alias("a"), made["b"].alias("b"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 60)::DOUBLE WHEN 1 THEN 90.0 WHEN 2 THEN 0.0 END AS seconds FROM orders")
def retry_after(spark, sf_dir):
    k = F.col("o_orderkey")
    value = F.when(k % 4 == 0, (k % 60).cast("string")).when(k % 4 == 1, "Wed, 21 Oct 2026 07:29:30 GMT").when(k % 4 == 2, "Wed, 21 Oct 2020 07:28:00 GMT").otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.retry_after_seconds(value, F.lit("2026-10-21 07:28:00").cast("timestamp")).alias("seconds"))
