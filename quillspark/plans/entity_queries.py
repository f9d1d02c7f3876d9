"""Queries on names, glossaries and chapters."""

from pyspark.sql import functions as F

from ..operators import entities as E
from ..sources import adapters as A
from ..sources.adapters import table, with_
from .registry import query

_P = "[\\p{L}\\p{M}''’]+"
_WORDS = f"""p AS (SELECT doc_id, seg_pos, regexp_extract_all(text, '{_P}|[^\\p{{L}}\\p{{M}}''’]+') AS l FROM segments),
x AS (SELECT doc_id, seg_pos, l, unnest(range(1, len(l) + 1)) AS i FROM p),
w AS (SELECT doc_id, seg_pos, i, l[i] AS word, lower(l[i]) AS key, i = 1 OR (i = 2 AND NOT regexp_matches(l[1], '[\\p{{L}}\\p{{M}}''’]')) OR regexp_matches(rtrim(l[i - 1]), '[.!?。！？]$') AS initial FROM x WHERE regexp_matches(l[i], '[\\p{{L}}\\p{{M}}''’]')),
cc AS (SELECT key, count(*) FILTER (word = key AND length(word) >= 3)::BIGINT AS common, count(*) FILTER (regexp_matches(word, '^\\p{{Lu}}\\p{{L}}{{2,}}') AND NOT initial)::BIGINT AS named FROM w GROUP BY key HAVING common + named > 0)"""
_STOP = ", ".join(f"'{w}'" for w in E.STOP_WORDS)
_EVIDENCE = _WORDS + f""",
c0 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(word, '[.-]+$', ''), '[''’](s|re|ve|ll|d|m)$', '', 'i'), '[.-]+$', '') AS source FROM w WHERE regexp_matches(word, '^\\p{{Lu}}\\p{{L}}{{2,}}')),
ev AS (SELECT lower(source) AS key, arg_min(source, (doc_id, seg_pos, i)) AS source, count(*)::BIGINT AS occurrences, count(*) FILTER (NOT initial)::BIGINT AS within FROM c0 WHERE source <> '' GROUP BY lower(source)),
e AS (SELECT ev.*, ev.key IN ({_STOP}) AS stop, coalesce(common, 0) > 0 AND NOT coalesce(named >= 5 AND named >= common * 4, false) AS noun FROM ev LEFT JOIN cc USING (key))"""


@query(with_("segments", rest=_WORDS) + "SELECT * FROM cc")
def word_case_counts(spark, sf_dir):
    return E.case_counts(E.words(A.segments(spark, sf_dir)))


@query(with_("segments", rest=_WORDS) + "SELECT * FROM cc WHERE named > 0 AND (common = 0 OR (named >= 5 AND named >= common * 4))")
def named_vs_common(spark, sf_dir):
    return E.names_rather_than_nouns(E.case_counts(E.words(A.segments(spark, sf_dir))))


@query(with_("segments", rest=_EVIDENCE) + "SELECT key, source, occurrences, within, stop, noun FROM e")
def entity_evidence(spark, sf_dir):
    return E.evidence(A.segments(spark, sf_dir))


@query(with_("segments", rest=_EVIDENCE) + "SELECT source, occurrences FROM e WHERE NOT stop AND NOT noun AND occurrences >= 2 AND within > 0 ORDER BY occurrences DESC, source LIMIT 250")
def top_entities(spark, sf_dir):
    return E.top_entities(E.evidence(A.segments(spark, sf_dir)))


_STRONG = "NOT stop AND NOT noun AND occurrences >= 2 AND within > 0"


@query(
    with_("segments", rest=_EVIDENCE)
    + f"""SELECT sum(CASE WHEN stop OR noun THEN occurrences ELSE 1 END)::BIGINT AS candidates, coalesce(sum(occurrences) FILTER (stop), 0)::BIGINT AS stop_words, coalesce(sum(occurrences) FILTER (NOT stop AND noun), 0)::BIGINT AS common_words,
  count(*) FILTER (NOT stop AND NOT noun AND NOT ({_STRONG}))::BIGINT AS weak, greatest(0, count(*) FILTER ({_STRONG}) - 250)::BIGINT AS overflow, least(250, count(*) FILTER ({_STRONG}))::BIGINT AS kept FROM e"""
)
def entity_stats(spark, sf_dir):
    return E.evidence_stats(E.evidence(A.segments(spark, sf_dir)))


@query()
def capitalised_phrases(spark, sf_dir):
    return E.phrases(A.segments(spark, sf_dir).select("doc_id", "seg_pos", "text")).groupBy("phrase").agg(F.count("*").alias("n"))


_OWN = "own AS (SELECT p_name AS source, upper(p_name) AS target FROM part WHERE p_partkey % 3 = 0), gen AS (SELECT upper(p_name) AS source, lower(p_name) AS target FROM part)"


@query(f"WITH {_OWN} SELECT * FROM own UNION ALL SELECT * FROM gen WHERE lower(source) NOT IN (SELECT lower(source) FROM own)")
def glossary_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    own = part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("source"), F.upper("p_name").alias("target"))
    return E.merged_glossary(own, part.select(F.upper("p_name").alias("source"), F.lower("p_name").alias("target")))


_TERMS = ("the", "of the", "license", "apache license", "der", "que")
_HITS = "h AS (" + " UNION ALL ".join(f"SELECT seg_id, '{t}' AS term, text FROM segments WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])')" for t in _TERMS) + ")"


def _terms(spark):
    return spark.createDataFrame([(t,) for t in _TERMS], "source string")


@query(with_("segments", rest=_HITS) + "SELECT seg_id, term FROM h")
def relevant_glossary(spark, sf_dir):
    return E.glossary_mentions(A.segments(spark, sf_dir).select("seg_id", "text"), _terms(spark)).select("seg_id", "term")


_ADHERE = "a AS (SELECT term, upper(term) AS translation, count(*)::BIGINT AS blocks, count(*) FILTER (list_bool_and(list_transform(string_split(term, ' '), lambda w: contains(lower(substr(text, 20)), substr(w, 1, greatest(3, length(w) - 2)::INTEGER)))))::BIGINT AS used FROM h GROUP BY term)"


def _adherence(spark, sf_dir):
    pairs = A.segments(spark, sf_dir).select("seg_id", F.col("text").alias("source"), F.expr("substring(text, 20)").alias("target"))
    return E.adherence(pairs, _terms(spark).select("source", F.upper("source").alias("target"), F.lit(True).alias("enabled")))


@query(with_("segments", rest=f"{_HITS},\n{_ADHERE}") + "SELECT *, round(used / blocks, 6) AS ratio FROM a")
def glossary_adherence(spark, sf_dir):
    return _adherence(spark, sf_dir)


@query(with_("segments", rest=f"{_HITS},\n{_ADHERE}") + "SELECT term, blocks, used FROM a WHERE blocks >= 3 AND used * 2 < blocks")
def adherence_warnings(spark, sf_dir):
    return E.adherence_warnings(_adherence(spark, sf_dir)).select("term", "blocks", "used")


@query(
    """WITH l AS (SELECT o_orderkey AS ord, CASE o_orderkey % 50 WHEN 0 THEN 'ncx' WHEN 1 THEN 'nav' ELSE 'text' END AS role, 'Chapter ' || (o_custkey % 300) AS label, 'T' || (o_orderkey % 3) AS target FROM orders),
g AS (SELECT label, arg_min(target, (CASE role WHEN 'ncx' THEN 0 WHEN 'nav' THEN 1 ELSE 2 END, ord)) AS authority FROM l GROUP BY label HAVING count(*) >= 2 AND count(*) FILTER (role <> 'text') > 0)
SELECT role, ord, label, target, authority FROM l JOIN g USING (label) WHERE target <> authority"""
)
def navigation_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("ord"), F.when(k % 50 == 0, "ncx").when(k % 50 == 1, "nav").otherwise("text").alias("role"), F.concat(F.lit(" Chapter  "), F.col("o_custkey") % 300).alias("source"), F.concat(F.lit("T"), k % 3).alias("target"))
    return E.navigation_labels(rows)


@query()
def composite_reconcile(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    single = part.select(F.explode(F.split("p_name", " ")).alias("source")).distinct().select("source", F.initcap("source").alias("target"))
    return E.composites(single.unionByName(part.select(F.col("p_name").alias("source"), F.concat(F.initcap("p_name"), F.lit("s")).alias("target")).distinct()))


@query(
    with_("segments")
    + """, n AS (SELECT word AS name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM segments) WHERE regexp_matches(word, '^[A-Z][a-z]{4,}$') GROUP BY 1 HAVING count(*) >= 2)
SELECT a.name, b.name AS other, a.n::BIGINT AS n, b.n::BIGINT AS m FROM n a JOIN n b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 2 WHERE levenshtein(a.name, b.name) <= 2"""
)
def near_name_pairs(spark, sf_dir):
    words = A.segments(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("name")).where(F.col("name").rlike("^[A-Z][a-z]{4,}$"))
    return E.near_pairs(words.groupBy("name").agg(F.count("*").alias("n")))


@query(
    with_("segments")
    + """, t AS (SELECT doc_id AS book, seg_pos AS ord, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM segments), l AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY book) AS n FROM t WHERE length(text) >= 200),
s AS (SELECT book, ord, substr(text, 1, 1200) AS text FROM l WHERE i % greatest(1, n // 12) = 0), b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY book ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT book, ord, text FROM b WHERE before < 6000"""
)
def style_passages(spark, sf_dir):
    return E.style_passages(A.segments(spark, sf_dir).select(F.col("doc_id").alias("book"), F.col("seg_pos").alias("ord"), "text"))


_CHAPTERS = "ch AS (SELECT doc_id, substr(string_agg(t, chr(10) ORDER BY seg_pos), 1, 24000) AS text FROM (SELECT doc_id, seg_pos, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM segments) WHERE t <> '' GROUP BY doc_id HAVING length(substr(string_agg(t, chr(10) ORDER BY seg_pos), 1, 24000)) >= 2000)"


@query(with_("segments", rest=_CHAPTERS) + "SELECT * FROM ch")
def chapter_texts(spark, sf_dir):
    return E.chapter_texts(A.segments(spark, sf_dir))


@query(with_("segments", rest=_CHAPTERS) + """, f AS (SELECT doc_id, substr(text, 30, 25) || CASE WHEN seg_pos % 2 = 0 THEN '' ELSE ' zzz' END AS evidence FROM segments WHERE length(text) >= 60)
SELECT doc_id, count(*) FILTER (ok)::BIGINT AS verified, count(*) FILTER (NOT ok)::BIGINT AS dropped FROM (SELECT f.doc_id, contains(trim(regexp_replace(regexp_replace(lower(text), '["''“”„«»‘’]', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g')), trim(regexp_replace(regexp_replace(lower(evidence), '["''“”„«»‘’]', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS ok FROM f JOIN ch USING (doc_id)) GROUP BY doc_id""")
def verified_facts(spark, sf_dir):
    segments = A.segments(spark, sf_dir)
    facts = segments.where("length(text) >= 60").select("doc_id", F.concat(F.substring("text", 30, 25), F.when(F.col("seg_pos") % 2 == 0, "").otherwise(" zzz")).alias("evidence"))
    return E.verified_facts(facts, E.chapter_texts(segments))


@query("SELECT n_nationkey AS doc_id, '- ' || n_name || CASE n_nationkey % 3 WHEN 0 THEN ' (female)' WHEN 1 THEN ' (male)' ELSE '' END || CASE WHEN n_nationkey % 2 = 0 THEN ': seen' ELSE '' END AS line FROM nation")
def card_lines(spark, sf_dir):
    k = F.col("n_nationkey")
    gender = F.when(k % 3 == 0, "female").when(k % 3 == 1, "male").otherwise("unknown")
    return E.card_lines(table(spark, sf_dir, "nation").select(k.alias("doc_id"), F.col("n_name").alias("name"), gender.alias("gender"), F.when(k % 2 == 0, "seen").otherwise("").alias("note")))


@query("WITH a AS (SELECT o_orderkey AS ord, o_orderpriority AS source, o_clerk AS target FROM (SELECT *, 'x' || o_custkey AS o_clerk FROM orders)) SELECT lower(source) AS key, arg_min(source, ord) AS source, arg_min(target, ord) AS target, 'generated-' || lower(source) AS id FROM a WHERE source <> '5-LOW' GROUP BY 1")
def generated_registry(spark, sf_dir):
    answers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("source"), F.concat(F.lit("x"), "o_custkey").alias("target"))
    return E.registry(answers, answers.where("source <> '5-LOW'").select("source"))


@query("""WITH w AS (SELECT p_partkey AS ord, p_name || p_partkey AS item, p_brand AS language, sha256(p_name || p_partkey || chr(10) || p_brand) AS key FROM part) SELECT key, ord, item, language, ((row_number() OVER (PARTITION BY language ORDER BY ord) - 1) // 25)::INTEGER AS chunk FROM w WHERE ord % 4 <> 0""")
def chunked_questions(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.concat("p_name", "p_partkey").alias("item"), F.col("p_brand").alias("language"))
    cache = wanted.where("ord % 4 = 0").select(F.sha2(F.concat_ws("\n", "item", "language"), 256).alias("key"))
    return E.to_ask(wanted, cache)


@query(with_("segments") + "SELECT seg_id, ((length(text) - length(replace(text, 'the', ''))) / 3)::BIGINT AS n FROM segments WHERE contains(text, 'the')")
def substring_counts(spark, sf_dir):
    return E.substring_counts(A.segments(spark, sf_dir), "the")


@query()
def replaced_terms(spark, sf_dir):
    out = E.replaced_terms(A.segments(spark, sf_dir).select("seg_id", "text"), {"apache license": "Apache-2.0", "license": "licence", "the": "THE"})
    return out.select("seg_id", "applied", F.sha2("replaced", 256).alias("hash")).where("applied > 0")
