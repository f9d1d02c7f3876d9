"""Queries that write files of the engine's formats and read them back, and on texts inside documents."""

from pyspark.sql import functions as F

from .. import models as M
from ..functions import text as X
from ..operators import entities as E
from ..operators import journal as J
from ..operators import quality as Q
from ..operators import typography as T
from ..sources import adapters as A
from ..sources import epub, journal, localize, repair, scratch, workspace
from ..sources.adapters import table, with_
from ..streaming import events as S
from .registry import query


@query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 10 <> 3")
def journal_round_trip(spark, sf_dir):
    """Orders as a journal in which every tenth line is torn; blank and torn lines are skipped."""
    path = scratch.folder(spark, "journal")
    k = F.col("o_orderkey")
    line = F.to_json(F.struct(k.alias("k"), F.col("o_totalprice").alias("v")))
    table(spark, sf_dir, "orders").select(F.when(k % 10 == 3, F.concat(F.substring(line, 1, 8), F.lit("\n"))).otherwise(line).alias("value")).write.text(path)
    return journal.read_journal(spark, path, "k bigint, v double")


@query("SELECT o_orderkey AS reservation_id, o_custkey AS delegation_id, o_totalprice::DECIMAL(18,2) AS amount FROM orders")
def ledger_round_trip(spark, sf_dir):
    path = scratch.folder(spark, "ledger")
    journal.append(A.ledger(spark, sf_dir)[0], path)
    return journal.read_ledger(spark, path, "reservation_id bigint, delegation_id bigint, amount decimal(18,2)")


@query("SELECT 'j' || n_nationkey AS id, n_name AS updated_at FROM nation WHERE n_nationkey % 4 <> 1")
def job_folders(spark, sf_dir):
    """A folder a nation, with a job.json that every fourth time doesn't parse."""
    path, k = scratch.folder(spark, "jobs"), F.col("n_nationkey")
    body = F.when(k % 4 == 1, "{broken").otherwise(F.to_json(F.struct(F.concat(F.lit("j"), k).alias("id"), F.col("n_name").alias("updated_at"))))
    table(spark, sf_dir, "nation").select(k.alias("job"), body.alias("value")).repartition("job").write.partitionBy("job").text(f"{path}/raw")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for r in table(spark, sf_dir, "nation").select("n_nationkey").collect():  # 25 rows: files get the name that readers look for
        source = hadoop.Path(f"{path}/raw/job={r.n_nationkey}")
        files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        part = next(f.getPath() for f in files.listStatus(source) if f.getPath().getName().startswith("part-"))
        files.mkdirs(hadoop.Path(f"{path}/jobs/j{r.n_nationkey}"))
        files.rename(part, hadoop.Path(f"{path}/jobs/j{r.n_nationkey}/job.json"))
    return journal.read_jobs(spark, f"{path}/jobs", "id string, updated_at string")


@query("SELECT r_name AS title, r_regionkey AS n FROM region WHERE r_regionkey = 2")
def json_report(spark, sf_dir):
    path = scratch.folder(spark, "report")
    journal.append(table(spark, sf_dir, "region").where("r_regionkey = 2").select(F.col("r_name").alias("title"), F.col("r_regionkey").alias("n")), path)
    return journal.read_report(spark, path, "title string, n bigint")


_BOOKS = 20


def _books(spark, sf_dir):
    """Pages as books: mimetype, container, package and the pages."""
    k = F.col("page_id") % _BOOKS
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("book-"), k).alias("archive"), F.concat(F.lit("OEBPS/"), F.col("page_id"), F.lit(".xhtml")).alias("name"), "page_id", F.coalesce("html", F.lit("")).cast("binary").alias("data"))
    item = F.format_string('<item id="p%d" href="%d.xhtml" media-type="application/xhtml+xml"/>', "page_id", "page_id")
    books = pages.groupBy("archive").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items"), F.array_join(F.array_sort(F.collect_list(F.format_string('<itemref idref="p%d"/>', "page_id"))), "").alias("refs"))
    package = F.concat(F.lit('<package xmlns:dc="d"><metadata><dc:title>T '), "archive", F.lit("</dc:title><dc:language>en</dc:language></metadata><manifest>"), "items", F.lit("</manifest><spine>"), "refs", F.lit('<itemref idref="none"/></spine></package>'))
    fixed = F.array(F.struct(F.lit("mimetype").alias("name"), F.lit("application/epub+zip").alias("data")), F.struct(F.lit("META-INF/container.xml").alias("name"), F.lit('<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>').alias("data")), F.struct(F.lit("OEBPS/c.opf").alias("name"), package.alias("data")))
    heads = books.select("archive", F.explode(fixed).alias("f")).select("archive", "f.name", F.col("f.data").cast("binary").alias("data"))
    path = scratch.folder(spark, "books")
    built = epub.build(heads.unionByName(pages.select("archive", "name", "data")))
    built.write.parquet(path)
    return spark.read.parquet(path)


@query(f"SELECT 'book-' || (page_id % {_BOOKS}) AS archive, 'OEBPS/' || page_id || '.xhtml' AS name, octet_length(encode(coalesce(html, '')))::BIGINT AS expanded FROM pages")
def epub_entries(spark, sf_dir):
    """The entries of built books, read back from their directories."""
    return epub.directory(_books(spark, sf_dir)).where("name like '%.xhtml'").select("archive", "name", "expanded")


@query(f"""WITH b AS (SELECT 'book-' || (page_id % {_BOOKS}) AS archive, count(*) AS n FROM pages GROUP BY 1) SELECT archive, 'OEBPS/c.opf' AS package_path, 'T ' || archive AS title, 'en' AS language, n::BIGINT AS items, n + 1 AS refs FROM b""")
def epub_packages(spark, sf_dir):
    found = epub.packages(epub.files(_books(spark, sf_dir)))
    return found.select("archive", "package_path", "title", "language", F.size("manifest").cast("bigint").alias("items"), F.size("spine").cast("bigint").alias("refs"))


@query(f"SELECT DISTINCT 'book-' || (page_id % {_BOOKS}) AS archive, 'spine item not in manifest: none' AS fault FROM pages")
def epub_faults(spark, sf_dir):
    files = epub.files(_books(spark, sf_dir))
    return epub.validation(epub.packages(files), files.where("name = 'mimetype'").select("archive", F.col("data").cast("string").alias("mimetype")))


@query("""SELECT 'c' || c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN '<html><body><p> Hello <b>' || c_name || '</b><code>x</code></p></body></html>' ELSE '<html><body><p> Guten Tag <b>' || lower(c_name) || '</b><code>x</code></p></body></html>' END AS xml,
  CASE WHEN c_custkey % 5 = 0 THEN 'source changed: c' || c_custkey || ':1' END AS error FROM customer""")
def reinserted_texts(spark, sf_dir):
    doc = F.concat(F.lit("c"), "c_custkey")
    rows = table(spark, sf_dir, "customer").select(doc.alias("doc_id"), "c_custkey", "c_name")
    documents = rows.select("doc_id", F.concat(F.lit("<html><body><p> Hello <b>"), "c_name", F.lit("</b><code>x</code></p></body></html>")).alias("xml"))
    first = rows.select("doc_id", F.concat("doc_id", F.lit(":0")).alias("seg_id"), F.sha2(F.lit(" Hello "), 256).alias("source_hash"), F.lit(" Guten Tag ").alias("text"))
    second = rows.select("doc_id", F.concat("doc_id", F.lit(":1")).alias("seg_id"), F.sha2(F.when(F.col("c_custkey") % 5 == 0, "other").otherwise(F.col("c_name")), 256).alias("source_hash"), F.lower("c_name").alias("text"))
    return repair.reinserted(documents, first.unionByName(second))


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN '<div><p class="a">x' || c_custkey || '</p><ul><li>y</li></ul><p class="a">z</p></div>' ELSE '<div><p class="a">x' || c_custkey || '<b>y</b></p></div>' END AS xml, (c_custkey % 2 = 0)::INTEGER AS parted FROM customer""")
def paragraph_nesting(spark, sf_dir):
    k = F.col("c_custkey")
    xml = F.concat(F.lit('<div><p class="a">x'), k, F.when(k % 2 == 0, "<ul><li>y</li></ul>z").otherwise("<b>y</b>"), F.lit("</p></div>"))
    return repair.without_nesting(table(spark, sf_dir, "customer").select(k.alias("doc_id"), xml.alias("xml")))


@query("""WITH f AS (SELECT p_size AS archive, 'a b/' || p_name || CASE WHEN p_partkey % 3 = 0 THEN '__' ELSE '' END || '&.x' AS name FROM part GROUP BY ALL),
r AS (SELECT *, regexp_replace(regexp_replace(name, '[^\\p{L}\\p{N}._/-]+', '_', 'g'), '_+', '_', 'g') AS renamed FROM f)
SELECT archive, name, renamed, count(*) OVER (PARTITION BY archive, renamed) > 1 AS clash FROM r""")
def entry_renames(spark, sf_dir):
    name = F.concat(F.lit("a b/"), "p_name", F.when(F.col("p_partkey") % 3 == 0, "__").otherwise(""), F.lit("&.x"))
    return repair.renames(table(spark, sf_dir, "part").select(F.col("p_size").alias("archive"), name.alias("name")).distinct())


@query("SELECT 'Hello ' || c_name || '!' AS html, 'c' || c_custkey AS id FROM customer")
def flattened_ruby(spark, sf_dir):
    text = F.concat(F.lit("Hello <ruby>"), "c_name", F.lit("<rp>(</rp><rt>reading</rt><rp>)</rp></ruby>!"))
    return epub.with_flattened_ruby(table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), text.alias("html"))).select("id", "html")


@query("""SELECT c_custkey AS id, '<html lang="ru" xml:lang="ru"><link rel="' || CASE WHEN c_custkey % 2 = 0 THEN 'alternate stylesheet' ELSE 'stylesheet' END || '" class="' || CASE WHEN c_custkey % 2 = 0 THEN 'vertical' ELSE 'horizontal' END || '"/><p class="a hltr" lang="ru">' || c_name || '</p></html>' AS xml, 5 AS changes FROM customer""")
def translated_pages(spark, sf_dir):
    """Pages of a vertical book: language and direction."""
    even = F.col("c_custkey") % 2 == 0
    link = F.when(even, '<link rel="stylesheet" class="vertical"/>').otherwise('<link rel="alternate stylesheet" class="horizontal"/>')
    xml = F.concat(F.lit('<html lang="ja">'), link, F.lit('<p class="a '), F.when(even, "vrtl").otherwise("vltr"), F.lit('" lang="ja">'), "c_name", F.lit("</p></html>"))
    return localize.changed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), xml.alias("xml")), lambda d: localize.content_language(d, "ru"), localize.content_direction)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '<package version="3.0" xml:lang="ru"><metadata><language>ru</language><meta property="dcterms:modified">2026-01-02</meta><meta name="generator" content="g"/></metadata><spine page-progression-direction="ltr"/></package>'
  ELSE '<package version="2.0"><metadata><language>ru</language><meta name="generator" content="g"/></metadata><spine/></package>' END AS xml, CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 2 END AS changes FROM customer""")
def translated_packages(spark, sf_dir):
    third = F.lit('<package version="3.0"><metadata><language>ja</language></metadata><spine page-progression-direction="rtl"/></package>')
    second = F.lit('<package version="2.0"><metadata><language>ja</language><meta name="generator" content="x"/></metadata><spine/></package>')
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, third).otherwise(second).alias("xml"))
    return localize.changed(rows, lambda d: localize.package_language(d, "ru", "2026-01-02", "g"), localize.package_direction)


@query("SELECT 'o' || o_custkey AS slug, count(*)::BIGINT AS lines FROM orders WHERE o_custkey < 40 GROUP BY 1")
def workspace_export(spark, sf_dir):
    """Chapters of orders written as a workspace and counted again, without their headings."""
    path = scratch.folder(spark, "workspace")
    chapters = table(spark, sf_dir, "orders").where("o_custkey < 40").groupBy(F.concat(F.lit("o"), "o_custkey").alias("slug")).agg(F.array_join(F.collect_list(F.concat(F.lit("order "), "o_orderkey")), "\n").alias("text"))
    workspace.export(chapters.withColumn("title", F.col("slug")), path)
    return spark.read.text(path).where("value like 'order %'").groupBy("slug").agg(F.count("*").alias("lines"))


@query("SELECT p_partkey, lower(p_name) AS source FROM part WHERE p_partkey % 3 = 1 AND p_size % 2 = 0 AND lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey % 3 = 0)")
def imported_glossary(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    langs = (F.lit("en").alias("source_language"), F.lit("ru").alias("target_language"))
    own = part.where("p_partkey % 3 = 0").select(*langs, F.upper("p_name").alias("source"))
    other = part.where("p_partkey % 3 = 1").select("p_partkey", *langs, F.lower("p_name").alias("source"), F.when(F.col("p_size") % 2 == 0, "person").otherwise("term").alias("category"))
    return journal.imported_glossary(own, other, named_only=True).select("p_partkey", "source")


# -- scalar rules over constructed texts


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'latin' WHEN 1 THEN 'cyrillic' WHEN 2 THEN 'cjk' WHEN 3 THEN 'none' ELSE 'none' END AS script, CASE o_orderkey % 5 WHEN 2 THEN 3 ELSE 1 END AS expansion, o_orderkey % 5 = 2 AS untouched FROM orders""")
def scripts(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "Alice ran").when(k == 1, "Алиса бежала a").when(k == 2, "山嵐が来たと言った。赤シャツは何も答えなかったので、おれは黙って帰った。").when(k == 3, "абв abc").otherwise("12 !")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.dominant_script(text).alias("script"), X.expected_expansion(text).alias("expansion"), F.coalesce(Q.is_untouched_script(text, text), F.lit(False)).alias("untouched"))


@query("""SELECT o_orderkey::VARCHAR AS seg_id, CASE o_orderkey % 4 WHEN 0 THEN 'source_interference' WHEN 1 THEN 'source_residue' WHEN 2 THEN 'untranslated' END AS kind FROM orders WHERE o_orderkey % 4 < 3""")
def foreign_words(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    japanese = "山嵐が来たと言った。赤シャツは何も答えなかったので、おれは黙って帰った。"
    source = F.when(k == 2, japanese).otherwise("he bowed formally to her")
    target = F.when(k == 0, "он formally поклонился ей").when(k == 1, "он поклонился (formally) ей низко").when(k == 2, japanese + "と").otherwise("он церемонно поклонился ей")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("seg_id"), source.alias("source"), target.alias("target"))
    return Q.scan(rows, "ru").where("kind in ('source_interference', 'source_residue', 'untranslated')").select("seg_id", "kind")


@query("""SELECT o_orderkey, [true, false, true, false, false][o_orderkey % 5 + 1] AS safe, ['Элис', 'Нин', 'Дин', 'кот', 'Мармелад'][o_orderkey % 5 + 1] AS stem FROM orders""")
def safe_variants(spark, sf_dir):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    variant, canonical = pick("Элису", "Ниной", "Дина", "кот", "Мармелад"), pick("Алису", "Нина", "«Дина»", "котище", "Мармеладовский")
    return table(spark, sf_dir, "orders").select("o_orderkey", E.safe_variant(variant, canonical).alias("safe"), E.stem(variant).alias("stem"))


@query("SELECT o_orderkey, o_orderkey % 4 < 2 AS same, CASE WHEN o_orderkey % 3 = 0 THEN 'draft' ELSE 'edit ' || o_orderkey END AS text FROM orders")
def fallbacks(spark, sf_dir):
    """Work recovered only if its source is the same or was never fingerprinted; a blank edit leaves the draft."""
    k = F.col("o_orderkey")
    before = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "a").otherwise("b")
    edit = F.when(k % 3 == 0, F.when(k % 2 == 0, "  ")).otherwise(F.concat(F.lit("edit "), k))
    return table(spark, sf_dir, "orders").select("o_orderkey", J.may_recover(before, F.lit("a")).alias("same"), M.or_fallback(edit, F.lit("draft")).alias("text"))


@query("""SELECT o_orderkey, '{"mode":"editing","segments":["s' || o_orderkey || '"],"glossary":["' || o_orderstatus || '"]}' AS prompt FROM orders""")
def prompts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", M.prompt(F.lit("editing"), F.array(F.concat(F.lit("s"), "o_orderkey")), F.array("o_orderstatus")).alias("prompt"))


@query("""SELECT o_orderkey, [0, 1, 1, 0, 1][o_orderkey % 5 + 1]::INTEGER AS faults, [['кролика кролике'], [], []::VARCHAR[], [], ['кроликам кролика']][o_orderkey % 5 + 1] AS fragments, [1, 0, 0, 0, 1][o_orderkey % 5 + 1]::INTEGER AS repetitions FROM orders""")
def torn_texts(spark, sf_dir):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    text = pick("У «кролика кролике» было", "слово»", "«слово", "«a\n«b»", "кроликам кролика «")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.guillemet_faults(text).alias("faults"), T.duplicated_fragments(text).alias("fragments"), Q.adjacent_repetitions(text).alias("repetitions"))


@query(
    with_("segments")
    + """SELECT s.seg_id, s.text AS source, coalesce(t.text, '') AS target FROM segments s LEFT JOIN (SELECT seg_id, 't: ' || text AS text FROM segments WHERE seg_pos % 3 <> 0) t USING (seg_id)"""
)
def aligned_segments(spark, sf_dir):
    """Source segments with their translations by id; a missing one is empty."""
    segments = A.segments(spark, sf_dir).select("seg_id", "seg_pos", "text")
    return A.aligned(segments.select("seg_id", F.col("text").alias("source")), segments.where("seg_pos % 3 <> 0").select("seg_id", F.concat(F.lit("t: "), "text").alias("target")))


@query(with_("segments") + """, d AS (SELECT doc_id, 't: ' || text AS draft, row_number() OVER (PARTITION BY doc_id ORDER BY seg_pos) AS i FROM segments WHERE seg_pos % 2 = 0), o AS (SELECT doc_id, seg_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY seg_pos) AS i FROM segments)
SELECT seg_id, text AS original, draft FROM o JOIN d USING (doc_id, i)""")
def positional_drafts(spark, sf_dir):
    """Originals and drafts of a document by their place in it, as far as there are both."""
    segments = A.segments(spark, sf_dir)
    return A.by_position(segments.select("doc_id", "seg_pos", "seg_id", F.col("text").alias("original")), segments.where("seg_pos % 2 = 0").select("doc_id", "seg_pos", F.concat(F.lit("t: "), "text").alias("draft"))).select("seg_id", "original", "draft")


@query("SELECT o_orderkey AS seg_id, 's' || o_orderkey AS original, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 't' || o_orderkey END AS initial_translation, CASE WHEN o_orderstatus = 'F' THEN 'e' || o_orderkey ELSE '' END AS edited_translation FROM orders")
def audit_inputs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("seg_id", F.col("o_orderkey"))
    of = lambda p, where: orders.where(where).select("seg_id", F.concat(F.lit(p), "o_orderkey").alias("text"))
    return A.audit_inputs(of("s", "true"), of("t", "o_orderkey % 3 <> 0"), of("e", "o_orderstatus = 'F'"))


@query(with_("journal") + "SELECT o_orderkey AS seg_id, 's' || o_orderkey AS original, d.draft FROM orders LEFT JOIN (SELECT batch_id, arg_max('t' || payload, append_seq) AS draft FROM journal WHERE stage = 'translation' GROUP BY 1) d ON batch_id = o_orderkey")
def latest_drafts(spark, sf_dir):
    prepared = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seg_id"), F.concat(F.lit("s"), "o_orderkey").alias("original"))
    drafts = A.journal(spark, sf_dir).where("stage = 'translation'").select(F.col("batch_id").alias("seg_id"), "append_seq", F.concat(F.lit("t"), "payload").alias("text"))
    return A.latest_drafts(prepared, drafts)


@query("SELECT 'n' || n_nationkey AS id, n_name AS name, 'place' AS category FROM nation WHERE n_regionkey <> 3 UNION ALL SELECT 'r' || r_regionkey, 'late ' || r_name, 'person' FROM region WHERE r_regionkey <> 3")
def canon_entries(spark, sf_dir):
    """A JSON document a region, nested, with an id that comes twice and kinds that are none; one doesn't parse."""
    entry = lambda i, kind, name: F.struct(i.alias("id"), F.lit(kind).alias("type"), name.alias("name"))
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(entry(F.concat(F.lit("n"), "n_nationkey"), "location", F.col("n_name"))).alias("nations"))
    own = F.concat(F.lit("r"), "r_regionkey")
    rows = table(spark, sf_dir, "region").join(nations, "r_regionkey")
    body = F.to_json(F.struct(entry(own, "person", F.col("r_name")).alias("first"), F.struct(F.array(entry(own, "character", F.concat(F.lit("late "), "r_name"))).alias("more"), F.col("nations"), entry(F.lit("x"), "mood", F.lit("y")).alias("none")).alias("deep")))
    path = scratch.folder(spark, "canon")
    rows.select("r_regionkey", F.when(F.col("r_regionkey") == 3, F.lit("{")).otherwise(body).alias("value")).repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    return workspace.read_canon(spark, f"{path}/*/part-*")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, CASE event_type WHEN 'click' THEN 'translation' WHEN 'view' THEN 'editing' WHEN 'purchase' THEN 'audit' WHEN 'signup' THEN 'repair' ELSE 'consistency' END AS stage, sum(coalesce(CASE WHEN value >= 0 THEN floor(value * 10)::BIGINT + floor(value)::BIGINT END, 0))::BIGINT AS total_tokens FROM events GROUP BY 1, 2")
def usage_windows(spark, sf_dir):
    """The windowed stream's plan over the whole journal at once."""
    return S.windowed_usage(A.usage(spark, sf_dir)).select("start", "stage", "total_tokens")


@query("SELECT row_number() OVER (ORDER BY ts, 'job-' || user_id, event_type)::BIGINT AS id, 'job-' || user_id AS job_id, event_type AS type FROM events")
def numbered_events(spark, sf_dir):
    """Events as a stream into the numbered sink, read back."""
    path = scratch.folder(spark, "events")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("job-"), "user_id").alias("job_id"), F.col("event_type").alias("type"), F.col("ts").alias("timestamp"), F.lit("").alias("message"), F.lit("").alias("data"))
    journal.append(events, f"{path}/log")
    S.numbered_sink(S.replay(spark, f"{path}/log", after=None, schema=events.schema).drop("id"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("id bigint, job_id string, type string").json(f"{path}/out").select("id", "job_id", "type")
