"""Documents to segments, logical units and batches; archives, packages, redaction and projections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import base36, col, let

BATCH_CHARS, BATCH_SEGMENTS = 12_000, 20
#: Limits of an archive: entries, compressed bytes in all and each, expanded bytes in all.
LIMITS = {"entries": 10_000, "compressed": 100 << 20, "entry": 100 << 20, "expanded": 512 << 20}
METHODS = (0, 8)
DOCUMENTS = ("application/xhtml+xml", "text/html", "application/x-dtbncx+xml")
#: Inline elements that only look different; a run may continue into them. Fixed values.
PRESENTATIONAL = ("b", "cite", "del", "dfn", "em", "i", "ins", "mark", "s", "samp", "small", "strong", "u", "var")
_SENTENCE = r"(?<=[.!?])\s+|(?<=[。！？])(?![」』）】\s])"


def with_batches(segments: DataFrame, doc: str = "doc_id", order: str = "seg_pos", chars: int = BATCH_CHARS, most: int = BATCH_SEGMENTS, cut: bool = True) -> DataFrame:
    """Segments with batch_no, counted from 1 in each document: a batch is closed before a segment that would
    bring it above `chars` or `most`. A segment above `chars` is cut into chunks of whole sentences, a
    batch each, of which it has the first one's number; without `cut` it is a batch of its own as it is. Segments stream by in order with a few numbers of state, so a document
    may have any length; that state is bound to their order, so an Arrow function."""
    columns = [c for c in segments.columns if c != "batch_no"]
    big = F.length("text") > chars if cut else F.lit(False)
    rows = segments.select(*columns, F.length("text").alias("_n"), F.when(big, F.size(chunks(F.col("text"), chars))).otherwise(0).alias("_pieces"))
    schema = T.StructType([*segments.select(*columns).schema.fields, T.StructField("batch_no", T.IntegerType())])
    key = columns.index(doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, following, number, held, count = object(), 1, 0, 0, 0  # of the open batch: its number, characters, segments
        for batch in batches:
            out = []
            for d, n, pieces in zip(batch.column(key).to_pylist(), *(batch.column(batch.num_columns - i).to_pylist() for i in (2, 1))):
                if d != at:
                    at, following, number, held, count = d, 1, 0, 0, 0
                n = n or 0
                if count and (held + n > chars or count >= most):
                    held = count = 0
                if pieces:
                    out.append(following)
                    following += pieces
                    continue
                if not count:
                    number, following = following, following + 1
                out.append(number)
                held, count = held + n, count + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.int32())], [*columns, "batch_no"])

    return rows.repartition(doc).sortWithinPartitions(doc, order).mapInArrow(run, schema)


def chunks(text: Column, chars: int = BATCH_CHARS) -> Column:
    """Whole sentences packed into pieces of up to `chars`; a longer sentence is a piece of its own."""

    def add(a: Column, s: Column) -> Column:
        cjk = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
        glue = F.when(F.substring(a["cur"], -1, 1).rlike(cjk) | F.substring(s, 1, 1).rlike(cjk), "").otherwise(" ")
        full = (a["cur"] != "") & (F.length(a["cur"]) + F.length(s) + 1 > chars)
        return F.struct(F.when(full | (a["cur"] == ""), s).otherwise(F.concat(a["cur"], glue, s)).alias("cur"), F.when(full, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]).alias("out"))

    sentences = F.filter(F.split(text, _SENTENCE), lambda s: s != "")
    packed = F.aggregate(sentences, F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out")), add)
    return let(packed, lambda p: F.when(p["cur"] != "", F.concat(p["out"], F.array(p["cur"]))).otherwise(p["out"]))


def with_chunks(segments: DataFrame, chars: int = BATCH_CHARS) -> DataFrame:
    """One row per chunk; ids get #1, #2 ... where there are several."""
    rows = segments.withColumn("_c", F.when(F.length("text") > chars, chunks(F.col("text"), chars)).otherwise(F.array("text")))
    rest = [c for c in segments.columns if c not in ("seg_id", "text")]
    rows = rows.select(*rest, "seg_id", F.size("_c").alias("_n"), F.posexplode("_c").alias("_i", "text"))
    return rows.select(*rest, F.when(F.col("_n") > 1, F.concat("seg_id", F.lit("#"), (F.col("_i") + 1).cast("string"))).otherwise(F.col("seg_id")).alias("seg_id"), "text")


def remerged(rows: DataFrame) -> DataFrame:
    """Chunks back as segments: a blank goes between two unless white space stands there."""
    number = F.coalesce(F.nullif(F.regexp_extract("seg_id", r"#(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    parts = rows.groupBy(F.regexp_replace("seg_id", r"#\d+$", "").alias("seg_id")).agg(F.array_sort(F.collect_list(F.struct(number.alias("i"), "text"))).alias("p"))

    def add(a: Column, x: Column) -> Column:
        touching = (a == "") | a.rlike(r"\s$") | x["text"].rlike(r"^\s")
        return F.concat(a, F.when(touching, "").otherwise(" "), x["text"])

    return parts.select("seg_id", F.aggregate("p", F.lit(""), add).alias("text"))


def merges_into(extra: Column, base: Column) -> Column:
    """Whether a text of one inline format (">a>em") continues a run of another: the same, or only dressed up more."""
    added = F.split(F.substring(extra, F.length(base) + 2, F.length(extra)), ">")
    return (extra == base) | (extra.startswith(F.concat(base, F.lit(">"))) & F.forall(added, lambda x: x.isin(*PRESENTATIONAL)))


def logical_units(segments: DataFrame) -> DataFrame:
    """Runs of a block whose formats continue the run's first one, joined to units; others start anew.

    segments: doc_id, block, seg_pos, seg_id, text, format. Returns doc_id, seg_id (the first's), members, text.
    """
    item = F.struct("seg_pos", "seg_id", "text", "format")
    rows = segments.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(item)).alias("l"))
    unit = "struct<id:string,format:string,members:int,text:string>"

    def add(a: Column, x: Column) -> Column:
        seam = a["cur"]["text"].rlike(r"(?U)\s$") | x["text"].rlike(r"(?U)^\s") | ~x["text"].rlike(r"^[\p{L}\p{N}(\[{«“„¿¡#$£€]")
        more = a["cur"].isNotNull() & merges_into(x["format"], a["cur"]["format"])
        longer = F.struct(a["cur"]["id"].alias("id"), a["cur"]["format"].alias("format"), (a["cur"]["members"] + 1).cast("int").alias("members"), F.concat(a["cur"]["text"], F.when(seam, "").otherwise(" "), x["text"]).alias("text"))
        fresh = F.struct(x["seg_id"].alias("id"), x["format"].alias("format"), F.lit(1).alias("members"), x["text"].alias("text"))
        return F.struct(F.when(more, longer).otherwise(fresh).cast(unit).alias("cur"), F.when(more | a["cur"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))).alias("out"))

    state = F.struct(F.lit(None).cast(unit).alias("cur"), F.array().cast(f"array<{unit}>").alias("out"))
    folded = F.aggregate("l", state, add, lambda a: F.concat(a["out"], F.array(a["cur"])))
    return rows.select("doc_id", "block", F.explode(folded).alias("u")).select("doc_id", F.col("u.id").alias("seg_id"), F.col("u.members").alias("members"), F.col("u.text").alias("text"))


def entry_name_error(name: Column) -> Column:
    """Why an archive entry's name is refused; null if it is safe."""
    parts = F.filter(F.split(name, "/"), lambda x: (x != "") & (x != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, x: let(a["d"] + F.when(x == "..", -1).otherwise(1), lambda d: F.struct(d.cast("int").alias("d"), F.least(a["low"], d).cast("int").alias("low"))))
    return F.when(name == "", "empty name").when(F.contains(name, F.lit("\\")) | F.contains(name, F.lit("\0")), "forbidden character").when(name.startswith("/") | name.rlike("^[A-Za-z]:"), "absolute path").when((depth["low"] < 0) | (depth["d"] < 1), "path escapes the archive")


def archive_violations(entries: DataFrame) -> DataFrame:
    """The first entry of each archive, in its order, that breaks a limit, and why."""
    w = Window.partitionBy("archive").orderBy("ordinal")
    rows = entries.select("*", F.row_number().over(w).alias("i"), F.sum("compressed").over(w).alias("c"), F.sum("expanded").over(w).alias("e"), F.row_number().over(Window.partitionBy("archive", "name").orderBy("ordinal")).alias("again"))
    reason = (
        F.when(F.col("i") > LIMITS["entries"], "too many entries")
        .when(F.col("again") > 1, "duplicate entry")
        .when(F.col("encrypted"), "encrypted entry")
        .when(~F.col("method").isin(*METHODS), "unsupported method")
        .when(F.col("expanded") > LIMITS["entry"], "entry too large")
        .when(F.col("c") > LIMITS["compressed"], "archive too large")
        .when(F.col("e") > LIMITS["expanded"], "expanded archive too large")
    )
    bad = rows.withColumn("reason", reason).where("reason is not null")
    return bad.groupBy("archive").agg(F.min("ordinal").alias("ordinal"), F.min_by("reason", "ordinal").alias("reason"))


def resource_path_error(path: Column) -> Column:
    """Why a path inside a package is refused; null if it is safe."""
    plain = F.try_url_decode(path)
    return (
        F.when(path != F.trim(path), "padded path")
        .when(path.rlike(r"[\\\x00?#]") | path.rlike("(?i)%2f|%5c"), "forbidden character")
        .when(plain.isNull() | plain.rlike(r"[\\\x00]") | plain.rlike("(?i)%2f|%5c"), "forbidden character")
        .when(plain.startswith("/") | plain.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "absolute path")
        .otherwise(entry_name_error(plain))
    )


def spine_documents(spine: DataFrame, manifest: DataFrame, navigation: DataFrame) -> DataFrame:
    """spine: book, position, idref; manifest: book, id, href, media_type; navigation: book, id.

    Documents to read: the spine in order, then navigation documents that it lacks; only readable types, but
    each item takes its number.
    """
    extra = navigation.join(spine.select("book", F.col("idref").alias("id")), ["book", "id"], "left_anti")
    last = spine.groupBy("book").agg((F.max("position") + 1).alias("n"))
    after = extra.join(last, "book", "left").select("book", (F.coalesce("n", F.lit(0)) + F.row_number().over(Window.partitionBy("book").orderBy("id")) - 1).cast("bigint").alias("position"), F.col("id").alias("idref"))
    rows = spine.select("book", F.col("position").cast("bigint").alias("position"), "idref").unionByName(after)
    found = rows.join(manifest.withColumnRenamed("id", "idref"), ["book", "idref"]).where(F.col("media_type").isin(*DOCUMENTS))
    return found.select("book", F.concat(F.lit("document-"), F.col("position") + 1).alias("doc_id"), "href")


def epubcheck_counts(lines: DataFrame) -> DataFrame:
    """lines: job_id, line. Messages by level; a summary line overrides what was counted."""
    level = F.regexp_extract("line", r"^(FATAL|ERROR|WARNING|INFO)(?:\([^)]*\))?:", 1)
    summary = lambda word: F.nullif(F.regexp_extract("line", rf"(?i)(\d+) {word}", 1), F.lit("")).cast("int")
    is_summary = F.col("line").rlike(r"(?i)^messages: ")
    out = lines.groupBy("job_id").agg(*(F.coalesce(F.max(F.when(is_summary, summary(w))), F.sum((level == n).cast("int"))).cast("bigint").alias(n.lower()) for n, w in (("FATAL", "fatal"), ("ERROR", "error"), ("WARNING", "warn"), ("INFO", "info"))))
    return out


def epubcheck_messages(lines: DataFrame, most: int = 250) -> DataFrame:
    """lines: job_id, ord, line. The first `most` messages of each job: level, code, message, and how many more there are."""
    pattern = r"(?i)^(FATAL|ERROR|WARNING|INFO)(?:\(([^)]+)\))?:\s*(.+)$"
    part = lambda i: F.regexp_extract(F.trim("line"), pattern, i)
    rows = lines.where(F.trim("line").rlike(pattern)).select("job_id", "ord", F.lower(part(1)).alias("level"), F.nullif(part(2), F.lit("")).alias("code"), part(3).alias("message"))
    total = rows.groupBy("job_id").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("omitted"))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("job_id").orderBy("ord"))).where(F.col("_r") <= most).drop("_r")
    return first.join(total, "job_id")


def scenes(lines: DataFrame) -> DataFrame:
    """lines: doc_id, pos, text. Paragraphs of a Markdown manuscript as XHTML with the scene they stand in; s0 before the
    first marker <!-- scene: id -->. Blank lines part paragraphs, line ends within one stay."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    marker = F.nullif(F.regexp_extract("text", r"^[ \t]*<!--\s*scene:\s*(\S+?)\s*-->[ \t]*$", 1), F.lit(""))
    rows = lines.withColumn("scene", F.coalesce(F.last(marker, True).over(w), F.lit("s0"))).withColumn("marker", marker).where("marker is null")
    rows = rows.withColumn("par", F.sum((F.trim("text") == "").cast("int")).over(w)).where(F.trim("text") != "")
    out = rows.groupBy("doc_id", "scene", "par").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return out.select("doc_id", "scene", "par", inline_markdown("text").alias("html"))


def inline_markdown(c: Column | str) -> Column:
    """A paragraph of Markdown: one line after #s is a heading, else a paragraph; strong, em, line breaks."""
    text = col(c)
    hashes = F.length(F.regexp_extract(text, r"^(#{1,6})\s+.*$", 1))
    body = F.when(hashes > 0, F.regexp_replace(text, r"^#{1,6}\s+", "")).otherwise(text)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        body = F.replace(body, F.lit(sign), F.lit(entity))
    body = F.regexp_replace(body, r"\*\*([^*\n]+?)\*\*", "<strong>$1</strong>")
    body = F.replace(F.regexp_replace(body, r"\*([^*\n]+?)\*", "<em>$1</em>"), F.lit("\n"), F.lit("<br/>"))
    tag = F.when(hashes > 0, F.concat(F.lit("h"), hashes)).otherwise("p")
    return F.concat(F.lit("<"), tag, F.lit(">"), body, F.lit("</"), tag, F.lit(">"))


def latin_fonts(families: Column, japanese: tuple[str, ...] = ("mincho", "gothic", "ryumin", "hiragino", "meiryo", "yu ", "kaku")) -> Column:
    """A font stack without Japanese families; a generic one if none is left."""
    kept = F.filter(F.transform(F.split(families, ","), lambda x: F.trim(x)), lambda x: ~F.lower(x).rlike("|".join(japanese)) & (x != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise("serif")


def safe_jobs(jobs: DataFrame) -> DataFrame:
    """What of a job may leave the server; keys never do, only whether there is one."""
    return jobs.select("id", "title", "status", (F.col("api_key").isNotNull() & (F.col("api_key") != "")).alias("has_api_key"))


def segment_ids(doc: Column, position: Column) -> Column:
    return F.concat(doc, F.lit(":"), base36(position))
