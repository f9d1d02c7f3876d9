"""Consistency of a translated book: names and terms of its source, the renderings in its target, and their repair.

source and target segments: doc_id, seg_pos, seg_id, text. Terms are found in place: a segment's words meet the
terms by their first word, and the whole term is verified on the same row, so no text is shuffled for it.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clipped, collapsed, escaped, occurrences
from ..sources.scratch import kept
from . import entities as E
from . import typography as T

#: Names, and replacements, up to which their table is broadcast; counted, not guessed.
TERMS = E.TERMS
#: A rendering is a competing one if it has a 50th of the canonical's uses.
SHARE = 50
#: Patterns of names that need no second mention. Fixed values.
PLACE = r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}\p{M}'’-]{2,}\s+(?:Street|St\.|Avenue|Ave\.|Road|Rd\.|Lane|Square|Place)(?![\p{L}\p{N}])"
NAME = r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}\p{M}'’.-]{2,}"
JAPANESE_NAME = r"\p{Han}{2,4}|[\p{Katakana}ー]{2,}"
JAPANESE_HONORIFIC = r"[\p{Han}\p{Katakana}ー]{2,6}(?=さん|さま|様|ちゃん|くん|君|氏|先生|博士|教授|大佐|中佐|少佐|大尉|中尉|少尉|大将|中将|少将|元帥|夫人|伯爵|男爵|子爵|侯爵|公爵)"
JAPANESE_PLACE = r"[\p{Han}\p{Katakana}ー]{1,5}(?:神社|神宮|寺院|寺|城|邸|町|村|市|区|県|府|駅|山|川|島|橋|坂|通り|大学|学校|病院|銀行|新聞社|会社)"
CAPITALISED = r"(?<![\p{L}\p{N}])(\p{Lu}[\p{L}\p{M}'’-]{2,})"
LOWERCASE = r"(?<![\p{L}\p{N}])(\p{Ll}[\p{L}\p{M}'’-]{2,})"


def term_hits(segments: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Rows of segments with each of terms(term, ...) that they hold as a whole word, in any case."""
    return E.glossary_mentions(segments, terms.withColumnRenamed("term", "source"), text)


def relevant_glossary(segments: DataFrame, glossary: DataFrame, batch: str = "doc_id") -> DataFrame:
    """(batch, ordinal) of glossary entries (ordinal, source, target, enabled) that a batch can use: enabled, and with the
    source or the target in one of its texts. An entry that has neither term can't be judged and goes to every batch."""
    on = glossary.where("enabled is null or enabled")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    terms = on.select("ordinal", F.explode(F.array("source", "target")).alias("term")).where(~blank(F.col("term")))
    found = term_hits(segments.select(batch, "text"), terms).select(batch, "ordinal")
    always = on.where(blank(F.col("source")) & blank(F.col("target"))).agg(F.collect_set("ordinal").alias("o"))
    bare = segments.select(batch).distinct().join(F.broadcast(always)).select(batch, F.explode("o").alias("ordinal"))  # one row
    return found.unionByName(bare).distinct()


def decision_segments(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """segments, white space collapsed, with each of decisions(term, ...) whose source they name."""
    return term_hits(segments.withColumn("text", F.regexp_replace("text", r"(?U)\s+", " ")), decisions)


def canon_names(segments: DataFrame, canon: DataFrame, known: DataFrame) -> DataFrame:
    """canon: form, name, category; known: source, occurrences. Known entities with the hints of their form, then
    forms that the texts hold, inflected by up to three letters if they have four, and how often."""
    hints = canon.select(F.lower("form").alias("_k"), "category", F.when(F.col("form") != F.col("name"), F.col("name")).alias("same_as"))
    hints = hints.groupBy("_k").agg(F.first("category").alias("category_hint"), F.first("same_as").alias("same_as"))
    old = known.join(hints, F.lower("source") == F.col("_k"), "left").select("source", "occurrences", "category_hint", "same_as")
    new = canon.join(known.select(F.lower("source").alias("_k")), F.lower("form") == F.col("_k"), "left_anti")
    stem = F.when(F.length("form") >= 4, F.concat(escaped(F.expr("substring(form, 1, length(form) - 1)")), F.lit(r"\p{L}{0,3}"))).otherwise(escaped("form"))
    new = new.withColumn("_p", F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), escaped("form"), F.lit("|"), stem, F.lit(r")(?![\p{L}\p{N}])")))
    # a form and its inflections share the first letters of a word
    first = lambda c: F.substring(c, F.lit(1), F.lit(3))
    keyed = new.withColumn("_f", first(F.regexp_extract("form", r"([\p{L}\p{N}]+)", 1)))
    if keyed.limit(TERMS + 1).count() <= TERMS:
        keyed = F.broadcast(keyed)
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), 1), first))
    rows = segments.select("text", F.explode(words).alias("_w")).join(keyed, F.col("_w") == F.col("_f"))
    counted = rows.groupBy("form", "name", "category").agg(F.sum(F.regexp_count("text", F.col("_p"))).cast("bigint").alias("occurrences")).where("occurrences > 0")
    added = counted.select(F.col("form").alias("source"), "occurrences", F.col("category").alias("category_hint"), F.when(F.col("form") != F.col("name"), F.col("name")).alias("same_as"))
    return old.unionByName(added)


def with_expected_targets(entities: DataFrame, glossary: DataFrame) -> DataFrame:
    """entities(source, ...) with expected_target, that of the first enabled entry of the source, in any case."""
    first = glossary.where("enabled").groupBy(F.lower("source").alias("_k")).agg(F.min_by("target", "ordinal").alias("expected_target"))
    return entities.join(first, F.lower("source") == F.col("_k"), "left").drop("_k")


def with_readings(entities: DataFrame, readings: DataFrame) -> DataFrame:
    """entities with the reading that the book itself gives them, from readings(term, reading)."""
    return entities.join(readings.select(F.col("term").alias("_t"), "reading"), F.col("source") == F.col("_t"), "left").drop("_t")


def name_streams(segments: DataFrame, stop: tuple[str, ...] = E.STOP_WORDS) -> DataFrame:
    """Candidates of segments(doc_id, seg_pos, text): source, i, high (certain by its form), within (not at the start of a
    sentence), isolated (all the text is). Streams: places, phrases, names, Japanese titles, places and names."""
    of = lambda p: regex.compile(p)
    streams = ((of(PLACE), True), (of(NAME), False), (of(JAPANESE_HONORIFIC), True), (of(JAPANESE_PLACE), True), (of(JAPANESE_NAME), False))
    noise = of(r"[\s\"'«»„“”()\[\].,:;!?—-]")

    def found(text: str) -> list[tuple[int, str, bool]]:
        return [(m.start(), m[0], high) for pattern, high in streams for m in pattern.finditer(text)] + [(at, value, False) for at, value in E.phrases_of(text, stop)]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, pos, text in zip(*(c.to_pylist() for c in batch.columns)):
                for n, (at, value, high) in enumerate(found(text or "")):
                    source = regex.sub(r"[.-]+$", "", regex.sub(r"(?i)['’](?:s|re|ve|ll|d|m)$", "", regex.sub(r"[.-]+$", "", value)))
                    before = text[:at].rstrip()[-1:]
                    alone = not noise.sub("", text[:at] + text[at + len(value) :])
                    rows.append((doc, pos, n, " ".join(source.split()), high, bool(before) and before not in ".!?。！？", alone, text))
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*rows)] or [()] * len(names), kinds)], names)

    SCHEMA = "doc_id string, seg_pos int, i int, source string, high boolean, within boolean, isolated boolean, text string"
    return segments.select("doc_id", F.col("seg_pos").cast("int"), "text").mapInArrow(run, SCHEMA).where("source <> ''")


def entity_report(sources: DataFrame, stop: tuple[str, ...] = E.STOP_WORDS, n: int = E.KEPT) -> DataFrame:
    """The n entities of most mentions: source, occurrences, contexts (the first texts they stand in).

    Single words that are rather nouns are none; others need two mentions, one within a sentence or alone in its text,
    or a form that is certain.
    """
    rows = name_streams(sources, stop).withColumn("key", F.lower("source")).where(~F.col("key").isin(*stop))
    counts = E.case_counts(E.words(sources)).select(F.col("key").alias("k"), "common", "named")
    noun = (F.coalesce("common", F.lit(0)) > 0) & ~((F.col("named") >= E.MENTIONS) & (F.col("named") >= F.col("common") * E.OVER_NOUN))
    order = F.struct("doc_id", "seg_pos", "i")
    total = rows.groupBy("key").agg(F.min_by("source", order).alias("source"), F.count("*").alias("occurrences"), F.sum(F.col("within").cast("int")).alias("w"), F.sum(F.col("isolated").cast("int")).alias("a"), F.bool_or("high").alias("high"))
    total = total.join(counts, F.col("key") == F.col("k"), "left").where(F.contains("key", F.lit(" ")) | ~noun)
    strong = total.where(F.col("high") | ((F.col("occurrences") >= 2) & ((F.col("w") > 0) | (F.col("a") > 0))))
    best = strong.orderBy(F.desc("occurrences"), "source").limit(n).select("key", "source", "occurrences")
    place = F.row_number().over(Window.partitionBy("key").orderBy("doc_id", "seg_pos", "i"))
    near = rows.join(F.broadcast(best.select(F.col("key").alias("k"))), F.col("key") == F.col("k")).withColumn("_r", place).where(F.col("_r") <= E.CONTEXTS)  # n rows
    contexts = near.groupBy(F.col("key").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", clipped(collapsed("text")).alias("t")))), lambda x: x["t"]).alias("contexts"))
    return best.join(contexts, F.col("key") == F.col("k")).select("source", "occurrences", "contexts")


def _evidence(sources: DataFrame, targets: DataFrame, terms: DataFrame) -> DataFrame:
    """terms(term, ...) with `target`, each text whose source names the term."""
    return decision_segments(sources.select("seg_id", "text"), terms).drop("text").join(targets.select("seg_id", F.col("text").alias("target")), "seg_id")


def decided_replacements(sources: DataFrame, targets: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: ord, source, canonical, variants. (variant, canonical) to replace: variants that are a spelling of their
    canonical, stand in a text whose source names the entity, and are no entity's canonical; the first decision wins.
    Other forms of a replaced word's stem follow it with their own endings."""
    canonicals = decisions.select(F.col("canonical").alias("_c")).distinct()
    each = decisions.select("ord", F.col("source").alias("term"), "canonical", F.posexplode("variants").alias("i", "variant"))
    each = each.where(E.safe_variant(F.col("variant"), F.col("canonical"))).join(canonicals, F.col("variant") == F.col("_c"), "left_anti")
    seen = _evidence(sources, targets, each).where(F.contains("target", F.col("variant")))
    direct = seen.groupBy("variant").agg(F.min_by("canonical", F.struct("ord", "i")).alias("canonical"), F.min("ord").alias("ord"))
    single = direct.where(~F.col("variant").rlike(r"\s") & ~F.col("canonical").rlike(r"\s")).select(E.stem("variant").alias("vs"), E.stem("canonical").alias("cs"), "variant", "ord").where("vs <> variant and vs <> cs")
    observed = targets.select(F.explode(F.regexp_extract_all("text", F.lit(CAPITALISED), 1)).alias("word")).distinct().withColumn("_s", E.stem("word"))
    forms = observed.join(single, F.col("_s") == F.col("vs")).join(canonicals, F.col("word") == F.col("_c"), "left_anti")
    forms = forms.join(direct.select(F.col("variant").alias("_v")), F.col("word") == F.col("_v"), "left_anti")
    forms = forms.groupBy("word").agg(F.min_by(F.concat("cs", F.expr("substring(word, length(vs) + 1)")), "ord").alias("canonical"))
    return direct.select("variant", "canonical").unionByName(forms.select(F.col("word").alias("variant"), "canonical"))


def glossary_replacements(sources: DataFrame, targets: DataFrame, glossary: DataFrame) -> DataFrame:
    """glossary: ordinal, source, target, enabled. (variant, canonical): words that stand for an entry's one-word target
    in texts whose source names it, nearly spelt alike, and used as often as a competing spelling would be.

    A word is none if it is ordinary (also seen in lower case) or another entry's; what it becomes must stand in the book.
    """
    entries = glossary.where("enabled").select("ordinal", F.col("source").alias("term"), F.trim("target").alias("canonical"))
    entries = entries.where(F.col("canonical").rlike(r"^\p{Lu}[\p{L}\p{M}'’-]+$")).withColumn("cs", E.stem("canonical")).withColumn("ck", F.lower("cs"))
    words = lambda p: F.regexp_extract_all("text", F.lit(p), 1)
    ordinary = targets.select(F.explode(words(LOWERCASE)).alias("w")).select(F.lower(E.stem(F.lower("w"))).alias("_o")).distinct()
    attested = targets.select(F.explode(words(CAPITALISED)).alias("_a")).distinct()
    texts = _evidence(sources, targets, entries.where(F.length("cs") >= 4))
    uses = texts.groupBy("ordinal", "canonical", "cs", "ck").agg(F.sum(occurrences(F.lower("target"), "ck")).alias("canonical_uses")).where("canonical_uses > 0")
    seen = texts.select("ordinal", F.explode(F.array_distinct(F.regexp_extract_all("target", F.lit(CAPITALISED), 1))).alias("word")).distinct()
    pairs = seen.join(uses, "ordinal").withColumn("ws", E.stem("word")).withColumn("wk", F.lower("ws"))
    alike = (F.substring("wk", 1, 1) == F.substring("ck", 1, 1)) & (F.abs(F.length("ws") - F.length("cs")) <= 1) & (F.levenshtein("wk", "ck") <= 2)
    pairs = pairs.where((F.col("wk") != F.col("ck")) & alike).join(ordinary, F.col("wk") == F.col("_o"), "left_anti").join(entries.select(F.col("ck").alias("_e")).distinct(), F.col("wk") == F.col("_e"), "left_anti")
    often = texts.select("ordinal", "target").join(pairs.select("ordinal", "word", "wk", "cs", "ws", "canonical_uses"), "ordinal")
    often = often.groupBy("ordinal", "word", "cs", "ws", "canonical_uses").agg(F.sum(occurrences(F.lower("target"), "wk")).alias("word_uses")).where(F.col("word_uses") * SHARE >= F.col("canonical_uses"))
    made = often.withColumn("made", F.concat("cs", F.expr("substring(word, length(ws) + 1)")))
    made = made.join(attested, F.col("made") == F.col("_a"))
    return made.groupBy(F.col("word").alias("variant")).agg(F.min_by("made", "ordinal").alias("canonical"))


def replaced(texts: DataFrame, replacements: DataFrame) -> DataFrame:
    """texts(seg_id, text, ...) with the replacements made at whole words, longest first, in one pass; and `applied`.
    A quoted canonical within quotes leaves out its own. The replacements are decisions of one book: they reach the workers
    as a table of TERMS at most, more is an error."""
    rows = replacements.limit(TERMS + 1).collect()
    if len(rows) > TERMS:
        raise ValueError(f"more than {TERMS} replacements for one run")
    to = {r.variant: r.canonical for r in rows}
    wordlike = regex.compile(r"[\p{L}\p{N}]")
    edge = lambda v: ("(?<![\\p{L}\\p{N}])" if wordlike.match(v) else "") + regex.escape(v) + ("(?![\\p{L}\\p{N}])" if wordlike.match(v[-1]) else "")
    pattern = "|".join(map(edge, sorted(to, key=lambda v: (-len(v), v))))

    def run(column: pa.Array) -> pa.Array:
        found = regex.compile(pattern) if pattern else None

        def put(m) -> str:
            new = to[m[0]]
            new = new[1:] if new.startswith("«") and m.string[max(m.start() - 1, 0) : m.start()] == "«" else new
            return new[:-1] if new.endswith("»") and m.string[m.end() : m.end() + 1] == "»" else new

        out = [found.subn(put, x or "") if found else (x or "", 0) for x in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int32())], ["text", "applied"])

    made = F.arrow_udf(run, "struct<text:string,applied:int>").asNondeterministic()
    return texts.withColumn("_r", made(F.col("text"))).withColumns({"text": F.col("_r.text"), "applied": F.col("_r.applied")}).drop("_r")


def capabilities(language: str | None) -> dict[str, Callable]:
    """What can be done for a target language, by its base tag; nothing for one that is unknown."""
    return LANGUAGES.get((language or "").lower().split("-")[0], {})


def report(sources: DataFrame, targets: DataFrame, glossary: DataFrame, language: str, stop: tuple[str, ...] = E.STOP_WORDS) -> tuple[DataFrame, DataFrame]:
    """Entities with their expected targets, and the diagnostics of the target's documents: doc_id, kind, n."""
    entities = with_expected_targets(entity_report(sources, stop), glossary)
    diagnose = capabilities(language).get("diagnose")
    empty = targets.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("kind"), F.lit(0).cast("bigint").alias("n")).limit(0)
    return entities, diagnose(targets) if diagnose else empty


def consistency_pass(sources: DataFrame, targets: DataFrame, glossary: DataFrame, decisions: DataFrame, navigation: DataFrame, language: str) -> dict[str, DataFrame]:
    """The pass in its order: mechanics, decisions, glossary, navigation labels, mechanics, adherence, report.

    navigation: doc_id, role (ncx, nav). Returns the repaired texts with the number of changes of each step, the
    adherence of the glossary, the entities and the diagnostics.
    """
    mechanics = capabilities(language).get("mechanics", lambda t: t.withColumn("applied", F.lit(0)))
    step = lambda df, name: kept(df.withColumnRenamed("applied", name), name)  # noqa: E731  each step is read several times after
    first = step(mechanics(targets.select("doc_id", "seg_pos", "seg_id", "text")), "first_mechanics")
    decided = step(replaced(first, decided_replacements(sources, first, decisions)), "decided")
    aligned = step(replaced(decided, glossary_replacements(sources, decided, glossary)), "aligned")
    labels = aligned.join(sources.select("seg_id", F.col("text").alias("source")), "seg_id").join(navigation, "doc_id", "left")
    labels = E.navigation_labels(labels.select(F.coalesce("role", F.lit("text")).alias("role"), F.struct("doc_id", "seg_pos").alias("ord"), "source", F.col("text").alias("target")))
    labels = labels.select(F.col("ord.doc_id").alias("_d"), F.col("ord.seg_pos").alias("_p"), "authority")
    named = aligned.join(labels, (F.col("doc_id") == F.col("_d")) & (F.col("seg_pos") == F.col("_p")), "left")
    named = named.withColumns({"text": F.coalesce("authority", "text"), "labelled": F.col("authority").isNotNull().cast("int")}).drop("_d", "_p", "authority")
    last = step(mechanics(named), "last_mechanics")
    pairs = sources.select("seg_id", F.col("text").alias("source")).join(last.select("seg_id", F.col("text").alias("target")), "seg_id")
    entities, diagnostics = report(sources, last, glossary, language)
    return {"texts": last, "adherence": E.adherence(pairs, glossary), "entities": entities, "diagnostics": diagnostics}


LANGUAGES: dict[str, dict[str, Callable]] = {"ru": {"mechanics": T.mechanics, "diagnose": T.diagnosed, "audit": T.russian_audit, "written_out": T.written_out}}
