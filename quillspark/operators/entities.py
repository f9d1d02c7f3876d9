"""Entities and terminology: mining names, glossaries, consistency of their translations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clipped, col, collapsed, escaped, mentions, occurrences, shared_prefix

#: A name needs so many mentions, and so many for each common use of the word.
MENTIONS, OVER_NOUN = 5, 4
KEPT, CONTEXTS, CHUNK = 250, 8, 25
#: Words that are never names, a default for the parameter.
STOP_WORDS = tuple("a an and are as at be but by for from had has have he her his i if in is it its no not of on or our she so that the their them then there they this to was we were what when which who will with you your".split())
#: Endings of names, in the order in which they are tried. Fixed values.
ENDINGS = ("ою", "ею", "ой", "ей", "ом", "ем", "ём", "а", "я", "е", "и", "ы", "у", "ю")
#: Words in lower case that stay inside a name. Fixed values.
CONNECTORS = ("of", "the", "de", "del", "la", "le", "van", "von", "der", "du")
#: Mentions of a glossary's terms: up to so many terms, counted, their table is broadcast.
TERMS = 20_000
_WORD = r"[\p{L}\p{M}'’]+"


def words(segments: DataFrame, text: str = "text") -> DataFrame:
    """Each word of each segment: place i, word, key (lower case), initial: whether it begins a sentence."""
    rest = [c for c in segments.columns if c != text]
    pieces = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"({_WORD})", "\x01$1\x01"), "\x01")
    rows = segments.select(*rest, pieces.alias("_p")).select(*rest, F.explode(F.transform(F.filter(F.transform("_p", lambda w, i: F.struct(i.alias("i"), w.alias("word"), F.get("_p", i - 1).alias("gap"))), lambda x: x["i"] % 2 == 1), lambda x: x)).alias("x"))
    opens = (F.col("x.i") == 1) | F.rtrim(F.col("x.gap")).rlike("[.!?。！？]$")
    return rows.select(*rest, F.floor(F.col("x.i") / 2).cast("int").alias("i"), F.col("x.word").alias("word"), F.lower("x.word").alias("key"), opens.alias("initial"))


def case_counts(found: DataFrame) -> DataFrame:
    """Lower-case uses of words of 3 letters or more; capitalised ones within sentences."""
    low = (F.col("word") == F.col("key")) & (F.length("word") >= 3)
    named = F.col("word").rlike(r"^\p{Lu}\p{L}{2,}") & ~F.col("initial")
    rows = found.where(low | named).groupBy("key").agg(F.sum(low.cast("bigint")).alias("common"), F.sum(named.cast("bigint")).alias("named"))
    return rows


def names_rather_than_nouns(counts: DataFrame) -> DataFrame:
    keep = (F.col("common") == 0) | ((F.col("named") >= MENTIONS) & (F.col("named") >= F.col("common") * OVER_NOUN))
    return counts.where(F.col("named") > 0).where(keep)


def cleaned(c: Column | str) -> Column:
    """A candidate without marks and clitics at its end."""
    c = F.regexp_replace(col(c), "[.-]+$", "")
    c = F.regexp_replace(c, "(?i)['’](?:s|re|ve|ll|d|m)$", "")
    return collapsed(F.regexp_replace(c, "[.-]+$", ""))


def candidates(found: DataFrame) -> DataFrame:
    """Capitalised words of 3 letters or more, cleaned."""
    rows = found.where(F.col("word").rlike(r"^\p{Lu}\p{L}{2,}")).withColumn("source", cleaned("word"))
    return rows.withColumn("key", F.lower("source")).where("source <> ''")


def evidence(segments: DataFrame, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """segments: doc_id, seg_pos, text. Per candidate its first spelling, mentions, those within sentences, and
    the first texts it stands in. Stop words and words that are rather nouns are none."""
    found = words(segments)
    rows = candidates(found)
    counts = case_counts(found).select(F.col("key").alias("k"), "common", "named")
    noun = F.coalesce(F.col("common"), F.lit(0)) > 0
    is_name = ~noun | ((F.col("named") >= MENTIONS) & (F.col("named") >= F.col("common") * OVER_NOUN))
    order = F.struct("doc_id", "seg_pos", "i")
    by_key = rows.groupBy("key").agg(F.min_by("source", order).alias("source"), F.count("*").alias("occurrences"), F.sum((~F.col("initial")).cast("bigint")).alias("within"))
    return by_key.join(counts, by_key["key"] == counts["k"], "left").select("key", "source", "occurrences", "within", F.col("key").isin(*stop).alias("stop"), (~is_name).alias("noun"))


def strong(found: DataFrame) -> DataFrame:
    return found.where(~F.col("stop") & ~F.col("noun") & (F.col("occurrences") >= 2) & (F.col("within") > 0))


def top_entities(found: DataFrame, n: int = KEPT) -> DataFrame:
    return strong(found).orderBy(F.desc("occurrences"), "source").limit(n).select("source", "occurrences")


def evidence_stats(found: DataFrame, n: int = KEPT) -> DataFrame:
    """Stop and common words count once per mention, admitted candidates once."""
    barred = F.col("stop") | F.col("noun")
    is_strong = ~barred & (F.col("occurrences") >= 2) & (F.col("within") > 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    out = found.agg(
        total(F.when(barred, F.col("occurrences")).otherwise(1)).alias("candidates"), total(F.when(F.col("stop"), F.col("occurrences"))).alias("stop_words"), total(F.when(~F.col("stop") & F.col("noun"), F.col("occurrences"))).alias("common_words"),
        total((~barred & ~is_strong).cast("int")).alias("weak"), total(is_strong.cast("int")).alias("strong"),
    )
    return out.select("candidates", "stop_words", "common_words", "weak", F.greatest(F.lit(0), F.col("strong") - n).cast("bigint").alias("overflow"), F.least(F.lit(n), F.col("strong")).cast("bigint").alias("kept"))


_TOKEN, _CAPITAL = regex.compile(r"[\p{L}\p{N}\p{M}'’-]+"), regex.compile(r"\p{Lu}")


def phrases_of(text: str, stop: tuple[str, ...] = STOP_WORDS, connectors: tuple[str, ...] = CONNECTORS, most: int = 5) -> list[tuple[int, str]]:
    """(place, phrase): runs of two to `most` words between capitals, parted by blanks and tabs only. Connectors may
    stand between two capitals; stop words at either end fall away."""
    runs, run, end = [], [], 0
    for m in _TOKEN.finditer(text):
        if run and (text[end : m.start()].strip(" \t") or end == m.start()):
            runs.append(run)
            run = []
        end = m.end()
        if _CAPITAL.match(m[0]) or (run and m[0].lower() in connectors):
            run.append(m)
        elif run:
            runs.append(run)
            run = []
    out = []
    for run in [*runs, run]:
        while run and not _CAPITAL.match(run[-1][0]):  # a connector that bridges nothing
            run.pop()
        while run and run[0][0].lower() in stop:
            run.pop(0)
        while run and run[-1][0].lower() in stop:
            run.pop()
        if 2 <= len(run) <= most:
            out.append((run[0].start(), text[run[0].start() : run[-1].end()]))
    return out


def phrases(segments: DataFrame, stop: tuple[str, ...] = STOP_WORDS, connectors: tuple[str, ...] = CONNECTORS) -> DataFrame:
    """phrases_of() each text, a row each. An automaton over tokens, so an Arrow function."""
    rest = [c for c in segments.columns if c != "text"]

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[p for _, p in phrases_of(t or "", stop, connectors)] for t in texts.to_pylist()], pa.list_(pa.string()))

    return segments.select(*rest, F.explode(F.arrow_udf(run, "array<string>")("text")).alias("phrase"))


def glossary_mentions(segments: DataFrame, glossary: DataFrame, text: str = "text") -> DataFrame:
    """Segments with each entry (term, ...) of glossary(source, ...) that they hold as a whole word, in any case.

    Words of a text meet the entries by their first word, then the whole term is verified on the same row; so the cost
    follows the mentions, not entries times segments. A glossary of up to TERMS entries, counted, is broadcast and
    no text moves; a longer one meets the words by shuffle. Terms without a letter or digit are tried on every text.
    """
    word = r"([\p{L}\p{N}]+)"
    terms = glossary.withColumnRenamed("source", "term").withColumn("_k", F.lower(F.regexp_extract("term", word, 1)))
    if terms.limit(TERMS + 1).count() <= TERMS:
        terms = F.broadcast(terms)
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.lower(text), F.lit(word), 1)))
    hits = segments.withColumn("_w", F.explode(tokens)).join(terms, F.col("_w") == F.col("_k")).drop("_w", "_k")
    return hits.where(mentions(text, "term"))


def merged_glossary(own: DataFrame, generated: DataFrame) -> DataFrame:
    """The user's entries, then generated ones whose source, in any case, the user has not."""
    keys = own.select(F.lower("source").alias("_k"))
    return own.unionByName(generated.join(keys, F.lower("source") == F.col("_k"), "left_anti"))


def adherence(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """For each enabled entry: texts that mention it, and those whose target has all words of its translation,
    but for their last two letters."""
    found = glossary_mentions(pairs.withColumnRenamed("source", "text"), glossary.where("enabled").select("source", F.col("target").alias("translation")))
    prefixes = F.transform(F.filter(F.split(F.lower("translation"), r"\s+"), lambda w: w != ""), lambda w: F.substring(w, F.lit(1), F.greatest(F.lit(3), F.length(w) - 2)))
    used = F.forall(prefixes, lambda p: F.contains(F.lower("target"), p))
    out = found.groupBy("term", "translation").agg(F.count("*").alias("blocks"), F.sum(used.cast("bigint")).alias("used"))
    return out.withColumn("ratio", F.round(F.col("used") / F.col("blocks"), 6))


def adherence_warnings(found: DataFrame) -> DataFrame:
    return found.where("blocks >= 3 and used * 2 < blocks")


def navigation_labels(labels: DataFrame) -> DataFrame:
    """labels: role (ncx, nav, text), ord, source, target. Labels that occur twice or more and stand in a
    navigation get the target that it has, the ncx's first."""
    key = collapsed("source")
    rank = F.when(F.col("role") == "ncx", 0).when(F.col("role") == "nav", 1).otherwise(2)
    rows = labels.withColumn("label", key).where((F.length("label") <= 120) & F.col("label").rlike(r"\p{L}"))
    groups = rows.groupBy("label").agg(F.count("*").alias("n"), F.min(rank).alias("best"), F.min_by("target", F.struct(rank, "ord")).alias("authority"), F.sum(F.lit(0)).alias("_z"))
    good = groups.where("n >= 2 and best < 2").select(F.col("label").alias("l2"), "authority")
    return rows.join(good, F.col("label") == F.col("l2")).where("target <> authority").select("role", "ord", "label", "target", "authority")


def stem(c: Column | str) -> Column:
    """A word without the first of ENDINGS that it has, if three letters or more are left."""
    word = col(c)
    cut = lambda e: F.substring(word, F.lit(1), F.length(word) - len(e))
    return F.coalesce(*(F.when(F.lower(word).endswith(e) & (F.length(word) - len(e) >= 3), cut(e)) for e in ENDINGS), word)


def safe_variant(variant: Column, canonical: Column) -> Column:
    """Whether one spelling may be replaced by another: as many words, each with the same ending, a stem of distance 2 or
    less, and no marks around it but the canonical's."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    before, after, edges = r"^([^\p{L}\p{N}]*)", r"([^\p{L}\p{N}]*)$", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"

    def alike(x: Column, y: Column) -> Column:
        marks = F.lit(True)
        for side in (before, after):
            mine = F.regexp_extract(x, side, 1)
            marks = marks & ((mine == "") | (mine == F.regexp_extract(y, side, 1)))
        a, b = F.lower(F.regexp_replace(x, edges, "")), F.lower(F.regexp_replace(y, edges, ""))
        ending = lambda w: F.substring(w, F.length(stem(w)) + 1, F.length(w))
        return marks & (ending(a) == ending(b)) & (F.levenshtein(stem(a), stem(b)) <= 2)

    a, b = words(variant), words(canonical)
    plain = (F.length(variant) >= 2) & (F.trim(variant) == variant) & (F.lower(variant) != F.lower(canonical))
    return plain & (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(alike(x, y), F.lit(False))), lambda ok: ok)


def near_pairs(names: DataFrame, *of: str) -> DataFrame:
    """names: name, n, and what `of` names. Pairs of names of the same `of`, 5 letters or more, alike but for two letters,
    each used twice.

    Names meet under what is left of them with up to two letters taken out anywhere, so no pair is lost.
    """
    shorter = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    rows = names.where((F.length("name") >= 5) & (F.col("n") >= 2))
    one = shorter(F.col("name"))
    keys = F.array_distinct(F.concat(F.array("name"), one, F.flatten(F.transform(one, shorter))))
    keyed = rows.select(*of, "name", "n", F.explode(keys).alias("k"))
    other = keyed.select(*of, F.col("name").alias("other"), F.col("n").alias("m"), "k")
    pairs = keyed.join(other, [*of, "k"]).where((F.col("name") < F.col("other")) & (F.abs(F.length("name") - F.length("other")) <= 2))
    return pairs.where(F.levenshtein("name", "other") <= 2).select(*of, "name", "other", "n", "m").distinct()


def composites(entries: DataFrame) -> DataFrame:
    """entries: source, target. In targets of several words, a word nearly equal to the target of a single-word
    entry that the source also holds gives way to it."""
    single = entries.where(~F.contains("source", F.lit(" "))).select(F.lower("source").alias("k"), F.col("target").alias("t"))
    many = entries.where(F.contains("source", F.lit(" ")))
    parts = many.select("source", "target", F.explode(F.split(F.lower("source"), " ")).alias("k")).join(single, "k")
    known = parts.groupBy("source", "target").agg(F.array_sort(F.collect_set("t")).alias("known"))

    def nearly(w: Column, t: Column) -> Column:
        shared = shared_prefix(F.lower(w), F.lower(t))
        return (F.abs(F.length(w) - F.length(t)) <= 1) & (shared >= 3) & (shared >= F.least(F.length(w), F.length(t)) - 2)

    fixed = F.transform(F.split("target", " "), lambda w: F.coalesce(F.get(F.filter("known", lambda t: nearly(w, t)), F.lit(0)), w))
    return known.select("source", "target", F.array_join(fixed, " ").alias("reconciled"))


def replaced_terms(texts: DataFrame, decisions: dict[str, str], text: str = "text") -> DataFrame:
    """texts with `replaced` and `applied`: every variant, longest first, replaced in a single pass, so no
    replacement is matched again. A callback over matches, so an Arrow function."""
    word = regex.compile(r"[\p{L}\p{N}]")
    canon = {k.lower(): v for k, v in decisions.items()}
    alternatives = [("(?<![\\p{L}\\p{N}])" if word.match(v) else "") + regex.escape(v) + ("(?![\\p{L}\\p{N}])" if word.match(v[-1]) else "") for v in sorted(decisions, key=lambda v: (-len(v), v))]
    pattern = "|".join(alternatives)

    def run(column: pa.Array) -> pa.Array:
        found = regex.compile(pattern, regex.I) if pattern else None
        rows = [found.subn(lambda m: canon[m[0].lower()], x or "") if found else (x or "", 0) for x in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r for r, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int32())], ["replaced", "applied"])

    return texts.withColumn("_r", F.arrow_udf(run, "struct<replaced:string,applied:int>").asNondeterministic()(F.col(text))).select("*", "_r.*").drop("_r")


def style_passages(segments: DataFrame, order: str = "ord", stride_for: int = 12, clip: int = 1200, most: int = 6000) -> DataFrame:
    """segments: book, ord, text. Long texts at even distances, clipped, up to so many characters a book."""
    text = collapsed("text")
    rows = segments.select("book", order, text.alias("text")).where("length(text) >= 200")
    w = Window.partitionBy("book").orderBy(order)
    rows = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("book")))
    rows = rows.where(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("n") / stride_for)) == 0).withColumn("text", F.substring("text", 1, clip))
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).where(F.col("before") < most).select("book", order, "text")


def chapter_texts(segments: DataFrame, clip: int = 24_000, least: int = 2_000) -> DataFrame:
    """Texts of a document joined by line ends, clipped; short chapters have no card."""
    rows = segments.withColumn("t", collapsed("text")).where("t <> ''").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_pos", "t"))), lambda x: x["t"]), "\n").alias("text"))
    return rows.select("doc_id", F.substring("text", 1, clip).alias("text")).where(F.length("text") >= least)


def normalized_evidence(c: Column | str) -> Column:
    return collapsed(F.regexp_replace(F.lower(col(c)), r"[\"'“”„«»‘’]", ""))


def verified_facts(facts: DataFrame, chapters: DataFrame) -> DataFrame:
    """Facts whose evidence stands in their chapter; how many of a chapter don't."""
    rows = facts.join(chapters.select("doc_id", normalized_evidence("text").alias("_t")), "doc_id").withColumn("ok", F.contains(F.col("_t"), normalized_evidence("evidence")))
    return rows.groupBy("doc_id").agg(F.sum(F.col("ok").cast("bigint")).alias("verified"), F.sum((~F.col("ok")).cast("bigint")).alias("dropped"))


def card_lines(cards: DataFrame) -> DataFrame:
    """cards: doc_id, name, gender, note. One line a person; an unknown gender is left out."""
    line = F.concat(F.lit("- "), "name", F.when(F.col("gender") != "unknown", F.concat(F.lit(" ("), "gender", F.lit(")"))).otherwise(""), F.when(F.col("note") != "", F.concat(F.lit(": "), clipped("note"))).otherwise(""))
    return cards.select("doc_id", line.alias("line"))


def pattern_of(c: Column | str) -> Column:
    return escaped(c)


def registry(answers: DataFrame, wanted: DataFrame) -> DataFrame:
    """answers: ord, source, target. The first answer for each source asked for, numbered."""
    rows = answers.join(wanted.select(F.lower("source").alias("_k")).distinct(), F.lower("source") == F.col("_k"), "left_semi")
    first = rows.groupBy(F.lower("source").alias("key")).agg(F.min("ord").alias("ord"), F.min_by("source", "ord").alias("source"), F.min_by("target", "ord").alias("target"))
    return first.drop("ord").withColumn("id", F.concat(F.lit("generated-"), "key"))


def to_ask(wanted: DataFrame, cache: DataFrame, order: str = "ord", size: int = CHUNK) -> DataFrame:
    """wanted: item, language, ord. Items without a cached answer, in chunks of 25 a language."""
    key = F.sha2(F.concat_ws("\n", "item", "language"), 256)
    rows = wanted.withColumn("key", key).join(cache.select("key"), "key", "left_anti")
    place = F.row_number().over(Window.partitionBy("language").orderBy(order)) - 1
    return rows.withColumn("chunk", F.floor(place / size).cast("int"))


def with_answers(chunks: Iterator, ask, depth: int = 2) -> Iterator:
    """Asks chunk by chunk; one that fails is halved, twice at most, what fails then has no answer."""
    for chunk in chunks:
        todo = [(chunk, 0)]
        while todo:
            part, level = todo.pop()
            try:
                yield from ask(part)
            except ValueError:
                if level < depth and len(part) > 1:
                    half = len(part) // 2
                    todo += [(part[half:], level + 1), (part[:half], level + 1)]


def substring_counts(segments: DataFrame, needle: str) -> DataFrame:
    return segments.select("seg_id", occurrences("text", F.lit(needle)).alias("n")).where("n > 0")
