"""Typographic and linguistic diagnostics of texts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.text import col, count_of, let, shared_prefix

WINDOW_CHARS, DRIFT_CHARS = 4000, 4000
#: Mechanical rules of quotes and coordinates, in their order: what, by what. Fixed values.
MECHANICS = (
    (r"«(?:\s*«)+", "«"),
    (r"(?:»\s*)+»", "»"),
    (r"(\d{1,3})\s*°\s*(\d{1,2})\s*[′´']", r"\1° \2′"),
    (r"«([^«»\n]{1,240})»(\s*,?\s*[—–][^«»\n]{1,200}?[.!?…]\s*[—–]\s[^«»\n]{1,400}?)»", r"«\1\2»"),
    (r"«[\t ]+", "«"),
    (r"[\t ]+»", "»"),
    (r"«\s*«", "«"),
    (r"»\s*»", "»"),
)
#: Stems of Russian number words. Fixed values.
NUMBER_STEMS = {
    1: "перв|одн", 2: "втор|дв[уе]", 3: "трет|тр[её]", 4: "чётверт|четверт|четв[её]р", 5: "пят", 6: "шест", 7: "седьм|сем", 8: "восьм|восем", 9: "девят", 10: "десят",
    11: "одиннадцат", 12: "двенадцат", 13: "тринадцат", 14: "четырнадцат", 15: "пятнадцат", 16: "шестнадцат", 17: "семнадцат", 18: "восемнадцат", 19: "девятнадцат",
    20: "двадцат", 30: "тридцат", 40: "сорок", 50: "пятьдесят|пятидесят", 60: "шестьдесят|шестидесят", 70: "семьдесят|семидесят", 80: "восемьдесят|восьмидесят", 90: "девяност",
    100: "ст[оа]|сот", 200: "двест|двухсот", 300: "трист|тр[её]хсот", 400: "четырест|четыр[её]хсот", 500: "пятьсот|пятисот", 600: "шестьсот|шестисот", 700: "семьсот|семисот", 800: "восемьсот|восьмисот", 900: "девятьсот|девятисот",
}
THOUSAND, MAGNITUDES = "тысяч", ((10**9, "миллиард"), (10**6, "миллион"), (10**3, "тысяч"))
#: Words spelt with either letter that are two words. Fixed values.
HOMOGRAPHS = ("все", "всем", "всех", "чем", "небо", "падеж", "осел", "слез", "поем", "совершенный", "узнаем", "признаем", "берет", "ведро", "мел")
#: Capitalised words that name nothing. Fixed values.
NO_NAMES = ("Это", "Этот", "Эта", "После", "Когда", "Однако", "Затем", "Тогда", "Если", "Хотя", "Потом", "Самое", "Всё", "Все")


#: Quotes of two kinds around one text, and quotes that stand twice. Fixed values.
HYBRID, DOUBLED = r'"[^"\n]{0,240}»|«[^«\n]{0,240}"', r"«\s*«|»\s*»"


def quote_report(c: Column | str) -> Column:
    """Counts of guillemets and straight quotes, and of pairs that mix or double them."""
    return F.struct(
        count_of(c, "«").alias("opening"), count_of(c, "»").alias("closing"), count_of(c, '"').alias("straight"),
        count_of(c, HYBRID).alias("hybrid"), count_of(c, DOUBLED).alias("doubled"),
    )


def spelling_variants(words: DataFrame, marked: str = "ё", plain: str = "е", homographs: tuple[str, ...] = ()) -> DataFrame:
    """words: word. Words spelled with and without a mark: key without it, their spellings."""
    key = F.translate(F.lower("word"), marked, plain)
    groups = words.select(key.alias("key"), F.lower("word").alias("w")).groupBy("key").agg(F.array_sort(F.collect_set("w")).alias("variants"), F.count("*").alias("uses"))
    return groups.where((F.size("variants") > 1) & ~F.col("key").isin(*homographs) if homographs else F.size("variants") > 1)


def longest_run_without(segments: DataFrame, letter: str, book: str = "doc_id", order: str = "seg_pos") -> DataFrame:
    """Per book, most characters in a row of segments without a letter, and how often the letter occurs; drift
    if it is used at all but lacking for long."""
    has = F.contains(F.lower("text"), F.lit(letter))
    w = Window.partitionBy(book).orderBy(order)
    rows = segments.withColumn("_island", F.sum(has.cast("int")).over(w)).withColumn("_n", count_of(F.lower("text"), letter))
    runs = rows.groupBy(book, "_island").agg(F.sum(F.when(has, 0).otherwise(F.length("text"))).alias("run"), F.sum("_n").alias("n"))
    out = runs.groupBy(book).agg(F.max("run").alias("longest"), F.sum("n").alias("letters"))
    return out.withColumn("drift", (F.col("letters") >= 3) & (F.col("longest") >= DRIFT_CHARS))


def letter_windows(texts: DataFrame, letter: str, book: str = "doc_id", chars: int = WINDOW_CHARS) -> DataFrame:
    """Fixed windows of a book's text: words and uses of a letter in each; bare if it has 300 words and no use
    where the book has three or more."""
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(chars)))
    rows = texts.where("text <> ''").select(book, "text", start.alias("start")).select(book, (F.col("start") / chars).cast("int").alias("i"), F.substring("text", F.col("start") + 1, F.lit(chars)).alias("t"))
    rows = rows.select(book, "i", count_of("t", r"[\p{L}]+").alias("words"), count_of(F.lower("t"), letter).alias("uses"))
    total = F.sum("uses").over(Window.partitionBy(book))
    return rows.withColumn("bare", (F.col("words") >= 300) & (F.col("uses") == 0) & (total >= 3))


def warning_counts(reports: DataFrame, weights: dict[str, int], book: str = "doc_id") -> DataFrame:
    total = sum((F.col(k) * w for k, w in weights.items()), F.lit(0))
    return reports.groupBy(book).agg(F.sum(total).cast("bigint").alias("warnings"))


def guillemet_faults(c: Column | str) -> Column:
    """Lines whose guillemets don't pair. Depth carries over lines; a line that opens with « while one is open
    continues the quote."""

    def line(a: Column, x: Column) -> Column:
        marks = F.regexp_replace(x, "[^«»]", "")
        continued = (a["d"] > 0) & F.regexp_like(x, F.lit(r"(?U)^\s*«"))
        marks = F.when(continued, F.substring(marks, F.lit(2), F.length(marks))).otherwise(marks)
        moved = F.aggregate(F.split(marks, ""), F.struct(a["d"].alias("d"), F.lit(False).alias("bad")), lambda s, m: F.struct((s["d"] + F.when(m == "«", 1).when(m == "»", -1).otherwise(0)).cast("int").alias("d"), (s["bad"] | ((s["d"] == 0) & (m == "»"))).alias("bad")))
        return let(moved, lambda m: F.struct(F.greatest(m["d"], F.lit(0)).alias("d"), (a["faults"] + m["bad"].cast("int")).cast("int").alias("faults")))

    end = F.aggregate(F.split(col(c), "\n"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("faults")), line)
    return let(end, lambda e: e["faults"] + (e["d"] > 0).cast("int"))


def repeated_stems(labels: DataFrame, key: str) -> DataFrame:
    """key, text. Words of a label that share their first 5 letters, unless all are spelled alike and none stand
    side by side."""
    rows = labels.select(key, F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]{5,})"), 1)).alias("i", "w")).withColumn("stem", F.substring("w", 1, 5))
    last = F.lag("i").over(Window.partitionBy(key, "stem").orderBy("i"))
    groups = rows.withColumn("_near", F.coalesce(F.col("i") - last == 1, F.lit(False))).groupBy(key, "stem").agg(F.count("*").alias("n"), F.countDistinct("w").alias("spellings"), F.bool_or("_near").alias("near"))
    return groups.where("n >= 2 and (spellings > 1 or near)").select(key, "stem", "n", "spellings")


def duplicated_fragments(c: Column | str) -> Column:
    """Neighbouring words that share most of their letters but differ, as a torn heading leaves them."""
    cut = F.split(F.regexp_replace(F.lower(col(c)), r"([\p{L}]{4,})", "\x01$1\x01"), "\x01")

    def among(cut: Column) -> Column:
        places = F.when(F.size(cut) >= 5, F.sequence(F.lit(3), F.size(cut) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))

        def pair(i: Column) -> Column:
            a, b, gap = cut[i - 2], cut[i], cut[i - 1]
            open_ = (F.substring(a, 1, 4) == F.substring(b, 1, 4)) & (a != b) & (a != "друг") & ~gap.rlike(r"[\p{L}\p{N}–—…\-.!?\r\n]")
            return F.when(open_ & (shared_prefix(a, b) >= F.greatest(F.length(a), F.length(b)) * 0.8), F.concat_ws(" ", a, b))

        return F.array_distinct(F.filter(F.transform(places, pair), lambda x: x.isNotNull()))

    return let(cut, among)


def _straightened(text: str) -> str:
    """Straight quotes as guillemets: opening after a blank or an opening sign if a word follows, else closing."""
    def side(m) -> str:
        before, after = text[: m.start()][-1:], regex.search(r"\S", text, pos=m.end())
        opens = (not before or regex.match(r"[\s(\[{—:;,]", before)) and after and regex.match(r"[\p{L}\p{N}]", after[0])
        return "«" if opens else "»"

    return regex.sub('"', side, text)


def _unclosed(text: str) -> int | None:
    """Where the only guillemet that is left open stands, if none is closed that wasn't opened."""
    open_ = []
    for m in regex.finditer("[«»]", text):
        if m[0] == "«":
            open_.append(m.start())
        elif open_:
            open_.pop()
        else:
            return None
    return open_[0] if len(open_) == 1 else None


def mended(texts: list[str]) -> list[tuple[str, int]]:
    """The texts of a document after the mechanical rules, each with the number of changes.

    Quotes are read over the whole document, as they open in one text and close in another; a single one left open is
    closed after the short text that follows. Then the rules go over each text.
    """
    joined = _straightened("".join(texts))
    out, at, open_ = [], 0, _unclosed(joined)
    for text in texts:
        out.append([joined[at : at + len(text)], text.count('"')])
        if open_ is not None and at <= open_ < at + len(text):
            follows = len(out)
        at += len(text)
    if open_ is not None and follows < len(out):
        after = out[follows]
        if after[0].strip() and len(after[0]) <= 200 and not regex.search("[«»]", after[0]):
            after[0], after[1] = after[0] + "»", after[1] + 1
    for x in out:
        for what, by in MECHANICS:
            x[0], n = regex.subn(what, by, x[0])
            x[1] += n
    return [(text, n) for text, n in out]


def mechanics(segments: DataFrame, doc: str = "doc_id", order: str = "seg_pos") -> DataFrame:
    """segments with mended() texts and `applied`. A document is one task's at a time, its order kept; state over it, so
    an Arrow function."""
    columns = [c for c in segments.columns if c != "applied"]
    schema = segments.select(*columns, F.lit(0).alias("applied")).schema
    texts, key = columns.index("text"), columns.index(doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, group in itertools.groupby(rows, lambda r: r[key]):
            group = [*group]
            done = mended([r[texts] or "" for r in group])
            table = [(*r[:texts], text, *r[texts + 1 :], n) for r, (text, n) in zip(group, done)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*table), to_arrow_schema(schema))], [*columns, "applied"])

    return segments.select(*columns).repartition(doc).sortWithinPartitions(doc, order).mapInArrow(run, schema)


#: Degrees and minutes: the whole, degrees, blanks, minutes, blanks, mark.
COORDINATE = r"(\d{1,3})\s*°(\s*)(\d{1,2})(\s*)([′´'])"


def coordinates(c: Column | str) -> Column:
    """Coordinates of a text: value, canonical spelling, and whether it has that."""
    part = lambda v, i: F.regexp_extract(v, COORDINATE, i)
    values = F.regexp_extract_all(col(c), F.lit(COORDINATE), 0)
    canonical = lambda v: F.concat(part(v, 1), F.lit("° "), part(v, 3), F.lit("′"))
    return F.transform(values, lambda v: F.struct(v.alias("value"), canonical(v).alias("canonical"), ((part(v, 5) == "′") & (part(v, 2) == " ") & (part(v, 4) == "")).alias("is_canonical")))


def street_conventions(texts: DataFrame, book: str = "doc_id") -> DataFrame:
    """Streets of a book that are named both with -стрит and after улица, by the first five letters of their name."""
    stem = lambda w, use: F.struct(F.lower(F.substring(w, F.lit(1), F.lit(5))).alias("stem"), F.lit(use).alias("use"))
    hyphen = F.transform(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}])([А-ЯЁ][а-яё]+)-стрит(?![\p{L}\p{N}])"), 1), lambda w: stem(w, "hyphen"))
    word = F.transform(F.regexp_extract_all("text", F.lit(r"(?iu)(?<![\p{L}\p{N}])улиц(?:а|е|у|ы|ей)\s+([А-ЯЁ][а-яё]+)"), 1), lambda w: stem(w, "word"))
    rows = texts.select(book, F.explode(F.concat(hyphen, word)).alias("x")).groupBy(book, "x.stem").agg(F.countDistinct("x.use").alias("uses"))
    return rows.where("uses > 1").select(book, "stem")


def number_stems(value: Column) -> Column:
    """Patterns of the words that a whole number from 1 to 999,999 is written with; empty for others."""
    table = F.create_map(*(F.lit(x) for pair in NUMBER_STEMS.items() for x in pair))
    none = F.array().cast("array<int>")

    def below_thousand(n: Column) -> Column:
        hundreds, rest = (n - n % 100).cast("int"), (n % 100).cast("int")
        tail = F.when(rest.between(10, 19), F.array(rest)).otherwise(F.array((rest - rest % 10).cast("int"), (rest % 10).cast("int")))
        return F.transform(F.filter(F.concat(F.array(hundreds), tail), lambda x: x > 0), lambda x: F.element_at(table, x))

    n = value.try_cast("bigint")
    thousands = F.floor(n / 1000)
    words = F.concat(F.when(thousands > 1, below_thousand(thousands)).otherwise(none.cast("array<string>")), F.when(thousands > 0, F.array(F.lit(THOUSAND))).otherwise(none.cast("array<string>")), below_thousand(n % 1000))
    whole = (value.try_cast("double") == F.floor(value.try_cast("double"))) & n.between(1, 999_999)
    return F.when(whole, words).otherwise(none.cast("array<string>"))


def written_out(value: Column, text: Column) -> Column:
    """Whether a number of a source stands in a Russian text in words: all its words, or a figure and its magnitude."""
    n = value.try_cast("bigint")
    found = F.lit(False)
    for scale, word in MAGNITUDES:
        figure = F.concat(F.lit(r"(?iu)(?<!\d)"), F.floor(n / scale).cast("string"), F.lit(rf"(?!\d)[^\p{{L}}\d]{{0,3}}{word}"))
        found = found | ((n >= scale) & (n % scale == 0) & F.regexp_like(text, figure))
    stems = number_stems(value)
    return F.coalesce(found, F.lit(False)) | ((F.size(stems) > 0) & F.forall(stems, lambda s: F.regexp_like(text, F.concat(F.lit("(?iu)"), s))))


def names_within(texts: DataFrame, book: str = "doc_id", capital: str = r"[А-ЯЁ][а-яё]{2,}", none: tuple[str, ...] = NO_NAMES) -> DataFrame:
    """texts: book, text. Capitalised words of five letters or more that don't begin a sentence, twice or more in a book."""
    cut = F.split(F.regexp_replace("text", rf"((?<![\p{{L}}\p{{N}}]){capital})", "\x01$1\x01"), "\x01")
    places = F.transform(cut, lambda w, i: F.struct(i.alias("i"), w.alias("name"), F.rtrim(F.regexp_replace(F.get(cut, i - 1), r"(?U)\s+$", "")).alias("gap"), i.alias("at")))
    found = F.filter(places, lambda x: (x["i"] % 2 == 1) & ((x["gap"] != "") & ~x["gap"].rlike("[.!?]$") | ((x["gap"] == "") & (x["i"] > 1))))
    rows = texts.select(book, F.explode(found).alias("x")).select(book, "x.name").where((F.length("name") >= 5) & ~F.col("name").isin(*none))
    return rows.groupBy(book, "name").agg(F.count("*").alias("n")).where("n >= 2")


def name_clusters(names: DataFrame, book: str = "doc_id") -> DataFrame:
    """names: book, name, n. Names of a book that are spelt nearly alike and are no inflections of each other, each in one
    cluster: the first by use and spelling takes all that are near it. cluster (its head), name, n.

    Only pairs that entities.near_pairs finds are compared; of a book, its pairs and not its names meet in a task.
    """
    from .entities import near_pairs

    pairs = near_pairs(names.select(F.col("name"), "n", book), book)
    pairs = pairs.where(shared_prefix(F.lower("name"), F.lower("other")) < F.least(F.length("name"), F.length("other")) - 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for key, group in itertools.groupby(rows, lambda r: r[0]):
            near: dict[str, set[str]] = {}
            uses: dict[str, int] = {}
            for _, a, b, n, m in group:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
                uses |= {a: n, b: m}
            taken, out = set(), []
            for head in sorted(near, key=lambda x: (-uses[x], x)):
                if head not in taken and (mine := sorted(near[head] - taken)):
                    taken |= {head, *mine}
                    out += [(key, head, x, uses[x]) for x in (head, *mine)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64()))], [book, "cluster", "name", "n"])

    rows = pairs.select(F.col(book).cast("string"), "name", "other", F.col("n").cast("bigint"), F.col("m").cast("bigint"))
    return rows.repartition(book).sortWithinPartitions(book).mapInArrow(run, f"{book} string, cluster string, name string, n bigint")


def diagnosed(segments: DataFrame, doc: str = "doc_id", order: str = "seg_pos") -> DataFrame:
    """Warnings of a Russian book's documents by kind: doc_id, kind, n. Quotes are read over all texts of a document."""
    texts = segments.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n").alias("text"))
    report = quote_report("text")
    counts = {"unbalanced": guillemet_faults("text") > 0, "straight": report["straight"] > 0, "hybrid": report["hybrid"], "doubled": report["doubled"]}
    kinds = texts.select(F.col(doc).cast("string").alias("doc_id"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("bigint").alias("n")) for k, v in counts.items()))).alias("x")).select("doc_id", "x.*")
    words = segments.select(F.col(doc), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{M}]*[её][\p{L}\p{M}]*)"), 1)).alias("w")).withColumn("key", F.translate("w", "ё", "е"))
    spelt = words.groupBy(doc, "key").agg(F.countDistinct("w").alias("v")).where((F.col("v") > 1) & ~F.col("key").isin(*HOMOGRAPHS)).groupBy(F.col(doc).cast("string").alias("doc_id")).agg(F.count("*").alias("n"))
    drift = longest_run_without(segments.where(F.col("text").rlike("(?iu)[а-я]")), "ё", doc, order).where("drift").select(F.col(doc).cast("string").alias("doc_id"), F.lit("drift").alias("kind"), F.lit(1).cast("bigint").alias("n"))
    return kinds.unionByName(spelt.select("doc_id", F.lit("spelling").alias("kind"), "n")).unionByName(drift).where("n > 0")


def russian_audit(documents: DataFrame, book: str = "book", doc: str = "doc_id") -> DataFrame:
    """documents: book, doc_id, text. Warnings of a finished Russian book, a row each: book, warning.

    Documents in order make the book's text, of which windows are read for the letter ё.
    """
    low = F.lower("text")
    words, yo = count_of(low, "[а-яё]+"), count_of(low, "ё")
    faults, straight = guillemet_faults("text"), count_of("text", '"')
    of = lambda what: F.concat(F.col(doc).cast("string"), F.lit(": "), what)
    own = F.array(F.when(faults > 0, of(F.lit("unbalanced guillemets"))), F.when(straight > 0, of(F.concat(straight.cast("string"), F.lit(" straight double quote(s)")))))
    own = documents.select(book, F.explode(F.filter(own, lambda x: x.isNotNull())).alias("warning"))
    bare = documents.where((words >= 100) & (yo == 0)).select(book, F.lit("a substantial document contains no ё").alias("warning")).distinct()
    texts = documents.groupBy(book).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(doc, "text"))), lambda x: x["text"]), "\n").alias("text"))
    windows = letter_windows(texts, "ё", book).where("bare").select(book, F.lit("a window of 4000 characters contains no ё").alias("warning")).distinct()
    streets = street_conventions(documents, book).select(book, F.lit("mixed street-name conventions").alias("warning")).distinct()
    minutes = documents.where(F.exists(coordinates("text"), lambda x: ~x["is_canonical"])).select(book, F.lit("non-canonical coordinates").alias("warning")).distinct()
    return own.unionByName(bare).unionByName(windows).unionByName(streets).unionByName(minutes)


def audit(documents: DataFrame, language: str) -> DataFrame:
    """documents: doc_id, title, lang, text. One row per warning of a document."""
    checks = {
        "empty document": F.trim("text") == "",
        "wrong language": ~F.lower("lang").startswith(language.split("-")[0]),
        "unbalanced guillemets": guillemet_faults("text") > 0,
        "mixed quotes": quote_report("text")["hybrid"] > 0,
    }
    warnings = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())), lambda x: x.isNotNull())
    return documents.select("doc_id", F.explode(warnings).alias("warning"))


def agreement(texts: DataFrame, checker=None) -> DataFrame:
    """texts: seg_id, text. Findings of a checker of grammatical agreement, checker(text) -> [(span, fix)], of a dictionary that
    the caller has; without one there are none."""
    if checker is None:
        return texts.select("seg_id", F.lit("").alias("span"), F.lit("").alias("fix")).limit(0)

    def run(column: pa.Array) -> pa.Array:
        return pa.array([[{"span": a, "fix": b} for a, b in checker(x or "")] for x in column.to_pylist()], pa.list_(pa.struct([("span", pa.string()), ("fix", pa.string())])))

    return texts.select("seg_id", F.explode(F.arrow_udf(run, "array<struct<span:string,fix:string>>")("text")).alias("x")).select("seg_id", "x.*")
