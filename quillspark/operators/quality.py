"""Defects of aligned source and target segments, findings of a critic, repairs and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import CJK, CYRILLIC, LATIN, col, collapsed, count_of, dominant_script, expected_expansion, let, numbers, removed_once, shared_prefix, two_decimals

KINDS = ("empty", "untranslated", "length_ratio", "missing_numbers", "source_residue", "source_interference")
#: Lengths below which a segment is too short to be compared, or to be called identical.
COMPARABLE, IDENTICAL = 80, 40
RATIO, EXAMPLES, REPORTED = (0.5, 2.0), 3, 500
#: Script that residue is looked for in, by target language. Others have no such rule.
TARGET_SCRIPT = {"ru": "cyrillic"}
DEFECTS = "array<struct<kind:string,detail:string,spans:array<string>>>"


def _defect(kind: str, detail: Column | str, spans: Column | None = None) -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    spans = F.lit(None).cast("array<string>") if spans is None else spans
    return F.array(F.struct(F.lit(kind).alias("kind"), detail.alias("detail"), spans.alias("spans")))


def _none() -> Column:
    return F.array().cast(DEFECTS)


def is_identical(source: Column, target: Column) -> Column:
    return (F.length(source) >= IDENTICAL) & (F.lower(source) == F.lower(target)) & source.rlike(r"\p{L}{2,}")


def is_untouched_script(source: Column, target: Column) -> Column:
    both = target.rlike(CJK) & (dominant_script(target) == "cjk") & (dominant_script(source) == "cjk")
    return both & (~target.rlike(f"{CYRILLIC}|{LATIN}") | (F.length(target) * expected_expansion(target) >= IDENTICAL))


def length_ratio(source: Column, target: Column) -> Column:
    return F.length(target) / F.length(source)


def ratio_is_off(source: Column, target: Column) -> Column:
    ratio, expected = length_ratio(source, target), expected_expansion(source)
    return (F.length(source) >= COMPARABLE) & ((ratio < expected * RATIO[0]) | (ratio > expected * RATIO[1]))


def missing_numbers(source: Column, target: Column) -> Column:
    """Numbers of the source that the target has less often; a two-digit year may be written out."""
    # a scanned "I" reads as 1: a lone 1 before a word of a Latin text is none
    plain = F.when(dominant_script(source) == "latin", F.regexp_replace(source, r"(?<![\p{L}\p{N}])1(?=\s+\p{L})", "I")).otherwise(source)
    gone = removed_once(numbers(plain), numbers(target))
    year = lambda v: (F.length(v) == F.lit(2)) & F.regexp_like(target, F.concat(F.lit(r"(?<![0-9])(?:19|20)"), v, F.lit("(?![0-9])")))
    # most texts hold no digit at all: they are done with one look
    return F.when(source.rlike("[0-9₀-₉]"), F.filter(gone, lambda v: ~year(v))).otherwise(F.array().cast("array<string>"))


def residue(source: Column, target: Column, language: str | None) -> Column:
    """Words of the source's script that stand in the target as they stood, if the target is of another."""
    script = TARGET_SCRIPT.get(language or "")
    empty = F.array().cast("array<string>")
    if script is None:
        return empty
    words = lambda c: F.regexp_extract_all(c, F.lit(f"({LATIN}{{4,}})"), 1)
    lower = F.filter(words(source), lambda w: w == F.lower(w))
    carried = F.array_distinct(F.filter(words(target), lambda w: F.array_contains(lower, F.lower(w))))
    runs = F.array_distinct(F.regexp_extract_all(target, F.lit(f"([{CJK[1:-1]}ー]+)"), 1))
    found = F.when(dominant_script(source) == "cjk", runs).when(dominant_script(source) == "latin", carried).otherwise(empty)
    return F.when(dominant_script(target) == script, found).otherwise(empty)


def isolated(target: Column, carried: Column) -> Column:
    """Foreign words alone between two Cyrillic ones and not in brackets or quotes of their own.

    The target is cut into words and the gaps between them; word i stands at place 2 i + 1.
    """
    word = rf"(?:[{CJK[1:-1]}ー]+|(?:(?!{CJK})[\p{{L}}\p{{M}}])+)"
    cut = F.split(F.regexp_replace(target, f"({word})", "\x01$1\x01"), "\x01")
    quotes = (("«", "»"), ("“", "”"), ("(", ")"), ("（", "）"), ("[", "]"), ("【", "】"))

    def among(v: Column) -> Column:
        cut, wanted = v["cut"], v["wanted"]

        def judged(i: Column) -> Column:
            value, before, after = cut[i], F.rtrim(cut[i - 1]), F.ltrim(cut[i + 1])
            quoted = F.lit(False)
            for a, b in quotes:
                quoted = quoted | (before.endswith(a) & after.startswith(b))
            sides = cut[i - 2].rlike(CYRILLIC) & cut[i + 2].rlike(CYRILLIC)
            shaped = F.array_contains(wanted, F.lower(value)) | value.rlike("^[a-z]{4,}$")
            return F.when(shaped & sides & ~quoted, value)

        # neighbouring words leave an empty gap between their marks
        places = F.when(F.size(cut) >= 7, F.sequence(F.lit(3), F.size(cut) - 4, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.filter(F.transform(places, judged), lambda x: x.isNotNull()))

    found = let(F.struct(cut.alias("cut"), F.transform(carried, lambda w: F.lower(w)).alias("wanted")), among)
    return F.when(target.rlike(CYRILLIC), found).otherwise(F.array().cast("array<string>"))


def scan(pairs: DataFrame, language: str | None = None) -> DataFrame:
    """pairs: source, target and ids. One row per defect: kind, detail, spans.

    An empty or untranslated target has no other defect; blank sources have none at all.
    """
    keep = [c for c in pairs.columns if c not in ("source", "target")]
    rows = pairs.select(*keep, collapsed(F.coalesce("source", F.lit(""))).alias("s"), collapsed(F.coalesce("target", F.lit(""))).alias("t"))
    s, t = F.col("s"), F.col("t")
    rows = rows.select(*keep, "s", "t", missing_numbers(s, t).alias("gone"), residue(s, t, language).alias("carried"))
    rows = rows.withColumn("alone", isolated(t, F.col("carried")))
    names = lambda c: F.array_join(F.slice(c, 1, EXAMPLES), ", ")
    kept = F.filter("carried", lambda w: ~F.array_contains(F.col("alone"), w) & (w == F.lower(w)))
    open_ = F.concat(
        F.when(ratio_is_off(s, t), _defect("length_ratio", F.concat(F.lit("translation is "), two_decimals(length_ratio(s, t)), F.lit("× the length of the original")))).otherwise(_none()),
        F.when(F.size("gone") > 0, _defect("missing_numbers", F.concat(F.lit("numbers missing from the translation: "), names(F.col("gone"))))).otherwise(_none()),
        F.when(F.size("alone") > 0, _defect("source_interference", F.concat(F.lit("source words left inside the translation: "), names(F.col("alone"))), F.col("alone"))).otherwise(_none()),
        F.when(F.size(kept) > 0, _defect("source_residue", F.concat(F.lit("untranslated source words: "), names(kept)))).otherwise(_none()),
    )
    found = (
        F.when(s == "", _none())
        .when(t == "", _defect("empty", "translation is empty"))
        .when(is_identical(s, t), _defect("untranslated", "translation is identical to the original"))
        .when(is_untouched_script(s, t), _defect("untranslated", "translation is still written in the source's script"))
        .otherwise(open_)
    )
    return rows.select(*keep, F.explode(found).alias("d")).select(*keep, "d.*")


def scan_report(defects: DataFrame, key: str = "seg_id") -> DataFrame:
    """Defective, actionable and advisory segments, and defects by kind. One row, also without defects."""
    actionable = F.col("kind") != "source_residue"
    by_id = defects.groupBy(key).agg(F.max(actionable.cast("int")).alias("a"), F.max((~actionable).cast("int")).alias("r"), *(F.sum((F.col("kind") == k).cast("int")).alias(k) for k in KINDS))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return by_id.agg(F.count("*").alias("defect_segments"), total("a").alias("actionable_segments"), total("r").alias("advisory_segments"), *(total(k).alias(k) for k in KINDS))


def misaligned(pairs: DataFrame, batch: str, order: str) -> DataFrame:
    """Segments whose answer fits the next segment, or both together, better than their own source."""
    w = Window.partitionBy(batch).orderBy(order)
    rows = pairs.withColumn("_next", F.lead("source").over(w)).where("_next is not null")
    own, answer, after = F.length("source"), F.length("target"), F.length("_next")
    scaled = answer / expected_expansion(F.concat("source", "_next"))
    shifted = ((scaled / own < 0.5) | (scaled / own > 2.2)) & (scaled / after).between(0.75, 1.5)
    glued = (scaled / own >= 1.6) & (scaled / (own + after)).between(0.8, 1.25)
    long = (own >= 40) & (after >= 40) & (answer >= 40)
    return rows.where(long & (shifted | glued)).withColumn("shape", F.when(shifted, "shifted").otherwise("glued")).drop("_next")


def soft_warnings(pairs: DataFrame, key: str = "seg_id") -> DataFrame:
    long = F.length("target") > F.greatest(F.lit(1000), F.length("source") * 4)
    found = F.filter(F.array(F.when(long, F.concat(F.lit("Suspicious length for "), key)), F.when(F.contains("target", F.lit("As an AI")), F.concat(F.lit("Service boilerplate in "), key))), lambda x: x.isNotNull())
    return pairs.select(key, F.explode(found).alias("warning"))


def escalated(defects: DataFrame, source: Column, ratio: Column) -> DataFrame:
    """Defects worth a repair: untranslated or interfering ones, and long segments that lost nearly half."""
    short = (F.col("kind") == "length_ratio") & (F.length(source) >= 200) & (ratio < 0.55)
    return defects.where(F.col("kind").isin("untranslated", "source_interference") | short)


def malformed_endings(target: Column) -> Column:
    """Guillemets with a Russian ending glued on."""
    return F.regexp_extract_all(target, F.lit("(«[^«»]*»[а-яё]{1,3})"), 1)


def quote_imbalance(c: Column | str) -> Column:
    return count_of(c, "«") - count_of(c, "»")


def latin_runs(c: Column | str) -> Column:
    return count_of(c, "[A-Za-z]{3,}")


def adjacent_repetitions(c: Column | str) -> Column:
    """Neighbouring words of 4 or more letters that share most of their letters from the start on."""
    cut = F.split(F.regexp_replace(F.lower(col(c)), r"([\p{L}]{4,})", "\x01$1\x01"), "\x01")

    def count(cut: Column) -> Column:
        places = F.when(F.size(cut) >= 5, F.sequence(F.lit(3), F.size(cut) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))

        def repeats(i: Column) -> Column:
            a, b, gap = cut[i - 2], cut[i], cut[i - 1]
            alike = (F.substring(a, 1, 4) == F.substring(b, 1, 4)) & ~gap.rlike(r"[\p{L}\p{N}]") & ~b.rlike("(?:ее|ей)$")
            return F.when(alike, shared_prefix(a, b) >= F.greatest(F.length(a), F.length(b)) * 0.6).otherwise(F.lit(False))

        return F.size(F.filter(places, repeats))

    return let(cut, count)


def repair_rejection(edited: Column, repaired: Column, original: Column) -> Column:
    """Why a repair is refused; null if it is taken."""
    most = F.greatest(F.length(edited), F.length(original)) * 2 * expected_expansion(original) + 20
    return (
        F.when(collapsed(repaired) == "", "empty repair")
        .when(repaired == edited, None)
        .when(F.length(repaired) > most, "repair changes the block structure")
        .when(adjacent_repetitions(repaired) > adjacent_repetitions(edited), "repair duplicates an adjacent fragment")
        .when((quote_imbalance(edited) == 0) & (quote_imbalance(repaired) != 0), "repair unbalances guillemets")
        .when(latin_runs(repaired) > latin_runs(edited), "repair introduces source-language residue")
    )


def critic_answers(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """answers: batch_id, seg_id, issues (JSON); expected: batch_id, seg_id. One row per expected segment.

    A segment that is missing, answered twice or not an array of issues is invalid; the others parse.
    """
    schema = "array<struct<span:string,type:string,severity:string,reason:string>>"
    counted = answers.groupBy("batch_id", "seg_id").agg(F.count("*").alias("n"), F.first("issues").alias("issues"))
    rows = expected.join(counted, ["batch_id", "seg_id"], "left").withColumn("parsed", F.from_json("issues", schema))
    bad = (F.coalesce("n", F.lit(0)) != 1) | F.col("parsed").isNull() | (F.size("parsed") > 12)
    return rows.select("batch_id", "seg_id", F.when(~bad, F.col("parsed")).alias("issues"), F.when(bad, "invalid_issues").alias("audit_error"))


def validated(findings: DataFrame, edited: str = "edited") -> DataFrame:
    """Issues whose span stands in the edited text; how many don't."""
    good = F.filter("issues", lambda i: F.contains(F.col(edited), i["span"]) & (i["span"] != ""))
    return findings.withColumn("rejected_issues", F.size("issues") - F.size(good)).withColumn("issues", good)


def merged_findings(critic: DataFrame, scanned: DataFrame) -> DataFrame:
    """Issues by segment, the critic's first, then the scan's; segments of either."""
    rows = critic.select("seg_id", F.col("issues").alias("a")).join(scanned.select("seg_id", F.col("issues").alias("b")), "seg_id", "full")
    kind = critic.schema["issues"].dataType
    return rows.select("seg_id", F.concat(F.coalesce("a", F.array().cast(kind)), F.coalesce("b", F.array().cast(kind))).alias("issues"))


def with_neighbours(segments: DataFrame, batch: str, order: str, text: str = "text") -> DataFrame:
    """Each segment with the texts before and after it; filter only afterwards."""
    w = Window.partitionBy(batch).orderBy(order)
    return segments.withColumns({"ctx_before": F.lag(text).over(w), "ctx_after": F.lead(text).over(w)})


def repaired(edited: DataFrame, repairs: DataFrame) -> DataFrame:
    """Edited texts with accepted repairs in their place."""
    rows = edited.join(repairs.select("seg_id", F.col("text").alias("_new"), "rejection"), "seg_id", "left")
    return rows.select("seg_id", F.when(F.col("_new").isNotNull() & F.col("rejection").isNull(), F.col("_new")).otherwise(F.col("text")).alias("text"))


def quality_report(findings: DataFrame) -> DataFrame:
    """findings: seg_id, flagged, unresolved, rejected_issues, audit_error."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return findings.agg(
        F.count("*").alias("audited"), n(F.col("flagged")).alias("flagged"), n(F.col("flagged") & ~F.col("unresolved")).alias("repaired"),
        n(F.col("unresolved")).alias("remaining"), n(F.col("audit_error").isNotNull()).alias("audit_errors"), F.coalesce(F.sum("rejected_issues"), F.lit(0)).cast("bigint").alias("rejected_issues"),
    )


def has_hard_defect(defects: DataFrame, key: str) -> DataFrame:
    return defects.groupBy(key).agg(F.bool_or(~F.col("kind").isin("source_residue", "missing_numbers")).alias("hard"))


#: Reasons by which a critic takes a finding back. Fixed values.
NOT_ACTIONABLE = (
    r"\b(?:therefore\s+)?this is not an? (?:error|issue)\b",
    r"\bno (?:issue|inconsistency|strong defect|clear defect|real defect)\b",
    r"\bnot (?:a )?(?:strong|clear|real|actual) defect\b",
    r"\bactually acceptable\b",
    r"\b(?:it|this|the (?:translation|rendering|wording|phrase|form)) is acceptable\b",
    r"\bborderline\b",
    r"\blow[- ]confidence\b",
    r"не является (?:ошибкой|дефектом|проблемой)",
    r"(?:ошибки|проблемы|несоответствия) нет",
    r"не стоит (?:это )?отмечать",
    r"низк\p{L}* уверенн\p{L}*",
    r"(?:это|вариант|форма|склонение) (?:полностью )?(?:корректн\p{L}*|допустим\p{L}*)",
    r"перевод (?:в данном сегменте )?верен",
    r"основани(?:й|я) для исправления нет",
    r"изменени\p{L}*[^.!?]{0,80}(?:противоречит|является ошибк)",
    r"не буду (?:включать|отмечать)[^.!?]{0,80}(?:сомнительн|замечани)",
    r"(?:я )?не уверен",
    r"требуется уточнение",
)
#: What a reason claims, and the span that shows the contrary. Fixed values.
CONTRADICTIONS = (
    (r"(?:после|снаружи|outside|after)[^.!?]{0,50}(?:кавыч|quote)", r"[.!?…]»$"),
    (r"(?:точк|period|full stop)[^.!?]{0,100}(?:внутри|перед закрыва|inside|before the closing)", r"»\.$"),
    (r"тире без пробела|no space after (?:the )?dash", r"—\s+\p{L}"),
    (r"(?:не хватает|отсутствует|требу\p{L}*)[^.!?]{0,50}(?:кавыч|closing quote)", r"^—\s"),
    (r"(?:неверн|некоррект|наруш)[^.!?]{0,80}(?:двоеточ|тире)|(?:двоеточ|тире)[^.!?]{0,80}(?:неверн|некоррект|наруш)", r":\s+—"),
    (r"дефис[^.!?]{0,50}(?:опущен|отсутствует)|(?:опущен|отсутствует)[^.!?]{0,50}дефис", r"-"),
    (r"(?:объедин|слит|merge)[^.!?]{0,80}(?:запят|comma)", r"[.!?…]$"),
)
ROMAN = r"^(?=[IVXLCDM]+$)M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$"


def contradicted(issue: Column, original: Column, edited: Column) -> Column:
    """Whether an issue's reason is refuted by its own span, by itself, or by the two texts (null texts refute nothing)."""
    reason, span = issue["reason"], issue["span"]
    said = lambda p: F.regexp_like(reason, F.lit(f"(?iu){p}"))
    quoted = lambda p, i=1: F.regexp_extract_all(reason, F.lit(f"(?iu){p}"), i)
    forms = F.transform(quoted(r"[«“\"]([^»”\"]+)[»”\"]"), lambda x: F.lower(F.trim(x)))
    found = F.size(F.array_distinct(forms)) < F.size(forms)
    found = found | ((issue["type"] == "semantic_error") & (issue["severity"] == "high") & said(r"перевод (?:в целом |основн\p{L}* )?(?:сохраняет|передаёт) (?:смысл|значение)"))
    for claim, shown in CONTRADICTIONS:
        found = found | (said(claim) & F.regexp_like(span, F.lit(shown)))
    found = found | F.exists(quoted(r"(?:правильн\p{L}*|корректн\p{L}*|следует|требу\p{L}*|предписыва\p{L}*)[^«»]{0,100}«([^»]+)»"), lambda x: F.contains(span, x))
    found = found | F.exists(quoted(r"(?:отсутствует|пропущено|пропущен)\s+(?:слово\s+)?[\"'“«]([^\"'”»]+)[\"'”»]"), lambda x: F.contains(F.lower(span), F.lower(x)))
    heading = (F.trim(original) == F.trim(edited)) & F.trim(original).rlike(ROMAN)
    negative = F.filter(quoted(r"[\"“«]([^\"”»]{2,160})[\"”»]"), lambda q: F.regexp_like(q, F.lit(r"(?i)\b(?:no|not|never|neither|nor|nothing|nobody|nowhere|without)\b|n['’]t\b")))
    cited = F.exists(negative, lambda q: F.contains(F.lower(original), F.lower(q)))
    unproven = said(r"(?:опущен\p{L}* отрицан|missing (?:a |the )?negation)") & original.rlike("[A-Za-z]") & ~cited
    kept = (issue["type"] == "source_language_interference") & F.contains(F.lower(original), F.lower(span)) & (F.contains(edited, F.concat(F.lit("«"), span, F.lit("»"))) | F.contains(edited, F.concat(F.lit("“"), span, F.lit("”"))))
    return found | F.coalesce(heading | unproven | kept, F.lit(False))


def actionable(issue: Column, original: Column, edited: Column) -> Column:
    """Whether an issue (span, type, severity, reason) is one to repair: not taken back and not refuted."""
    withdrawn = F.regexp_like(issue["reason"], F.lit("(?iu)" + "|".join(f"(?:{p})" for p in NOT_ACTIONABLE)))
    return ~withdrawn & ~contradicted(issue, original, edited)


def run_warnings(preflight: DataFrame, findings: DataFrame, failed: DataFrame, defects: DataFrame, repairs: DataFrame, consistency: DataFrame) -> DataFrame:
    """Warnings of each run: preflight(run_id, warnings), findings(run_id, audit_error), failed repairs, defective segments
    (once each, without residue), (batch, segment) rejected or unrepaired (once each), consistency(run_id, warnings)."""
    sum_of = lambda df, c: df.groupBy("run_id").agg(F.sum(c).cast("bigint").alias("n"))
    parts = [
        sum_of(preflight, "warnings"), sum_of(findings.where("audit_error is not null"), F.lit(1)), sum_of(failed, F.lit(1)),
        defects.where("kind <> 'source_residue'").groupBy("run_id").agg(F.countDistinct("seg_id").alias("n")), repairs.groupBy("run_id").agg(F.countDistinct("batch_id", "seg_id").alias("n")), sum_of(consistency, "warnings"),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("run_id").agg(F.sum("n").cast("bigint").alias("warnings"))


def verified_repairs(before: DataFrame, after: DataFrame, issues: DataFrame, defects: DataFrame) -> DataFrame:
    """after(seg_id, text) with what was there before wherever a changed text has a high issue or a defect that says it is
    not translated; reverted: whether it was."""
    changed = after.join(before.select("seg_id", F.col("text").alias("was")), "seg_id", "left")
    broken = issues.where("severity = 'high'").select("seg_id").unionByName(defects.where("kind in ('source_interference', 'untranslated')").select("seg_id")).distinct()
    rows = changed.join(broken.withColumn("_b", F.lit(True)), "seg_id", "left")
    back = F.coalesce("_b", F.lit(False)) & F.col("was").isNotNull() & (F.col("was") != F.col("text"))
    return rows.select("seg_id", F.when(back, F.col("was")).otherwise(F.col("text")).alias("text"), back.alias("reverted"))


def interference_repair(pairs: DataFrame, repair, language: str) -> tuple[DataFrame, DataFrame]:
    """pairs: seg_id, doc_id, seg_pos, source, target. Texts whose scan finds source words left inside are given to repair(rows) -> seg_id,
    text, once more if they come back unchanged, and taken if the gate lets them pass. Texts; attempted, changed, rejected, failed."""
    found = scan(pairs.select("seg_id", "source", "target"), language).where("kind = 'source_interference'").select("seg_id", "spans")
    todo = with_neighbours(pairs, "doc_id", "seg_pos", "target").join(found, "seg_id")
    first = repair(todo)
    same = todo.join(first.select("seg_id", F.col("text").alias("_t")), "seg_id").where(F.col("_t") == F.col("target")).drop("_t")
    again = repair(same)
    answers = todo.select("seg_id", "source", "target").join(first.select("seg_id", F.col("text").alias("_1")), "seg_id", "left").join(again.select("seg_id", F.col("text").alias("_2")), "seg_id", "left")
    answers = answers.withColumn("text", F.coalesce("_2", "_1"))
    refused = repair_rejection(F.col("target"), F.col("text"), F.col("source"))
    state = F.when(F.col("text").isNull(), "failed").when(F.col("text") == F.col("target"), "rejected").when(refused.isNotNull(), "rejected").otherwise("changed")
    judged = answers.withColumn("state", state)
    count = lambda k: F.coalesce(F.sum((F.col("state") == k).cast("int")), F.lit(0)).cast("bigint").alias(k)
    taken = judged.where("state = 'changed'").select("seg_id", F.col("text").alias("_new"))
    texts = pairs.join(taken, "seg_id", "left").select("seg_id", F.coalesce("_new", "target").alias("text"))
    return texts, judged.agg(F.count("*").alias("attempted"), count("changed"), count("rejected"), count("failed"))
