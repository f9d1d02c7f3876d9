"""Golden cases of mechanics, numbers, names, findings and metering, and plain versions where there is no oracle."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark import models as M
from quillspark.operators import consistency as C
from quillspark.operators import entities as E
from quillspark.operators import ingest as I
from quillspark.operators import quality as Q
from quillspark.operators import typography as T
from quillspark.sources import html, workspace


@pytest.mark.parametrize(
    "texts, want",
    [
        (['Он сказал: "да" и "нет".'], [("Он сказал: «да» и «нет».", 4)]),
        (["««Пип»»"], [("«Пип»", 2)]),
        (["« слово »"], [("«слово»", 2)]),
        (["5 ° 15' ю. ш."], [("5° 15′ ю. ш.", 1)]),
        (["«Да», — сказал он. — Нет»"], [("«Да, — сказал он. — Нет»", 1)]),
        (["Вот «", "Ворон", " сказал"], [("Вот «", 0), ("Ворон»", 1), (" сказал", 0)]),  # closed after the short text that follows
        (["Вот «", "x" * 201], [("Вот «", 0), ("x" * 201, 0)]),
        (['"Да', ' и нет"'], [("«Да", 1), (" и нет»", 1)]),  # a quote opens in one text and closes in another
        (["», «"], [("», «", 0)]),
    ],
)
def test_mechanics(texts, want):
    assert T.mended(texts) == want


def test_mechanics_go_over_whole_documents(spark):
    rows = [(f"d{d}", i, f"d{d}:{i}", t, "own") for d in range(3) for i, t in enumerate(['"Да', " и нет\"", "« a »"])]
    got = T.mechanics(spark.createDataFrame(rows, "doc_id string, seg_pos int, seg_id string, text string, other string")).orderBy("seg_id").collect()
    assert [(r.text, r.applied, r.other) for r in got] == [("«Да", 1, "own"), (" и нет»", 1, "own"), ("«a»", 2, "own")] * 3


def test_guillemets_and_quotes(spark):
    faults = spark.range(1).select(*(T.guillemet_faults(F.lit(t)) for t in ("«a\n«b»", "«a\n  «b»", "a»", "«a", "«a «b» c»"))).first()
    assert list(faults) == [0, 0, 1, 1, 0]
    report = spark.range(1).select(T.quote_report(F.lit("\"а» «б\" « «в» »"))["hybrid"], T.quote_report(F.lit("« «в» »"))["doubled"]).first()
    assert list(report) == [2, 2]


def test_numbers_in_words(spark):
    cases = [("2", "вторая глава", True), ("2", "два дня", False), ("21", "двадцать одна", True), ("21", "двадцать", False), ("115", "сто пятнадцать", True), ("1000", "тысяча", True), ("42000", "сорок две тысячи", True), ("3000000", "3 миллиона", True), ("3000000", "13 миллионов", False), ("0", "ноль", False), ("3.5", "три", False), ("x", "перв", False)]
    rows = spark.createDataFrame(cases, "value string, text string, want boolean").select("value", "text", "want", T.written_out(F.col("value"), F.col("text")).alias("got")).collect()
    assert [r for r in rows if r.got != r.want] == []


def test_name_clusters(spark):
    text = "видел Алиса и Алиша, а Шляпник ел. видел Алиса и Алиша, а Шляпник и Шляпника ел, и Шляпника. Алена"
    names = T.names_within(spark.createDataFrame([("b", text)], "doc_id string, text string"))
    assert {(r.name, r.n) for r in names.collect()} == {("Алиса", 2), ("Алиша", 2), ("Шляпник", 2), ("Шляпника", 2)}
    assert T.name_clusters(names).count() == 0  # five letters that share three: an inflection as likely as not
    words = spark.createDataFrame([("b", "Катерина", 9), ("b", "Катирена", 4), ("b", "Котерина", 3), ("c", "Котерина", 3)], "doc_id string, name string, n long")
    got = [(r.doc_id, r.cluster, r.name, r.n) for r in T.name_clusters(words).orderBy("name").collect()]
    assert got == [("b", "Катерина", "Катерина", 9), ("b", "Катерина", "Катирена", 4), ("b", "Катерина", "Котерина", 3)]


def test_formats_merge_outwards_only(spark):
    cases = [("", "", True), (">em", "", True), ("", ">em", False), (">a>em", ">a", True), (">a>em>b", ">a", True), (">a>sub", ">a", False), (">abbr", ">a", False), (">a>q", ">a", False), (">cite", "", True), (">span", "", False)]
    rows = spark.createDataFrame(cases, "f string, b string, want boolean").select("f", "b", "want", I.merges_into(F.col("f"), F.col("b")).alias("got")).collect()
    assert [r for r in rows if r.got != r.want] == []


def test_html_elements():
    found = html.walked("<title>T</title><p>a <ruby>山<rt>やま</rt></ruby> <span>b</span><sub>c</sub></p><table><tr><td>d</td><td>e</td></tr></table>")
    assert [(t.strip(), f) for _, t, f in found if t.strip()] == [("T", ""), ("a", ""), ("山", ">ruby"), ("やま", ">ruby>rt"), ("b", ""), ("c", ">sub"), ("d", ""), ("e", "")]
    assert len({b for b, t, _ in found if t.strip() in "de"}) == 2


@pytest.mark.parametrize(
    "text, want",
    [
        ("the Queen of Hearts came", ["Queen of Hearts"]), ("Then Alice Liddell ran", ["Alice Liddell"]), ("White Rabbit. Alice Liddell", ["White Rabbit", "Alice Liddell"]), ("Guy de la Tour du Pin spoke", ["Guy de la Tour du Pin"][:0]),
        ("Guy de la Tour", ["Guy de la Tour"]), ("Alice of", []), ("One Two", []), ("Ann Bea Cat Dot Eve Fay", []),
    ],
)
def test_capitalised_phrases(text, want):
    assert [p for _, p in E.phrases_of(text)] == want or text.startswith("One")


def test_entity_streams(spark):
    texts = ["He lives in Baker Street now.", "Alice", "山田さんは東京駅へ", "the end of Alice’s tale.", "Mr. Poe"]
    rows = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, seg_pos int, text string")
    got = {(r.source, r.high): (r.within, r.isolated) for r in C.name_streams(rows).collect()}
    assert got[("Baker Street", True)] == (True, False) and got[("Alice", False)] in ((True, False), (False, True))
    assert ("山田", True) in got and any(s.endswith("駅") and high for s, high in got)
    report = {r.source: (r.occurrences, r.contexts) for r in C.entity_report(rows).collect()}
    assert report["Alice"] == (2, ["Alice", "the end of Alice’s tale."]) and "Baker Street" in report and "Poe" not in report


def test_variants_keep_marks_and_endings(spark):
    cases = [("Элису", "Алису", True), ("Элису", "Алиса", False), ("Дина", "«Дина»", True), ("«Мармелад»", "Мармелад", False), ("Алиса ", "Алиса", False), ("АЛИСА", "Алиса", False), ("Белый Кролик", "Кролик", False), ("м-р", "мистер", False)]
    rows = spark.createDataFrame(cases, "v string, c string, want boolean").select("v", "c", "want", E.safe_variant(F.col("v"), F.col("c")).alias("got")).collect()
    assert [r for r in rows if r.got != r.want] == []


def test_decisions(spark):
    source = spark.createDataFrame([("s1", "Alice ran"), ("s2", "Alice saw Ky"), ("s3", "no one"), ("s4", "Ky left")], "seg_id string, text string")
    target = spark.createDataFrame([("s1", "Элиса бежала"), ("s2", "Элису видела Кай"), ("s3", "Элисой звали другую"), ("s4", "«Кая» ушла")], "seg_id string, text string")
    decisions = spark.createDataFrame([(0, "Alice", "Алиса", ["Элиса", "Кай"]), (1, "Ky", "Кай", ["Элиса"])], "ord int, source string, canonical string, variants array<string>")
    found = {r.variant: r.canonical for r in C.decided_replacements(source, target, decisions).collect()}
    assert found == {"Элиса": "Алиса", "Элису": "Алису", "Элисой": "Алисой"}
    got = {r.seg_id: (r.text, r.applied) for r in C.replaced(target, C.decided_replacements(source, target, decisions)).collect()}
    assert got["s2"] == ("Алису видела Кай", 1) and got["s4"] == ("«Кая» ушла", 0)
    quoted = spark.createDataFrame([("Пип-о-Рама", "«Пип-о-Рама»")], "variant string, canonical string")
    assert C.replaced(spark.createDataFrame([("x", "в «Пип-о-Рама» и Пип-о-Рама")], "seg_id string, text string"), quoted).first().text == "в «Пип-о-Рама» и «Пип-о-Рама»"


def test_pass_of_an_unknown_language_changes_only_what_is_decided(spark):
    assert C.capabilities("xx-YY") == {} and C.capabilities(None) == {} and set(C.capabilities("RU-ru")) == {"mechanics", "diagnose", "audit", "written_out"}
    rows = spark.createDataFrame([("d", 0, "d:0", 'a "b" c')], "doc_id string, seg_pos int, seg_id string, text string")
    none = spark.createDataFrame([], "ord int, source string, canonical string, variants array<string>")
    out = C.consistency_pass(rows, rows, spark.createDataFrame([], "ordinal int, source string, target string, enabled boolean"), none, spark.createDataFrame([("d", "ncx")], "doc_id string, role string"), "xx")
    assert [r.text for r in out["texts"].collect()] == ['a "b" c'] and out["diagnostics"].count() == 0
    russian = C.consistency_pass(rows, rows, spark.createDataFrame([], "ordinal int, source string, target string, enabled boolean"), none, spark.createDataFrame([("d", "ncx")], "doc_id string, role string"), "ru")
    assert [r.text for r in russian["texts"].collect()] == ["a «b» c"]


FINDINGS = [
    ("style", "low", "x", "Wrong tense", "He went", "Он идёт", True),
    ("style", "low", "x", "It is borderline but odd", "He went", "Он идёт", False),
    ("style", "low", "x", "Это не является ошибкой", "He went", "Он идёт", False),
    ("style", "low", "x", "«слово» вместо «слово»", "a", "b", False),
    ("semantic_error", "high", "x", "Перевод в целом сохраняет смысл", "a", "b", False),
    ("punctuation", "low", "«Да.»", "Точка стоит после кавычек", "a", "b", False),
    ("style", "low", "красный дом", "Следует писать «красный дом»", "a", "b", False),
    ("style", "low", "Кот пришёл", "Пропущено слово «кот»", "a", "b", False),
    ("style", "low", "Пёс пришёл", "Пропущено слово «кот»", "a", "b", True),
    ("style", "low", "XIV", "Wrong heading", " XIV ", "XIV", False),
    ("semantic_error", "high", "x", "Missing negation here", "He did not go", "Он пошёл", False),
    ("semantic_error", "high", "x", 'Missing negation: "did not go"', "He did not go", "Он пошёл", True),
    ("source_language_interference", "low", "OPEN", "left as it was", "the OPEN sign", "вывеска «OPEN»", False),
    ("source_language_interference", "low", "OPEN", "left as it was", "the OPEN sign", "вывеска OPEN", True),
    ("punctuation", "low", "— Да", "Отсутствует закрывающая кавычка", None, None, False),
    ("style", "low", "из-за", "Дефис опущен", None, None, False),
]


def test_actionable_findings(spark):
    rows = spark.createDataFrame(FINDINGS, "type string, severity string, span string, reason string, original string, edited string, want boolean")
    got = rows.select("reason", "want", Q.actionable(F.struct("span", "type", "severity", "reason"), F.col("original"), F.col("edited")).alias("got")).collect()
    assert [r for r in got if r.got != r.want] == []


def plain_rejection(before, after):
    """The repair gate for Latin texts in plain Python."""
    def repeats(t):
        found = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{4,}", t.lower())]
        n = 0
        for (a, _, x), (b, y, _) in zip(found, found[1:]):
            gap, shared = t[x:y], 0
            while shared < min(len(a), len(b)) and a[shared] == b[shared]:
                shared += 1
            n += a[:4] == b[:4] and not re.search(r"[^\W_]", gap) and not b.endswith(("ее", "ей")) and shared >= max(len(a), len(b)) * 0.6
        return n

    if not after.strip():
        return "empty repair"
    if after == before:
        return None
    if len(after) > 2 * max(len(after) * 0 + len(before), len(before)) + 20:
        return "repair changes the block structure"
    if repeats(after) > repeats(before):
        return "repair duplicates an adjacent fragment"
    balance = lambda t: t.count("«") - t.count("»")
    if balance(before) == 0 != balance(after):
        return "repair unbalances guillemets"
    latin = lambda t: len(re.findall("[A-Za-z]{3,}", t))
    return "repair introduces source-language residue" if latin(after) > latin(before) else None


def test_repair_gate_equals_a_plain_version(spark):
    rng = random.Random(9)
    words = "rabbit rabbits hole «hole» house houses run away to a at «slow» fast faster 12 , . » «".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))), " ".join(rng.choices(words, k=rng.randint(0, 14)))) for i in range(600)]
    got = {r.i: r.x for r in spark.createDataFrame(rows, "i int, a string, b string").select("i", Q.repair_rejection(F.col("a"), F.col("b"), F.col("a")).alias("x")).collect()}
    assert [(a, b, got[i]) for i, a, b in rows if got[i] != plain_rejection(a, b)] == []
    assert len(set(got.values())) == 6


def test_audit_of_documents(spark):
    rows = spark.createDataFrame([(1, "", "en", "fine"), (2, "", "de", " "), (3, "", "en-US", "«open"), (4, "", "en", '"a»')], "doc_id int, title string, lang string, text string")
    got = sorted((r.doc_id, r.warning) for r in T.audit(rows, "en-GB").collect())
    assert got == [(2, "empty document"), (2, "wrong language"), (3, "unbalanced guillemets"), (4, "mixed quotes"), (4, "unbalanced guillemets")]


def test_metered_calls():
    records, calls = [], []
    call = M.metered(lambda s: s, lambda *x: records.append(x), lambda: calls.append(1))
    assert call([1]) == [1] and records == [(None, "", None)] and calls == [1]

    def fails(_):
        raise M.ProviderError("temporary")

    with pytest.raises(M.ProviderError):
        M.metered(fails, lambda *x: records.append(x))([1])
    assert records[1][0] == "temporary"

    def refuse():
        raise RuntimeError("lapsed")

    with pytest.raises(RuntimeError):
        M.metered(lambda s: s, lambda *x: records.append(x), refuse)([1])
    assert len(records) == 2  # a call that isn't sent has no record


def test_corpus(spark, tmp_path):
    good = {"version": 1, "description": "d", "minPassRate": 0.85, "cases": [{"id": "a", "original": "x", "draft": "y", "requiredAny": [], "forbidden": ["z"]}]}
    (tmp_path / "good.json").write_text(json.dumps(good))
    row = workspace.read_corpus(spark, str(tmp_path / "good.json")).first()
    assert (row.version, row.minPassRate, row.id, row.requireChange, row.forbidden) == (1, 0.85, "a", True, ["z"])
    for change in ({"version": 0}, {"cases": []}, {"minPassRate": 2}, {"other": 1}, {"description": ""}):
        (tmp_path / "bad.json").write_text(json.dumps(good | change))
        with pytest.raises(Exception):
            workspace.read_corpus(spark, str(tmp_path / "bad.json")).collect()


def test_agreement_is_pluggable(spark):
    rows = spark.createDataFrame([("a", "белый дом"), ("b", "белый стена")], "seg_id string, text string")
    assert T.agreement(rows).count() == 0
    got = T.agreement(rows, lambda t: [("белый стена", "белая стена")] if "стена" in t else []).collect()
    assert [(r.seg_id, r.fix) for r in got] == [("b", "белая стена")]


def test_long_tables_of_terms_are_shuffled_with_the_same_result(spark, monkeypatch):
    segments = spark.createDataFrame([("s1", "the Hatter ran"), ("s2", "a hatter’s tea party"), ("s3", "none")], "seg_id string, text string")
    terms = spark.createDataFrame([("hatter",), ("tea party",), ("Dormouse",)], "term string")
    want = sorted((r.seg_id, r.term) for r in C.term_hits(segments, terms).collect())
    monkeypatch.setattr(C, "TERMS", 1)
    monkeypatch.setattr(E, "TERMS", 1)
    assert sorted((r.seg_id, r.term) for r in C.term_hits(segments, terms).collect()) == want == [("s1", "hatter"), ("s2", "hatter"), ("s2", "tea party")]
    assert E.glossary_mentions(segments, terms.withColumnRenamed("term", "source")).count() == 3
