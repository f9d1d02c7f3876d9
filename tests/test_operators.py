"""Exact expectations on literals, and differential tests against plain Python."""

import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark import models as M
from quillspark.functions import text as X
from quillspark.operators import entities as E
from quillspark.operators import evals as V
from quillspark.operators import ingest as I
from quillspark.operators import quality as Q
from quillspark.operators import reports as R
from quillspark.operators import typography as T
from quillspark.sources import epub, html, journal, workspace


def scan(spark, rows, language=None):
    pairs = spark.createDataFrame([(str(i), s, t) for i, (s, t) in enumerate(rows)], "seg_id string, source string, target string")
    out = {str(i): [] for i in range(len(rows))}
    for r in Q.scan(pairs, language).collect():
        out[r.seg_id].append((r.kind, r.detail))
    return [[k for k, _ in sorted(out[str(i)])] for i in range(len(rows))], out


def test_defect_kinds(spark):
    same = "The rabbit went into the hole and was not seen for many a day."
    cases = [("The room was cold.", "   "), ("  ", ""), (same, same), ("Chapter 4", "Chapter 4"), ("x" * 200, "x" * 79), ("y" * 200, "z" * 500), ("y" * 200, "z" * 240)]
    kinds, details = scan(spark, cases)
    assert kinds == [["empty"], [], ["untranslated"], [], ["length_ratio"], ["length_ratio"], []]
    assert details["5"][0][1] == "translation is 2.50× the length of the original"


def test_numbers(spark):
    cases = [("12 years and 3 days", "12 лет"), ("$5,000", "$5000"), ("1,250 men", "1 250"), ("3.14", "3,14"), ("until 1 reached the hall", "пока"), ("a ’49 car", "1949 года"), ("H₂O and 2", "H2O 2")]
    kinds, details = scan(spark, cases)
    assert kinds == [["missing_numbers"], [], [], [], [], [], []]
    assert details["0"][0][1].endswith(": 3")


def test_residue_and_interference(spark):
    kinds, _ = scan(spark, [("he bowed formally to her", "он formally поклонился ей"), ("he bowed formally", "он поклонился (formally) ей низко"), ("words remain", "это слово remain words стоит рядом")], "ru")
    assert kinds[0] == ["source_interference"]
    assert kinds[1] == ["source_residue"]
    assert "source_interference" not in kinds[2]


def test_scan_report_without_defects(spark):
    row = Q.scan_report(Q.scan(spark.createDataFrame([], "seg_id string, source string, target string"))).collect()
    assert len(row) == 1 and row[0].defect_segments == 0


def test_usage_counts_attempts(spark):
    rows = [(i, f"c{i}", op, out, 10, t) for i, (op, out, t) in enumerate([("d:0", "timeout", None), ("d:0", "timeout", None), ("d:0", "ok", 15), ("d:9", "ok", 15), (None, "ok", 1)])]
    usage = spark.createDataFrame([(a, c, "r", "editing", o, "p", "e", "m", out, n, 0, 5, t) for a, c, o, out, n, t in rows], "append_seq long, call_id string, run_id string, stage string, operation string, profile string, endpoint string, model string, outcome string, prompt_tokens long, cached_prompt_tokens long, completion_tokens long, total_tokens long")
    r = R.usage_totals(R.usage_breakdown(usage)).first()
    assert (r.requests, r.logical_operations, r.retried_operations, r.timeouts, r.requests_with_usage, r.total_tokens) == (5, 3, 1, 2, 3, 31)
    assert R.lifetime(usage).count() == 0


def plain_batches(texts, chars, most):
    out, no, n, count = [], 0, 0, 0
    for t in texts:
        if not count or n + len(t) > chars or count >= most:
            no, n, count = no + 1, 0, 0
        n, count = n + len(t), count + 1
        out.append(no)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 10), min_size=1, max_size=30))
def test_batches_match_a_plain_loop(spark, lengths):
    texts = ["a" * n for n in lengths]
    rows = spark.createDataFrame([("d", i, f"d:{i}", t) for i, t in enumerate(texts)], "doc_id string, seg_pos int, seg_id string, text string")
    got = [r.batch_no for r in I.with_batches(rows, chars=10, most=3).orderBy("seg_pos").collect()]
    assert got == plain_batches(texts, 10, 3)


def test_chunks_and_remerge_are_lossless(spark):
    text = "One two three. Four five! Six seven eight nine? Ten."
    rows = spark.createDataFrame([("d", 0, "d:0", text)], "doc_id string, seg_pos int, seg_id string, text string")
    parts = I.with_chunks(rows, 20)
    assert all(len(r.text) <= 23 for r in parts.collect()) and parts.count() > 1
    assert I.remerged(parts).first().text == text


def test_logical_units(spark):
    rows = [("d", 1, 0, "d:0", "The", ">span"), ("d", 1, 1, "d:1", "end", ">span>em"), ("d", 1, 2, "d:2", "!", ">span"), ("d", 2, 3, "d:3", "New", "")]
    got = I.logical_units(spark.createDataFrame(rows, "doc_id string, block int, seg_pos int, seg_id string, text string, format string")).orderBy("seg_id").collect()
    assert [(r.seg_id, r.members, r.text) for r in got] == [("d:0", 3, "The end!"), ("d:3", 1, "New")]


@pytest.mark.parametrize("name, error", [("a/b.xhtml", None), ("../x", "path escapes the archive"), ("a/../../x", "path escapes the archive"), ("/x", "absolute path"), ("c:x", "absolute path"), ("a\\b", "forbidden character"), ("", "empty name"), ("a/..", "path escapes the archive")])
def test_entry_names(spark, name, error):
    assert spark.range(1).select(I.entry_name_error(F.lit(name))).first()[0] == error


def test_html_walk():
    found = html.walked("<body><h1>A <em>b</em></h1><p>c<br>d<script>x</script></p><p translate='no'>e</p>f")
    assert [t for _, t, _ in found] == ["A ", "b", "c", "d", "f"]
    assert found[0][0] == found[1][0] != found[2][0] != found[3][0]
    assert found[1][2] == ">em"


def test_repair_gate(spark):
    rows = [("a«b»", "", "empty repair"), ("text", "text", None), ("word", "w" * 40, "repair changes the block structure"), ("«слово» тут", "слово» тут", "repair unbalances guillemets"), ("слово одно", "слово formally", "repair introduces source-language residue"), ("У Кролика были", "У кролика кролик", "repair duplicates an adjacent fragment")]
    df = spark.createDataFrame(rows, "edited string, repaired string, want string")
    for r in df.select("want", Q.repair_rejection(F.col("edited"), F.col("repaired"), F.col("edited")).alias("got")).collect():
        assert r.got == r.want


def test_text_functions(spark):
    row = spark.range(1).select(
        X.slug(F.lit("Hello, World! 2")), X.redacted(F.lit("api_key = abc123 and sk-ABCDEFGHIJ")), X.expected_expansion(F.lit("山嵐が来た")), X.dominant_script(F.lit("абв abc")),
        X.occurrences(F.lit("aaaa"), F.lit("aa")), X.mentions(F.lit("A Hatter’s tea"), F.lit("hatter")), X.mentions(F.lit("Hatters"), F.lit("hatter")), X.shared_prefix(F.lit("норе"), F.lit("норы")), X.collapsed(F.lit(" a  b\n")),
    ).first()
    assert list(row) == ["hello-world-2", "api_key=[redacted] and [redacted]", 3, "none", 2, True, False, 3, "a b"]


def test_entities(spark):
    texts = ["The Hatter met the Dormouse.", "A Hatter's tea, said the Dormouse. The table", "the table and a mouse"]
    rows = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, seg_pos int, text string")
    got = {r.source: r.occurrences for r in E.top_entities(E.evidence(rows)).collect()}
    assert got == {"Hatter": 2, "Dormouse": 2}


def test_stems_and_variants(spark):
    row = spark.range(1).select(E.stem(F.lit("Элису")), E.stem(F.lit("Ниной")), E.stem(F.lit("кот")), E.safe_variant(F.lit("Элису"), F.lit("Алису")), E.safe_variant(F.lit("Элиса"), F.lit("Алису"))).first()
    assert list(row) == ["Элис", "Нин", "кот", True, False]


def test_replacement_is_single_pass(spark):
    rows = spark.createDataFrame([("Ann met Anna. ANN!",)], "text string")
    got = E.replaced_terms(rows, {"Ann": "Anna", "Anna": "Ann"}).first()
    assert (got.replaced, got.applied) == ("Anna met Ann. Anna!", 3)


def test_typography(spark):
    row = spark.range(1).select(T.guillemet_faults(F.lit("«a\n«b»")), T.guillemet_faults(F.lit("a»")), T.duplicated_fragments(F.lit("У кролика кролике было"))).first()
    assert list(row) == [0, 1, ["кролика кролике"]]


def test_stratified_takes_turns(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([100] * 5 + [300] * 5 + [900] * 5)], "id long, length long")
    got = V.stratified(rows, "s", 6).collect()
    assert sorted(r.bucket for r in got) == [0, 0, 1, 1, 2, 2]


def test_models():
    calls = []

    def call(segments):
        calls.append(len(segments))
        if sum(len(t) for _, t in segments) > 10:
            raise M.ProviderError("request_too_large")
        return [(i, t.upper()) for i, t in segments]

    assert M.complete([("a", "one"), ("b", "two three four")], call) == [("a", "ONE"), ("b", "TWO THREE FOUR")]
    assert M.may_retry("temporary", 3) and not M.may_retry("invalid_response", 2) and M.delay_ms(20) == 30_000
    registry = M.Registry()
    registry.add("x", object)
    assert registry.get("x") is registry.get("x")
    with pytest.raises(ValueError):
        registry.add("x", object)


def test_journal_skips_bad_lines_and_ledger_fails(spark, tmp_path):
    (tmp_path / "j.ndjson").write_text('{"a": 1}\n\n{"a": 2\n{"a": 3}\n')
    assert sorted(r.a for r in journal.read_journal(spark, str(tmp_path / "j.ndjson"), "a int").collect()) == [1, 3]
    assert journal.read_journal(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(Exception):
        journal.read_ledger(spark, str(tmp_path / "j.ndjson"), "a int").collect()
    journal.append(spark.createDataFrame([(4,)], "a int"), str(tmp_path / "out"))
    journal.append(spark.createDataFrame([(5,)], "a int"), str(tmp_path / "out"))
    assert journal.read_journal(spark, str(tmp_path / "out"), "a int").count() == 2


def test_jobs_folder(spark, tmp_path):
    for name, body in (("a", {"id": "a", "updated_at": "1"}), ("b", {"id": "b", "updated_at": "2"}), ("c", None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(json.dumps(body) if body else "{broken")
    assert [r.id for r in journal.read_jobs(spark, str(tmp_path), "id string, updated_at string").collect()] == ["b", "a"]


def test_epub_round_trip(spark, tmp_path):
    files = {"mimetype": b"application/epub+zip", "META-INF/container.xml": b'<container><rootfiles><rootfile full-path="c.opf"/></rootfiles></container>', "c.opf": b'<package><metadata><title>T</title><language>en</language></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>', "a.xhtml": b"<p>x</p>"}
    built = epub.build(spark.createDataFrame([("book", n, bytearray(d)) for n, d in files.items()], "archive string, name string, data binary")).first().content
    assert zipfile.ZipFile(io.BytesIO(built)).namelist()[0] == "mimetype"
    (tmp_path / "b.epub").write_bytes(bytes(built) + b"\0")
    (tmp_path / "bad.epub").write_bytes(b"nothing")
    entries = epub.scan_entries(spark, str(tmp_path))
    assert entries.where("name is null").count() == 1 and entries.where("name is not null").count() == 4
    read = epub.extract(spark, str(tmp_path), entries.where("name = 'mimetype'").select("archive"))
    package = epub.packages(read)
    assert [r.title for r in package.collect()] == ["T"]
    kinds = read.where("name = 'mimetype'").select("archive", F.col("data").cast("string").alias("mimetype"))
    assert [r.fault for r in epub.validation(package, kinds).collect()] == ["spine item not in manifest: b"]
    assert epub.flattened_ruby("<ruby>山嵐<rp>(</rp><rt>やまあらし</rt><rp>)</rp></ruby>が") == ("山嵐が", {"山嵐": "やまあらし"})


def test_workspace(spark, tmp_path):
    (tmp_path / "manifest.yaml").write_text("schema_version: 1\nchapters:\n  - slug: one\n    title: First\n    file: one.md\n")
    (tmp_path / "one.md").write_text("Hello\n")
    assert [(r.slug, r.text) for r in workspace.read_chapters(spark, str(tmp_path)).collect()] == [("one", "Hello\n")]
    for bad in ("schema_version: 2\nchapters:\n  - slug: a\n", "schema_version: 1\n", "schema_version: 1\nchapters:\n  - slug: a\n  - slug: a\n", "schema_version: 1\nchapters:\n  - slug: a\n    file: ../a\n"):
        with pytest.raises(ValueError):
            workspace.parse_manifest(bad)
    assert workspace.canon_names([{"id": "1", "type": "place", "name": "Rye", "in": [{"id": "1", "type": "ship", "name": "Ann"}]}]) == [("1", "Ann", "ship")]


def test_near_pairs_that_differ_at_both_ends(spark):
    from quillspark.operators import entities

    names = ["Katerina", "Caterine", "Katarina", "Marta", "Narto", "Miriam"]
    found = entities.near_pairs(spark.createDataFrame([(n, 2) for n in names], "name string, n long"))
    assert {(r.name, r.other) for r in found.collect()} == {("Caterine", "Katerina"), ("Katarina", "Katerina"), ("Marta", "Narto")}
