"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann, bpe, mixing, neardup, pii, quality, secrets, substrings, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _m string, _rest string, score string, n_tokens string"
WORDS = " ".join(f"word{i}" for i in range(80))
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, WORDS, "en", "a"), (4, WORDS, "en", "a"), (5, WORDS, "en", "b"), (None, WORDS + " more", "en", "b"), (6, "one two", "en", None),
    (7, "token = \"abcdefgh12345678\" mail a.b@c.de é\x01\x02 日本", "en", "b"), (8, "x " * 60_000, "en", "c"), (9, "y" * 200_000, "en", "c"), (10, " ".join(f"z{i}" for i in range(30_000)), "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1]) if r[1] else 0, "own", "rest", "s", "t") for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "secrets": secrets.scan,
    "classes": neardup.classes,
    "mix": mixing.mix,
    "deduplicated": substrings.deduplicated,
    "ledger": lambda d: quality.ledger(d.select("doc_id", "text")),
    "encoded": lambda d: bpe.encoded(d.select("doc_id", "text")),
    "pii": pii.scan,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_each(docs, none, name):
    assert OPERATORS[name](docs).count() == len(ROWS)
    assert OPERATORS[name](none).count() == 0


STAGES = {"quality": quality.stage, "neardup": neardup.stage, "pii": pii.stage, "mixing": mixing.stage, "bpe": bpe.stage}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_columns(spark, docs, none, name):
    out = STAGES[name](spark, docs, "")
    if name == "bpe":
        assert set(out.columns) == {*docs.columns, "ids_sha256", "decoded_sha256"} and len(out.columns) == len(set(out.columns))
    else:
        assert out.columns == docs.columns
    rows = out.collect()
    assert all(r["_m"] == "own" and r["_rest"] == "rest" and r["score"] == "s" for r in rows) and rows
    assert STAGES[name](spark, none, "").count() == 0


def test_classes_of_copies(docs):
    got = {}
    for r in neardup.classes(docs).collect():
        got.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(got[1], key=str) == [1, 2]  # null and empty
    assert sorted(map(str, got[4])) == ["4", "4", "5", "None"]


def test_repeated_rows_are_one_in_the_stage(spark, docs):
    kept = [r.doc_id for r in neardup.stage(spark, docs, "").collect()]
    assert kept.count(4) == 1 and 5 not in kept and None not in kept and 1 in kept


def test_equal_texts_lose_all_words(docs):
    got = {(r.doc_id, r.n_words): r.n_removed for r in substrings.deduplicated(docs, text=False).collect()}
    assert got[(4, 80)] == got[(5, 80)] == 80 and got[(None, 81)] == 80 and got[(6, 2)] == 0 and got[(8, 60_000)] == 60_000 and got[(10, 30_000)] == 0


def test_mixing_bounds(docs):
    rows = mixing.mix(docs).collect()
    assert all(0 <= r.copies <= 2 for r in rows)
    again = mixing.mix(docs).collect()
    key = lambda r: (str(r.doc_id), r.text_key, r.copies)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_targets_stop_at_twice_the_size(spark):
    table = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 1000, 1), (None, 0, 1)], "source string, words long, n long")
    got = {r.source: r.target for r in mixing.with_targets(table).collect()}
    assert got["a"] == 20 and got[None] == 0 and abs(sum(got.values()) - 1.5 * 2010) < 1e-6
    assert abs(got["b"] / got["c"] - 2) < 1e-9
    assert mixing.with_targets(table.limit(0)).count() == 0


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.scored(docs.select("doc_id", "text"), toxicity.train(docs, labels)).collect()
    assert len(rows) == len(ROWS) and all(r.score == 0.0 for r in rows)


def test_toxicity_of_ties_and_clashing_columns(spark):
    texts = ["you vile wretch " * 20, "a calm walk by the sea " * 20]
    rows = [(i, texts[i % 2], i % 2 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "own", "mine") for i, t, _ in rows] + [(7, None, "own", "mine"), (7, None, "own", "mine"), (None, "", "own", "mine")], "doc_id long, text string, _x string, score string")
    model = toxicity.train(docs, spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int"))
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) + 3 and all(r["_x"] == "own" and isinstance(r["score"], float) for r in got)
    assert len({r["score"] for r in got}) <= 3 and min(r["score"] for r in got if r["text"] == texts[0]) > 0.9 > max(r["score"] for r in got if r["text"] == texts[1])
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_clashing_columns_give_way_or_pass(docs):
    found = quality.ledger(docs.withColumn("fail_bits", F.lit("own")))
    assert set(found.columns) == {*docs.columns, "measures", "fail_bits"} and found.where("_m <> 'own' or fail_bits < 0").count() == 0
    found = bpe.encoded(docs.withColumn("_bpe", F.lit("own")))
    assert set(found.columns) == {*docs.columns, "_bpe"} and found.where("_m <> 'own' or _bpe.n_tokens < 0").count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.5]), (None, [1.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = {q: [(r.vec_id, r.score) for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] for q in (0, 20)}
    assert found[0] == [(8, 2.0), (6, 1.0), (7, 1.0), (20, 0.0)]
    assert found[20] == [(8, 0.5), (0, 0.0), (6, 0.0), (7, 0.0)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_that_repeat_an_id(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist(), "own") for i in range(300)]
    rows += [(20, rng.normal(size=8).tolist(), "own"), (40, rows[40][1], "own"), (7, rows[7][1], "own")]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string"), every=20).collect()
    for q, x in ((20, rows[20][1]), (20, rows[300][1]), (40, rows[40][1]), (60, rows[60][1])):
        true = sorted((-float((np.array(x) * np.array(v)).sum()), i) for i, v, _ in rows if i != q)[:20]
        mine = sorted((r.rank, r.vec_id, round(r.score, 9)) for r in got if r.query_id == q)
        times = 2 if q in (20, 40) else 1
        assert [r for r, _, _ in mine] == sorted([*range(1, 21)] * times)
        hits = sum((j + 1, i, round(-s, 9)) in mine for j, (s, i) in enumerate(true))
        assert hits >= 15 or {i for _, i in true} <= {i for _, i, _ in mine}


def test_outliers_beside_tight_clusters_have_all_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i + 1, (np.eye(8)[i % 8] * 10 + rng.normal(size=8) * 0.01).tolist()) for i in range(2000)] + [(20 * (200 + i), (rng.normal(size=8) * 50).tolist()) for i in range(5)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    count = {r.query_id: r["count"] for r in got.groupBy("query_id").count().collect()}
    assert len(count) == len([1 for i, _ in rows if i % 20 == 0]) and set(count.values()) == {20}


def test_equal_vectors_tie_by_id(spark):
    rows = [(i, [0.1, 0.7, 0.3]) for i in range(400)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert [r.vec_id for r in got.where("query_id = 20").orderBy("rank").collect()] == list(range(20))


def test_warc(spark, tmp_path):
    big = "b" * (17 << 20)  # a member that doesn't end with a zero byte by itself
    rows = [(1, "http://a/\n", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", big), (2, "v", "x"), (None, "w", "x"), (6, "é", "y\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "w")).collect())
    assert got == sorted([("1", 1, "response", None), ("2", 1, "revisit", 1), ("2", 1, "revisit", 1), ("None", 1, "revisit", 1), ("3", 0, "response", None), ("4", 0, "revisit", 3), ("5", len(big), "response", None), ("6", 13, "response", None)])
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    bodies = {r[0]: r[5] for r in warc.read_archive(data, payloads=True) if r[3] == "response"}
    assert bodies[6] == b"y\r\n\r\nWARC/1.1" and bodies[5] == big.encode()
    with pytest.raises(ValueError):
        list(warc.read_archive(data[: len(data) // 2]))
    warc.write(pages.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0
