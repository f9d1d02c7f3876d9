"""Queries against their SQL on small tables that hold what only larger ones do."""

from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.functions import text as X
from quillspark.operators import ingest as I
from quillspark.sources import journal


@pytest.fixture
def equal(spark, tmp_path):
    """Whether a query gives what its SQL gives over tables of (rows, schema)."""

    def compare(name, **tables):
        con = duckdb.connect()
        for table, (rows, schema) in tables.items():
            path = tmp_path / f"{table}.parquet"
            spark.createDataFrame(rows, schema).write.parquet(str(path))
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
        found = con.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in found.description]
        got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).select(*columns).collect()]
        assert sorted(got, key=repr) == sorted(found.fetchall(), key=repr)
        return got

    return compare


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_batches_with_segments_above_the_limit(equal):
    sentence = "x" * 9_998 + ". "
    texts = ["a\n" + sentence * 9 + "\nb\nc", sentence * 5, sentence * 13 + "\n\n" + sentence * 13 + "\nd", "y" * 40_001 + "\nz", "y" * 40_000 + "\n" + "z" * 40_000 + "\n\n", "", None]
    rows = equal("greedy_batches", documents=([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCUMENTS))
    assert [b for d, s, b in sorted(rows) if d == "document-0"] == [1, 2, 3, 3]


def test_segments_above_the_limit_are_cut_on_request(spark):
    rows = spark.createDataFrame([("d", i, t) for i, t in enumerate(("a", "Bbbb. " * 5, "c"))], "doc_id string, seg_pos int, text string")
    numbers = lambda **kw: [r.batch_no for r in I.with_batches(rows, chars=12, **kw).orderBy("seg_pos").collect()]
    assert numbers() == [1, 2, 5] and numbers(cut=False) == [1, 2, 3]


EVENTS = "event_id bigint, ts {}, user_id bigint, event_type string, value double, props string"


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_events_of_one_millisecond_are_numbered_in_order(equal, kind):
    start = datetime(2024, 1, 1, 0, 0, 7, 179_000)
    rows = [(i, start + timedelta(microseconds=(i * 37) % 500), 500 - i, "click", 1.0, "{}") for i in range(100)]
    equal("numbered_events", events=(rows, EVENTS.format(kind)))


def test_events_without_time_user_type_or_id_are_numbered(equal):
    at = datetime(2024, 1, 1)
    rows = [(None, None, 1, "view"), (-5, at, None, "click"), (1, at, 7, None), (2, at, 7, "view"), (3, None, None, None), (4, at, 7, "click")]
    assert len(equal("numbered_events", events=([(*r, 1.0, "{}") for r in rows], EVENTS.format("timestamp_ntz")))) == 6


def test_no_events(equal):
    assert equal("numbered_events", events=([], EVENTS.format("timestamp_ntz"))) == []


def test_journals_keep_microseconds(spark, tmp_path):
    rows = spark.sql("SELECT timestamp '2024-01-01 00:00:07.179575' AS a, timestamp_ntz '1850-01-01 00:00:00.000001' AS b")
    journal.append(rows, str(tmp_path / "log"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "log")).collect() == rows.collect()


def test_ratios_are_rounded_by_their_exact_value(equal):
    lengths = [(s, t) for s in (80, 96, 104, 120, 200, 400) for t in range(1, 4 * s, 2) if not s // 2 <= t <= 2 * s]
    rows = [(i, k, role, x * n) for i, (s, t) in enumerate(lengths) for k, role, x, n in ((0, "user", "s", s), (1, "assistant", "t", t))]
    got = equal("pair_length_ratio", conversations=(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert len(got) == len(lengths)


def test_two_decimals(spark):
    values = [k / 1000 for k in range(5, 4000, 10)] + [k / 8 for k in range(1, 400, 2)] + [0.0, 19.625, 1e7 + 0.125]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.two_decimals("v").alias("t")).collect()
    assert [r.t for r in rows] == [f"{r.v:.2f}" for r in rows]
