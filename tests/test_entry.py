"""Every query with an oracle against DuckDB at the smallest size."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def cells(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def cell(x):
        return f"{x:.6f}" if isinstance(x, float) else str([cell(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert cells(rows, df.columns) == cells(found.fetchall(), columns)
