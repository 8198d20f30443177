"""Every registered query against its SQL on the same tables."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tagloom.plans import oracles  # noqa: E402

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
ORACLES = oracles.ORACLES  # those of the operators in llm are tested there


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    result = entry.queries()[name](spark, FOLDER)
    got = result.collect()
    expected = duck.sql(ORACLES[name])
    names = expected.columns
    want = expected.fetchall()
    assert sorted(result.columns) == sorted(names)
    got, want = rows_of(result.columns, got), rows_of(names, want)
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert not wrong, f"{len(wrong)} rows differ, first: {wrong[0]}"
    assert len(got) > 0


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(entry.queries())
