"""Queries with SQL against DuckDB, on the given tables."""

import duckdb
import pytest

from tidewell.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame, columns):
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(repr(tuple(str(int(v)) if isinstance(v, float) else str(v) for v in r)) for r in clean.itertuples(index=False))


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)


def test_all_ten_are_there():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == [*range(1, 11)]
