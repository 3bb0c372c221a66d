"""Each analogue query against its SQL in DuckDB."""

import duckdb
import pytest

from tidewell.plans.standins import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame, columns):
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(repr(tuple(float(v) if isinstance(v, float) else str(v) for v in r)) for r in clean.itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_rows_alone(spark, name):
    first, again = (sorted(map(repr, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first and first == again


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
