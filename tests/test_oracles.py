"""Every query that has SQL is compared with DuckDB on the smallest tables; the others must run."""

import os

import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")

from vicinity.plans import catalog  # noqa: E402

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(records):
    return sorted((tuple(sorted((k, "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)) for k, v in r.items())) for r in records))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
    want = duck.execute(ORACLES[name]).df().to_dict("records")
    assert rows(got) == rows([{k: None if isinstance(v, float) and v != v else v for k, v in r.items()} for r in want])


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 140
