"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from callweave.plans import snapshot_queries, source_queries  # noqa: F401  they register their queries with the others
from callweave.plans.driver_queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect())))
    order = [want.columns.index(c) for c in columns]
    assert rows == sorted(map(repr, (tuple(r[k] for k in order) for r in want.fetchall())))
    assert rows
