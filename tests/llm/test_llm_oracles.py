"""Every query of the subpackage that has SQL against that SQL in DuckDB, over whole tables."""

import os

import duckdb
import pytest
from test_oracles import TABLES, sorted_rows

from tracemill.llm.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_matches_sql(spark, duck, name):
    df = REGISTRY.queries[name](spark, FOLDER)
    columns = sorted(df.columns)
    expected = duck.sql(REGISTRY.sql[name])
    assert columns == sorted(expected.columns)
    ours = sorted_rows(df.select(*columns).collect())
    assert ours == sorted_rows(expected.select(*columns).fetchall())
