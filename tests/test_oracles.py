"""Every registered query against its SQL in DuckDB, over whole tables."""

import math
import os

import duckdb
import pytest

from tracemill.queries import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
REGISTRY = registry()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def comparable(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(f"{value:.9g}") if isinstance(value, float) else value


def sorted_rows(rows):
    return sorted((tuple(comparable(v) for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_matches_sql(spark, duck, name):
    df = REGISTRY.queries[name](spark, FOLDER)
    columns = sorted(df.columns)
    expected = duck.sql(REGISTRY.sql[name])
    assert columns == sorted(expected.columns)
    ours = sorted_rows(df.select(*[f"`{c}`" for c in columns]).collect())
    theirs = sorted_rows(expected.select(*[f'"{c}"' for c in columns]).fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.sql)))
def test_has_rows(spark, name):
    assert REGISTRY.queries[name](spark, FOLDER).count() > 0
