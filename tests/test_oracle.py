"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from knowspark.plans.oracle import ORACLE as CORE_ORACLE
from knowspark.plans.queries import QUERIES as CORE

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
         "boolean": "BOOLEAN"}
QUERIES, ORACLE = {k: entry.queries()[k] for k in CORE}, CORE_ORACLE
ROWS_ONLY = set()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if name in ROWS_ONLY:
        assert got
        return
    result = duck.execute(ORACLE[name])
    types = {d[0]: str(d[1]) for d in result.description}
    place = [d[0] for d in result.description]
    assert sorted(place) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    want = [tuple(r[place.index(c)] for c in columns) for r in result.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert got, "an empty result checks nothing"


def test_entry(spark):
    assert entry.entry(spark).count() == 8
