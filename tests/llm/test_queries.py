"""The registered queries: SQL where it exists, whole tables, stable schemas."""

import duckdb
import pytest

import __spark_entry__ as entry
from knowspark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SPARK_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN", "int": "INTEGER",
               "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = duck.execute(ORACLE[name])
    place = [d[0] for d in result.description]
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(place) == columns
    assert {c: SPARK_TYPES[t] for c, t in df.dtypes} == {
        d[0]: str(d[1]) for d in result.description}
    want = [tuple(r[place.index(c)] for c in columns) for r in result.fetchall()]
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and got


def test_all_are_registered():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["op2_mixing", "op9_decontaminate", "op10_sharding"])
def test_whole_tables(spark, name):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES[name](spark, SF).collect()
    if name == "op9_decontaminate":
        benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
        exact = {(d.doc_id, b.item_id) for d in documents.collect() for b in benchmark
                 if b.text in d.text}
        assert exact and exact <= {(r.doc_id, r.item_id) for r in rows}
    else:
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.collect())
