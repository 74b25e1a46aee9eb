"""Distributed ranks against a sort in one place."""

import pytest
from pyspark.sql import functions as F

from knowspark.operators.ranks import numbered, ranked


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_follow_the_order(spark, parts):
    df = spark.range(1000).select(
        "id", F.when(F.col("id") % 10 > 0, F.col("id") * 7919 % 50).alias("v")).repartition(parts)
    got = ranked(df, F.desc_nulls_last("v"), "id").collect()
    want = sorted(df.collect(), key=lambda r: (r.v is None, -(r.v or 0), r.id))
    assert [(r.id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [
        (r.id, i) for i, r in enumerate(want, 1)]


def test_equal_rows_get_places_of_their_own(spark):
    """A third of the rows equal in everything: every place once, over several tasks."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(4500).alias("v"))
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # tiny partitions stay apart
    spark.conf.set(merge, "false")
    got = numbered(df.repartition(5), "v")
    spark.conf.set(merge, "true")
    rows = got.collect()
    assert sorted(r.position for r in rows) == list(range(9000))
    assert [r.v for r in sorted(rows, key=lambda r: r.position)] == sorted(r.v for r in rows)
    files = got.filter("v = 4500").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1


def test_no_rows(spark):
    assert ranked(spark.range(0), "id").collect() == []
