"""Joins whose table side a bitmap of the ids cuts down first."""

import pytest
from pyspark.sql import functions as F

from knowspark.operators import reduced


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(20_000).select(
        F.when(F.col("id") % 100 > 0, F.concat(F.lit("k"), F.col("id"))).alias("key"),
        F.col("id").alias("_b"), F.lit("x").alias("v"))


def ids_of(spark, n):
    """Every 17th key (some are not there), twice, and NULL."""
    ids = spark.range(n).select(F.concat(F.lit("k"), F.col("id") * 17).alias("key"))
    return ids.unionByName(ids).unionByName(spark.createDataFrame([(None,)], "key string"))


@pytest.mark.parametrize("n", [0, 1, 300, 5000])
def test_as_the_plain_joins(spark, table, n):
    table = table.withColumnRenamed("_b", "number")
    ids = ids_of(spark, n)

    def rows(df):
        assert df.columns == table.columns
        return sorted(map(repr, df.collect()))

    assert rows(reduced.semi_join(table, ids, "key")) == rows(table.join(ids, "key", "left_semi"))
    assert rows(reduced.anti_join(table, ids, "key")) == rows(table.join(ids, "key", "left_anti"))


def test_few_rows_are_left_to_join(spark, table):
    table = table.withColumnRenamed("_b", "number")
    ids = ids_of(spark, 300)
    wanted = table.join(ids, "key", "left_semi").count()
    left = reduced.flagged(table, ids, "key").filter("_maybe").count()
    assert wanted <= left < wanted + 0.1 * 20_000


def test_the_filter_stands_below_the_shuffle(spark, table):
    table = table.withColumnRenamed("_b", "number")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = reduced.semi_join(table, ids_of(spark, 300), "key")._jdf.queryExecution() \
        .executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join, rest = plan.split("SortMergeJoin", 1)
    table_side = rest.split("Exchange hashpartitioning(key", 2)[1]
    assert "Filter" in table_side and "BroadcastHashJoin" in table_side


def test_bits():
    assert reduced.bits_for(0) == reduced.BUCKET_BITS
    assert reduced.bits_for(10 ** 6) == 1 << 24
    assert reduced.bits_for(10 ** 12) == reduced.MOST_BITS
