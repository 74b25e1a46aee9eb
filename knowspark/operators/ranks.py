"""Explicit ranks over a whole table, without one task that sees it all.

A rank needs the rows before a row, so a window without partitions is the usual way
and puts every row into one task. Here rows are range-partitioned by the order,
numbered inside their partition, and each partition's offset (the rows of all
partitions before it) is added.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowspark.session import new_work_path

#: monotonically_increasing_id keeps the row's number in so many low bits.
ROW_BITS = 33


def _rows_before(part: Column, counts: dict) -> Column:
    """Rows of all partitions before ``part``, from one folded array."""
    before, offsets = 0, []
    for p in range(max(counts, default=0) + 1):
        offsets.append(before)
        before += counts.get(p, 0)
    return F.get(F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<bigint>"), part)


def numbered(df: DataFrame, *order, out: str = "position") -> DataFrame:
    """``df`` with the place (from 0) of each row in the order.

    The rows are written once, in order, to the work folder. Rows equal in the whole
    order get places of their own and may be spread over partitions. One number per
    partition reaches the driver: no more than the session's shuffle partitions.
    """
    spark = df.sparkSession
    path = new_work_path(spark, "numbered")
    by = [*order, "_tie"]
    df.withColumn("_tie", F.monotonically_increasing_id()) \
        .repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie") \
        .withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    schema = df.withColumn("_at", F.lit(0).cast("long")).schema
    kept = spark.read.schema(schema).parquet(path)
    part = F.shiftright("_at", ROW_BITS).cast("int")
    counts = {r.part: r.n for r in kept.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    row = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return kept.withColumn(out, _rows_before(part, counts) + row).drop("_at")


def ranked(df: DataFrame, *order, out: str = "rank") -> DataFrame:
    """``df`` with ranks from 1; the order should end in a unique column."""
    return numbered(df, *order, out=out).withColumn(out, F.col(out) + 1)


def in_order(df: DataFrame, *order, rank: bool = False) -> DataFrame:
    """``df`` sorted, or, with ``rank``, with its place in the order as a column."""
    return ranked(df, *order) if rank else df.orderBy(*order)
