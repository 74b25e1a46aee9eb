"""Joins with large sets of ids whose table side is cut down before it is shuffled.

The ids are hashed to a bitmap, 4 KB a bucket, which is broadcast; a row of the table
whose bit is not set cannot be among them. What is left, the wanted rows and about
one of ``BITS_PER_ID`` others, goes through the exact join, so only that is shuffled.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per id, and most bits: 32 MB in every task. Beyond 16 million ids more rows
#: than one in sixteen pass for nothing; results do not change.
BITS_PER_ID, MOST_BITS = 16, 1 << 28
#: Bits of one bucket of Spark's bitmaps.
BUCKET_BITS = 32_768


def bits_for(ids: int) -> int:
    bits = BUCKET_BITS
    while bits < min(ids * BITS_PER_ID, MOST_BITS):
        bits *= 2
    return bits


def _bit(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits))


def _set(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (position / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.get(F.array(*[F.lit(1 << i) for i in range(8)]), (position % 8).cast("int")) \
        .bitwiseAND(byte) > 0


def flagged(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``table`` with ``_maybe``: false only where the key is not in ``ids(key)``.

    The distinct ids are counted first, approximately; their bitmap has a proven size.
    """
    found = ids.agg(F.approx_count_distinct(key)).first()[0]
    bits = bits_for(found)
    bitmap = ids.filter(F.col(key).isNotNull()).select(_bit(key, bits).alias("_b")) \
        .groupBy(F.bitmap_bucket_number("_b").alias("_bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_b")).alias("_bitmap"))
    at = table.withColumn("_b", _bit(key, bits))
    joined = at.join(F.broadcast(bitmap), F.bitmap_bucket_number("_b") == F.col("_bucket"), "left")
    maybe = _set(F.col("_bitmap"), F.bitmap_bit_position("_b")) & F.col(key).isNotNull()
    return joined.select(*table.columns, F.coalesce(maybe, F.lit(False)).alias("_maybe"))


def semi_join(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``ids(key)``."""
    return flagged(table, ids, key).filter("_maybe").drop("_maybe").join(
        ids.distinct(), key, "left_semi").select(*table.columns)


def anti_join(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``ids(key)``: those whose bit is not set stay where
    they are, the others go through the join."""
    known = flagged(table, ids, key)
    rest = known.filter("_maybe").join(ids.distinct(), key, "left_anti")
    return known.filter("NOT _maybe").select(*table.columns).unionByName(rest.select(*table.columns))
