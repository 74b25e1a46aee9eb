"""Sharding by sampled splitters, in DataFrame operations only.

Law ``bytes``: shards of near equal size. Records are ordered by (hash of the
text, doc_id), so equal texts stand together; a sample drawn in proportion to
size gives the splitters that cut this order into ranges; a range that came out
overfull is cut again by splitters from a sample of its own. Each record's place
is then the exact sum of all sizes before it: whole ranges from a small table,
its own range by a window. Shard ``floor(place * shards / total)`` holds its
share of the bytes up to one record at either end.

NULL texts count as empty (size 1, CRC of no bytes). Equal rows are told apart by
a number given when the records are written, so any range can be cut. Rows with a NULL doc_id come first. Extra columns
are ignored. An empty table gives an empty result. With fewer records than
shards some shards stay empty.

What reaches the driver: the sampled keys, ``KEYS_PER_RANGE`` per range on average,
and one row per range, of which there are ``MAX_RANGES`` and those cut again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from knowspark.llm.scratch import written

#: Bytes of text a range should hold; its records (about 40 bytes each) meet in one task.
RANGE_BYTES = 1 << 30
#: Fewest ranges, most ranges, and sampled keys per range.
MIN_RANGES, MAX_RANGES, KEYS_PER_RANGE = 128, 1 << 16, 32
#: A range beyond so many times the mean is cut again.
OVERFULL = 2.0
#: Rounds of cutting overfull ranges.
ROUNDS = 3


def _numbers(values) -> Column:
    """A constant array of longs, folded once, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _place(splitters: list) -> Column:
    """How many splitters are below or at the record's key, by binary search."""
    if not splitters:
        return F.lit(0)
    h, d, i = map(_numbers, zip(*splitters))
    steps, step = [], 1
    while step <= len(splitters):
        steps.insert(0, step)
        step *= 2

    def reaches(at):
        same_h, same_d = F.get(h, at) == F.col("h"), F.get(d, at) == F.col("d")
        return (F.get(h, at) < F.col("h")) | (same_h & (F.get(d, at) < F.col("d"))) \
            | (same_h & same_d & (F.get(i, at) <= F.col("i")))

    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, s: F.when((at + s <= len(splitters)) & reaches(at + s - 1), at + s).otherwise(at))


def _splitters(records: DataFrame, total: int, ranges: int, seed: int) -> list:
    """Quantile boundaries of a sample in which a record's chance grows with its
    size; the chance comes from its key, so a repeated task draws the same."""
    rate = ranges * KEYS_PER_RANGE / max(total, 1)
    draw = F.pmod(F.xxhash64("h", "d", "i", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    sample = records.filter(draw < F.col("size") * rate).select("h", "d", "i")
    keys = sorted(tuple(r) for r in sample.collect())  # about ranges * KEYS_PER_RANGE
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


def shard_bytes(documents: DataFrame, shards: int = 16, seed: int = 0,
                range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every document with its size, CRC, shard and gapless place in the shard."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    records = written(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"),
        F.monotonically_increasing_id().alias("i")), "shard-records")
    total = records.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = min(max(MIN_RANGES, -(-total // range_bytes)), MAX_RANGES)
    splitters = _splitters(records, total, ranges, seed)

    def counted():
        return records.withColumn("range", _place(splitters)).groupBy("range") \
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()

    found = counted()
    for again in range(1, ROUNDS + 1):
        full = [r for r in found if r.bytes > OVERFULL * total / ranges and r.n > 1]
        if not full:
            break
        inside = records.filter(_place(splitters).isin([r.range for r in full]))
        more = _splitters(inside, total, ranges * 2, seed + again)
        if set(more) <= set(splitters):
            break
        splitters = sorted(set(splitters) | set(more))
        found = counted()

    before, offsets = [0, 0], {}
    for r in sorted(found, key=lambda r: r.range):
        offsets[r.range] = tuple(before)
        before = [before[0] + r.bytes, before[1] + r.n]
    count = (max(offsets) if offsets else 0) + 1
    start = lambda k: F.get(
        _numbers(offsets.get(i, (0, 0))[k] for i in range(count)), F.col("range"))
    within = Window.partitionBy("range").orderBy("h", "d", "i")
    placed = written(
        records.withColumn("range", _place(splitters))
        .withColumn("at", start(0) + F.sum("size").over(
            within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("row", start(1) + F.row_number().over(within) - 1)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(
            (F.col("at") + F.col("size") / 2) * shards / max(total, 1))).cast("int")),
        "shard-placed")
    firsts = {r.shard: r.first for r in  # one row per shard
              placed.groupBy("shard").agg(F.min("row").alias("first")).collect()}
    first = F.get(_numbers(firsts.get(s, 0) for s in range(shards)), F.col("shard"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         (F.col("row") - first).alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
