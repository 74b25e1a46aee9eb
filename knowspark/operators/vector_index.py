"""Vector indexes: sketches for approximate search, pivot cells for exact search."""

import math
from dataclasses import dataclass
from hashlib import md5
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from knowspark.functions.vectors import matrix_of, unit_rows
from knowspark.operators.items import unified_items
from knowspark.operators.search import (
    Grid, grid_for, nearest_in_parts, nearest_on_grid, top_per_query, vector_bytes)
from knowspark.session import new_work_path
from knowspark.sources.store import Store

# Sketches: approximate ---------------------------------------------------------

#: Planes of a sketch: four sets of 64, drawn independently of each other.
BITS = 256
#: Neighbours at this similarity are found with the chance that ``SURE`` standard
#: deviations give (1.28: nine of ten); nearer ones more often.
SIMILARITY, SURE = 0.25, 1.28


def planes(count: int, dims: int) -> np.ndarray:
    """Fixed hyperplanes: entry ``(p, d)`` is +1 where the md5 of ``p:d`` (``d`` from
    1) begins with a digit below 8, else -1."""
    return np.array([[1.0 if md5(f"{p}:{d}".encode()).hexdigest()[0] < "8" else -1.0
                      for d in range(1, dims + 1)] for p in range(count)])


def differing(bits: int = BITS, similarity: float = SIMILARITY, sure: float = SURE) -> int:
    """Planes in which two vectors of this similarity may differ.

    A plane parts two vectors with chance angle / pi, so the number that do is
    binomial; unrelated vectors differ in half of the planes.
    """
    p = math.acos(similarity) / math.pi
    return min(bits, math.floor(bits * p + sure * math.sqrt(bits * p * (1 - p))))


def sketch_of(vector, bits: int = BITS) -> Column:
    """On which side of each plane a vector lies, as words of 64 bits."""

    @F.arrow_udf(ArrayType(LongType()))
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drawn = None
        for vectors in batches:
            present = np.asarray(vectors.is_valid())
            words = np.zeros((len(vectors), bits // 64), dtype=np.uint64)
            if present.any():
                known = vectors.drop_null()
                rows = matrix_of(known, len(known[0]))
                if drawn is None or drawn.shape[1] != rows.shape[1]:
                    drawn = planes(bits, rows.shape[1])
                sides = (rows @ drawn.T >= 0).reshape(len(rows), -1, 64)
                words[present] = (sides * (np.uint64(1) << np.arange(64, dtype=np.uint64))) \
                    .sum(axis=2, dtype=np.uint64)
            yield pa.array([w if known else None for w, known in
                            zip(words.view(np.int64).tolist(), present)], pa.list_(pa.int64()))

    return sketch(vector)


@dataclass(frozen=True)
class VectorIndex:
    """Embedded items with their sketches."""

    path: str
    bits: int

    def items(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/items")


def build_index(store: Store, path: str, bits: int = BITS) -> VectorIndex:
    """Write every embedded item with its sketch; nothing is fitted or shuffled."""
    items = unified_items(store, embedding=True).filter(
        F.col("embedding").isNotNull() & F.exists("embedding", lambda v: v != 0)) \
        .select("id", "embedding")
    items.withColumn("sketch", sketch_of(F.col("embedding"), bits)) \
        .write.mode("errorifexists").parquet(f"{path}/items")
    items.sparkSession.range(1).select(F.lit(bits).alias("bits")).write.parquet(f"{path}/bits")
    return VectorIndex(path, bits)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(path, spark.read.parquet(f"{path}/bits").first()[0])


def search_approx(
        spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int = 10,
        similarity: float = SIMILARITY, sure: float = SURE, key: str = "query_id",
        vector: str = "vector", grid: Grid = None) -> DataFrame:
    """Nearest items among those whose sketch differs from the query's in at most
    :func:`differing` planes.

    Which pairs pass is up to the sketches alone (words of 64 bits; 256 bits are 32
    bytes, a vector of 384 numbers 1,536). They are compared for a part's first items,
    then only for pairs that a product in 4-byte numbers leaves among the k best.
    Similarities are exact. With ``similarity=-1`` all pairs pass and the result is exact.
    """
    differ = index.bits if similarity <= -1 else differing(index.bits, similarity, sure)
    items = index.items(spark).withColumn("tags", F.lit(None).cast("array<string>"))
    asked = queries.filter(F.col(vector).isNotNull()).select(
        F.col(key).cast("string").alias("id"), F.col(vector).alias("vector")) \
        .withColumn("sketch", sketch_of(F.col("vector"), index.bits))
    if grid is None:
        grid = grid_for(items.count(), queries.count(),
                        int(spark.conf.get("spark.sql.shuffle.partitions")), vector_bytes(items))
    return nearest_on_grid(items, asked, k, grid, differ)


# Pivots: exact -----------------------------------------------------------------

#: Most pivots: 4,096 vectors of 384 numbers are 6 MB in every task.
MOST_PIVOTS = 4096
#: Items of a cell that one part holds.
PART_ITEMS = 40_000
#: What rounding may do to an angle.
SLACK = 1e-5
#: Angles, and rows of output, that a task holds at once.
ANGLES, VISITS = 1_000_000, 4096


def pivots_for(items: int) -> int:
    """Pivots for a number of items: about as many cells as items in a cell."""
    return max(1, min(MOST_PIVOTS, math.isqrt(items)))


def _angles(vectors: pa.Array, pivots: np.ndarray) -> np.ndarray:
    """Angle of each vector to each pivot; NaN for zero vectors."""
    units = unit_rows(matrix_of(vectors, pivots.shape[1]))
    return np.arccos(np.clip(units @ pivots.T, -1, 1))


def _slices(batches: Iterator[pa.RecordBatch], pivots: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has at most ``ANGLES`` angles."""
    step = max(1, ANGLES // pivots)
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _cells(items: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``items`` with their cell (nearest pivot) and the angle to it."""
    def run(batches):
        for batch in _slices(batches, len(pivots)):
            angles = _angles(batch.column("embedding"), pivots)
            keep = ~np.isnan(angles[:, 0])
            cell = np.argmin(np.where(keep[:, None], angles, 0), axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "embedding")),
                 pa.array(cell), pa.array(angles[np.arange(len(cell)), cell])],
                names=["id", "embedding", "cell", "angle"]).filter(pa.array(keep))

    return items.select("id", "embedding").mapInArrow(
        run, "id string, embedding array<float>, cell long, angle double")


def _groups(pivots: np.ndarray, size: np.ndarray, rows: int) -> np.ndarray:
    """The cells in ``rows`` groups of about equal items, near ones together."""
    lead = np.argmax(pivots @ pivots[:rows].T, axis=1)
    order = np.lexsort((np.arange(len(lead)), lead))
    before = np.cumsum(size[order]) - size[order]
    group = np.empty(len(lead), dtype=np.int64)
    group[order] = before * rows // max(int(size.sum()), 1)
    return group


def search_pruned(
        store: Store, queries: DataFrame, k: int = 10, key: str = "query_id",
        vector: str = "vector", content_type: str = None) -> DataFrame:
    """As :func:`search_batch`, exact too, without multiplying all pairs.

    Items go to the cell of their nearest pivot. Each query first visits its nearest
    cells until they hold k items; the k-th angle found there bounds the rest. An item
    of a cell is no nearer than the query's angle to the pivot less the cell's widest
    angle (or the cell's smallest angle less the query's), so only cells that come
    within the bound are visited then. How much that saves depends on the vectors:
    clusters save most, directions without any structure nothing.

    The visits are counted before they are made. Where they would copy more vectors
    than a :class:`Grid`, cells are put together in the grid's rows, near ones
    together, and a query goes once to each row that has a cell within its bound.

    Pivots are the items with the smallest hashes, ``MOST_PIVOTS`` at most. The driver
    holds them and one row per cell.
    """
    spark = store.tasks.sparkSession
    items = unified_items(store, embedding=True).filter(F.col("embedding").isNotNull())
    if content_type is not None:
        items = items.filter(F.col("content_type") == content_type)
    items = items.select("id", "embedding")
    whole = items.filter(F.exists("embedding", lambda v: v != 0))
    asked = queries.filter(F.col(vector).isNotNull()).select(
        F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    picked = whole.orderBy(F.xxhash64("id"), "id").limit(pivots_for(whole.count())).collect()
    if not picked:
        return nearest_on_grid(items.withColumn("tags", F.lit(None).cast("array<string>")), asked, k,
                               Grid(1, 1))
    pivots = unit_rows(np.array([r.embedding for r in picked], dtype=np.float64))
    path = new_work_path(spark, "pivot-cells")
    _cells(whole, pivots).write.parquet(path)
    cells = spark.read.parquet(path)
    found = cells.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")) \
        .orderBy("cell").collect()
    number = np.array([r.cell for r in found])
    size, low, high = (np.array([r[c] for r in found]) for c in ("n", "low", "high"))
    shares = -(-size // PART_ITEMS)  # parts of each cell, by hash of the id
    offset = np.concatenate(([0], np.cumsum(shares)))
    first_part = spark.createDataFrame(pd.DataFrame(
        {"cell": number, "first": offset[:-1], "shares": shares}))
    dealt = cells.join(F.broadcast(first_part), "cell").select(  # one row per pivot at most
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("shares"))).alias("part"), "id", "embedding",
        F.lit(None).cast("array<string>").alias("tags"))

    def reached(batch, again: bool) -> np.ndarray:
        """Which cells each query of a batch visits; ``again``: those the bound leaves."""
        away = _angles(batch.column("vector"), pivots[number])
        near = np.argsort(away, axis=1, kind="stable")
        held = np.cumsum(size[near], axis=1)
        first = np.zeros(away.shape, dtype=bool)  # the nearest cells until k items
        np.put_along_axis(first, near, held - size[near] < k, axis=1)
        if again:
            bound = batch.column("bound").to_numpy(zero_copy_only=False)[:, None] + SLACK
            first = ~first & (np.maximum(away - high, low - away) <= bound)
        return first & ~np.isnan(away[:, :1])

    def sent(batch, row: np.ndarray, part: np.ndarray):
        """Queries, by row, with the part they go to, some at a time."""
        for i in range(0, len(row), VISITS):
            some = pa.array(row[i:i + VISITS])
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[i:i + VISITS]), batch.column("id").take(some),
                 batch.column("vector").take(some)], names=["part", "id", "vector"])

    def visits(frame: DataFrame, again: bool) -> DataFrame:
        """Queries with the parts they visit."""
        def run(batches):
            for batch in _slices(batches, len(number)):
                row, cell = np.nonzero(reached(batch, again))
                each = shares[cell]
                part = np.repeat(offset[cell], each) + np.arange(each.sum()) - np.repeat(
                    np.cumsum(each) - each, each)
                yield from sent(batch, np.repeat(row, each), part)

        return frame.mapInArrow(run, "part long, id string, vector array<double>")

    def visits_of_groups(frame: DataFrame, group: np.ndarray) -> DataFrame:
        """Queries with the groups that hold a cell they visit, the first ones too."""
        def run(batches):
            for batch in _slices(batches, len(number)):
                go = reached(batch, True) | reached(batch, False)
                row, cell = np.nonzero(go)
                pairs = np.unique(row * (group.max() + 1) + group[cell])
                yield from sent(batch, pairs // (group.max() + 1), pairs % (group.max() + 1))

        return frame.mapInArrow(run, "part long, id string, vector array<double>")

    def copies(batches):
        for batch in _slices(batches, len(number)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int((reached(batch, True) * shares).sum())])], names=["n"])

    parts = int(offset[-1])
    hits = new_work_path(spark, "first-hits")
    top_per_query(nearest_in_parts(dealt, visits(asked, False), k, parts), k).write.parquet(hits)
    near = spark.read.parquet(hits)
    bound = near.groupBy("query_id").agg(
        F.acos(F.least(F.min("similarity"), F.lit(1.0))).alias("angle"), F.count(F.lit(1)).alias("n"))
    bounded = asked.join(bound, asked["id"] == bound["query_id"], "left").select(
        "id", "vector",
        F.when(F.col("n") == k, F.col("angle")).otherwise(F.lit(math.pi)).alias("bound"))
    held, asking = int(size.sum()), asked.count()
    grid = grid_for(held, asking, int(spark.conf.get("spark.sql.shuffle.partitions")),
                    4 * pivots.shape[1])
    sent_on = bounded.mapInArrow(copies, "n long").agg(F.sum("n")).first()[0] or 0
    if sent_on <= asking * grid.rows + held * grid.cols:
        more = nearest_in_parts(dealt, visits(bounded, True), k, parts)
        return top_per_query(near.drop("rank").unionByName(more), k)
    group = _groups(pivots[number], size, grid.rows)
    in_groups = spark.createDataFrame(pd.DataFrame({"cell": number, "group": group}))
    columns = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid.cols - 1).cast("long")))
    spread = cells.join(F.broadcast(in_groups), "cell").withColumn("c", columns).select(
        (F.col("group") * grid.cols + F.col("c")).alias("part"), "id", "embedding",
        F.lit(None).cast("array<string>").alias("tags"))
    sought = visits_of_groups(bounded, group).withColumn(
        "part", F.col("part") * grid.cols + F.pmod(F.xxhash64("id"), F.lit(grid.cols)))
    return top_per_query(nearest_in_parts(spread, sought, k, (int(group.max()) + 1) * grid.cols), k)
