"""Cosine search: one vector, many vectors, tag suggestions."""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knowspark.functions.vectors import (
    RANK_DECIMALS, matrix_of, similarity_to, unit_rows)
from knowspark.operators.items import COLUMNS, parents, top, unified_items
from knowspark.operators.tags import tag_centroid, tag_centroids
from knowspark.schema import EMBEDDING_DIMS
from knowspark.session import new_work_path
from knowspark.sources.store import Store

#: Scores a task holds at once.
SCORE_CELLS = 4_000_000


# One query vector -----------------------------------------------------------

def rank_by_similarity(items: DataFrame, vector: list, limit: int) -> DataFrame:
    """The ``limit`` nearest rows by cosine; rows without a vector never match."""
    scored = (
        items.filter(F.col("embedding").isNotNull())
        .withColumn("similarity", similarity_to(vector, "embedding")).drop("embedding")
    )
    # Zero vectors have no similarity and rank last, so they can go after the
    # limit; a filter below it would score every row twice.
    return top(scored, limit, F.desc_nulls_last("similarity"), "id").filter(
        F.col("similarity").isNotNull())


def search(store: Store, vector: list, limit: int = 10, content_type: str = None) -> DataFrame:
    """Nearest items of all four tables."""
    items = unified_items(store, embedding=True)
    if content_type is not None:
        items = items.filter(F.col("content_type") == content_type)
    return rank_by_similarity(items, vector, limit)


def search_thoughts(
        store: Store, vector: list, limit: int = 10, content_type: str = None) -> DataFrame:
    """Nearest thoughts only, with their source."""
    thoughts = parents(store.thoughts).select(*COLUMNS, "source", "embedding")
    if content_type is not None:
        thoughts = thoughts.filter(F.col("content_type") == content_type)
    return rank_by_similarity(thoughts, vector, limit)


def untagged(items: DataFrame, tag: str) -> DataFrame:
    """Items known not to carry the tag. As in SQL, NULL tags, or a NULL element
    without a match, leave that unknown and drop the item."""
    return items.filter(~F.array_contains("tags", tag))


def suggested_connections(store: Store, tag: str, limit: int = 8,
                          tagged: Store = None) -> DataFrame:
    """Items nearest to the tag's centroid that do not carry the tag.

    The centroid, one vector, is computed first, from ``tagged`` if the tagged
    items are at hand; without one the result is empty.
    """
    items = unified_items(store, embedding=True)
    centroid = tag_centroid(tagged or store, tag).select("centroid").collect()
    if not centroid:
        return items.drop("embedding").withColumn("similarity", F.lit(0.0)).limit(0)
    return rank_by_similarity(untagged(items, tag), list(centroid[0][0]), limit)


# Many query vectors ---------------------------------------------------------

def _best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple:
    """Rows and columns of each column's k best; equal scores go by id. NaN never
    counts."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
    else:
        floor = np.full(scores.shape[1], -np.inf)
    row, col = np.nonzero((scores >= floor) & (scores > -np.inf))
    order = np.lexsort((ids[row], -scores[row, col], col))
    row, col = row[order], col[order]
    place = np.arange(len(col)) - np.searchsorted(col, col, side="left")
    return row[place < k], col[place < k]


def _best_pairs(row: np.ndarray, col: np.ndarray, score: np.ndarray, k: int) -> tuple:
    """The k best of each column, in order, with their place; equal scores go by row."""
    order = np.lexsort((row, -score, col))
    row, col, score = row[order], col[order], score[order]
    place = np.arange(len(col)) - np.searchsorted(col, col, side="left")
    best = place < k
    return row[best], col[best], score[best], place[best]


#: Bytes of vectors a part holds on average, and rows of it multiplied at a time; the
#: first rows are fewer, as what they give bounds the others.
HELD_BYTES = 16 << 20
HELD_ROWS, FIRST_ROWS = 8192, 512
#: Numbers that are gathered at once to score single pairs.
GATHERED = 1 << 21


class _Part:
    """The items of one part, held while all its queries stream past.

    Vectors stay as stored, 4 bytes a number, by id. A block of items is multiplied
    with some queries in 4-byte numbers; only pairs that may, within the rounding of
    those, be among the k best of their query so far are scored in 8 bytes. With a
    ``differ``, only pairs whose sketches differ in at most so many bits count.
    """

    def __init__(self, number: int, differ: int = None):
        self.number, self.differ = number, differ
        self.blocks, self.ids, self.sketches, self.tagged = [], [], [], {}
        self.items = None

    def hold(self, batch) -> None:
        dims = len(batch.column("embedding")[0])
        first = sum(map(len, self.ids))
        self.blocks.append(matrix_of(batch.column("embedding"), dims, np.float32))
        self.ids.append(batch.column("id").to_numpy(zero_copy_only=False))
        if self.differ is not None:
            self.sketches.append(_bits_of(batch.column("sketch")))
        for row, tags in enumerate(batch.column("tags").to_pylist(), first):
            for tag in tags or ():
                self.tagged.setdefault(tag, []).append(row)

    def _close(self) -> None:
        names = np.concatenate(self.ids).astype(str)
        order = np.argsort(names, kind="stable")
        self.names, self.items = names[order], np.concatenate(self.blocks)[order]
        self.blocks, self.ids = [], [self.names]
        if self.differ is not None:
            self.sketch, self.sketches = np.concatenate(self.sketches)[order], []
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.tagged = {tag: place[rows] for tag, rows in self.tagged.items()}

    def _blocks(self, k: int):
        first, size = 0, min(max(FIRST_ROWS, 4 * k), HELD_ROWS)
        while first < len(self.items):
            yield slice(first, min(first + size, len(self.items)))
            first, size = first + size, min(2 * size, HELD_ROWS)

    def _near(self, row: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Whether the sketches of single pairs differ in few enough bits."""
        apart = np.zeros(len(row), dtype=np.uint16)
        for word in range(bits.shape[1]):
            apart += np.bitwise_count(self.sketch[row, word] ^ bits[:, word])
        return apart <= self.differ

    def _drop_far(self, rows: slice, rough: np.ndarray, some: np.ndarray, bits) -> None:
        """Takes the pairs whose sketches differ too much out of whole rows of scores."""
        apart = np.zeros((len(some), rows.stop - rows.start), dtype=np.uint16)
        for word in range(bits.shape[1]):
            apart += np.bitwise_count(bits[some, word][:, None] ^ self.sketch[rows, word][None, :])
        rough[some] = np.where(apart <= self.differ, rough[some], np.nan)

    def _better(self, rows: slice, block: np.ndarray, units: np.ndarray, bits, queries: list,
                kept: tuple, floor: np.ndarray, k: int) -> tuple:
        """What was kept for some queries, with the better of a block of unit rows."""
        rough = units.astype(np.float32) @ block.astype(np.float32).T
        slack = (block.shape[1] + 4) * 2.0 ** -22
        for c, query in enumerate(queries if self.tagged else ()):
            own = self.tagged.get(query)
            if own is not None:
                rough[c, own[(own >= rows.start) & (own < rows.stop)] - rows.start] = np.nan
        least = floor - slack
        new = np.flatnonzero(floor == -np.inf)
        if len(new):
            if self.differ is not None:
                self._drop_far(rows, rough, new, bits)
            if len(block) > k:
                known = np.where(np.isnan(rough[new]), -np.inf, rough[new])
                least[new] = np.partition(known, len(block) - k, axis=1)[:, len(block) - k] - 2 * slack
        col, row = np.nonzero(rough >= least.astype(np.float32)[:, None])
        if self.differ is not None:
            near = self._near(row + rows.start, bits[col])
            row, col = row[near], col[near]
        if 8 * len(row) > rough.size:  # too many to gather
            scores = np.full((len(block), len(units)), np.nan)
            scores[row, col] = np.round(block @ units.T, RANK_DECIMALS)[row, col]
            row, col = _best_of(self.names[rows], scores, k)
            score = scores[row, col]
        else:
            step = max(1, GATHERED // block.shape[1])
            score = np.round(np.concatenate([np.zeros(0)] + [
                np.einsum("ij,ij->i", units[col[i:i + step]], block[row[i:i + step]])
                for i in range(0, len(row), step)]), RANK_DECIMALS)
        good = score > floor[col]  # an equal score has the smaller id already; NaN never counts
        row, col, score, place = _best_pairs(
            np.concatenate([kept[0], row[good] + rows.start]), np.concatenate([kept[1], col[good]]),
            np.concatenate([kept[2], score[good]]), k)
        floor = np.full(len(units), -np.inf)
        floor[col[place == k - 1]] = score[place == k - 1]
        return (row, col, score), floor

    def find(self, batch, k: int):
        if not self.ids:
            return
        if self.items is None:
            self._close()
        units = unit_rows(matrix_of(batch.column("vector"), self.items.shape[1]))
        bits = None if self.differ is None else _bits_of(batch.column("sketch"))
        queries = batch.column("id").to_pylist()
        step = max(1, SCORE_CELLS // HELD_ROWS)
        state = {
            start: ((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)),
                    np.full(len(queries[start:start + step]), -np.inf))
            for start in range(0, len(queries), step)}
        for rows in self._blocks(k):
            block = unit_rows(self.items[rows].astype(np.float64))
            for start, (kept, floor) in state.items():
                some = slice(start, start + step)
                state[start] = self._better(rows, block, units[some], None if bits is None else bits[some],
                                            queries[some], kept, floor, k)
        row, col, score = map(np.concatenate, zip(*(
            (row, col + start, score) for start, ((row, col, score), _) in state.items())))
        yield pa.RecordBatch.from_arrays([
            pa.array([queries[c] for c in col], pa.string()),
            pa.array(list(self.names[row]), pa.string()),
            pa.array(score, pa.float64())], ["query_id", "id", "similarity"])


def _bits_of(sketches: pa.Array) -> np.ndarray:
    """Sketches as rows of 64-bit words."""
    if isinstance(sketches, pa.ChunkedArray):
        sketches = sketches.combine_chunks()
    return sketches.flatten().to_numpy(zero_copy_only=False).reshape(len(sketches), -1) \
        .astype(np.int64).view(np.uint64)


def nearest_in_parts(items: DataFrame, queries: DataFrame, k: int, parts: int,
                     differ: int = None) -> DataFrame:
    """Per part and query the k nearest items.

    ``items(part, id, embedding, tags)`` and ``queries(part, id, vector)`` meet in
    their part, items first. A task holds one part's items and multiplies them
    with the queries batch by batch; no row is joined to another. An item never
    matches a query whose id is one of its ``tags``. With ``differ`` both sides
    also have a ``sketch``, and pairs that differ in more bits are not multiplied.
    """
    bits = [] if differ is None else ["sketch"]
    left = items.select("part", F.lit(False).alias("query"), "id", "embedding",
                        F.lit(None).cast("array<double>").alias("vector"), "tags", *bits)
    right = queries.select("part", F.lit(True).alias("query"), "id",
                           F.lit(None).cast("array<float>").alias("embedding"),
                           F.col("vector").cast("array<double>").alias("vector"),
                           F.lit(None).cast("array<string>").alias("tags"), *bits)

    def run(batches):
        held = None
        for batch in batches:
            number = batch.column("part").to_numpy()
            side = batch.column("query").to_numpy(zero_copy_only=False).astype(bool)
            change = np.flatnonzero((number[1:] != number[:-1]) | (side[1:] != side[:-1])) + 1
            cuts = [0, *change.tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                if held is None or held.number != number[start]:
                    held = _Part(number[start], differ)
                if side[start]:
                    yield from held.find(batch.slice(start, end - start), k)
                else:
                    held.hold(batch.slice(start, end - start))

    # by number, not by hash: a task holds one part
    return left.unionByName(right).repartitionById(parts, F.col("part").cast("int")) \
        .sortWithinPartitions("part", "query") \
        .mapInArrow(run, "query_id string, id string, similarity double")


def top_per_query(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@dataclass(frozen=True)
class Grid:
    """Items dealt over ``rows``, queries over ``cols``: each of the rows x cols parts
    gets one share of either, so an item is copied ``cols`` times and a query
    ``rows`` times."""

    rows: int
    cols: int


def grid_for(items: int, queries: int, parallel: int, bytes_per_item: int) -> Grid:
    """The grid that copies least: items x cols + queries x rows, with a share of the
    items within ``HELD_BYTES`` and at least ``parallel`` parts."""
    fewest = max(1, -(-items * bytes_per_item // HELD_BYTES))
    parts = max(parallel, fewest)
    cols = round(math.sqrt(max(queries, 1) * parts / max(items, 1)))
    cols = min(max(cols, 1), parallel)
    return Grid(max(fewest, -(-parts // cols)), cols)


def vector_bytes(items: DataFrame, column: str = "embedding") -> int:
    """Bytes of one stored vector, all being of one width."""
    some = items.filter(F.col(column).isNotNull()).select(F.size(column)).first()
    return 4 * (some[0] if some else EMBEDDING_DIMS)


def nearest_on_grid(items: DataFrame, queries: DataFrame, k: int, grid: Grid,
                    differ: int = None) -> DataFrame:
    """Every query against every item; no side is copied to all parts."""
    def other(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def share(n):
        return F.pmod(F.xxhash64("id"), F.lit(n))

    dealt = items.withColumn("c", other(grid.cols)).withColumn(
        "part", share(grid.rows) * grid.cols + F.col("c"))
    asked = queries.withColumn("r", other(grid.rows)).withColumn(
        "part", F.col("r") * grid.cols + share(grid.cols))
    return top_per_query(
        nearest_in_parts(dealt, asked, k, grid.rows * grid.cols, differ), k)


def _parallel(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _grid_of(store: Store, queries: int) -> Grid:
    """The grid for the number of items; vectors are not read for it."""
    return grid_for(unified_items(store).count(), queries, _parallel(store.tasks.sparkSession),
                    4 * EMBEDDING_DIMS)


def search_batch(
        store: Store, queries: DataFrame, k: int = 10, key: str = "query_id",
        vector: str = "vector", content_type: str = None, grid: Grid = None) -> DataFrame:
    """Exact nearest items of every query vector: ``(query_id, id, similarity, rank)``.

    Query ids are unique; queries without a vector find nothing. Items and queries
    are dealt over a :class:`Grid` (counted first, if not given); a task holds its
    share of the items, queries of any number stream past, and each part passes on
    k rows per query.
    """
    asked = queries.filter(F.col(vector).isNotNull()).select(
        F.col(key).cast("string").alias("id"), F.col(vector).alias("vector"))
    items = unified_items(store, embedding=True).filter(F.col("embedding").isNotNull())
    if content_type is not None:
        items = items.filter(F.col("content_type") == content_type)
    items = items.select("id", "embedding", F.lit(None).cast("array<string>").alias("tags"))
    return nearest_on_grid(items, asked, k, grid or _grid_of(store, queries.count()))


def with_items(hits: DataFrame, store: Store) -> DataFrame:
    """Hits with the attributes of their items.

    The hits are written to the work folder first. Their true size then decides
    the join: a broadcast that only scans the items, or a shuffle of both.
    """
    spark = hits.sparkSession
    path = new_work_path(spark, "hits")
    hits.write.parquet(path)
    return unified_items(store).join(spark.read.schema(hits.schema).parquet(path), "id")


def suggest_all(store: Store, k: int = 8, tags: DataFrame = None,
                grid: Grid = None) -> DataFrame:
    """:func:`suggested_connections` of every tag, or of the tags in the first
    column of ``tags``: ``(tag, id, similarity, rank)``."""
    items = (
        unified_items(store, embedding=True)
        .filter(F.col("embedding").isNotNull() & F.col("tags").isNotNull())
        # a NULL element leaves "does not carry the tag" unknown for every tag
        .filter(~F.exists("tags", lambda t: t.isNull()))
        .select("id", "tags", "embedding")
    )
    centroids = tag_centroids(store)
    if tags is not None:
        centroids = centroids.join(
            tags.select(F.col(tags.columns[0]).alias("tag")), "tag", "left_semi")
    asked = centroids.select(F.col("tag").alias("id"), F.col("centroid").alias("vector"))
    if grid is None:
        asking = unified_items(store).select(F.explode("tags").alias("tag"))
        grid = _grid_of(store, asking.agg(F.approx_count_distinct("tag")).first()[0])
    return nearest_on_grid(items, asked, k, grid).withColumnRenamed("query_id", "tag")
