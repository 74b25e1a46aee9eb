"""Ranked lexical search: accumulators from short lists, skipping over long ones.

Index: texts are gathered to *segments* of ``SEGMENT_BYTES``; a segment gives one
row per term (64-bit fingerprint) with its postings, and one head row with the
documents and their lengths. Nothing is shuffled to build it.

Search: queries come in blocks of bounded size, one pass over the index each. The
lists of a block's terms are dealt by segment; a task holds one segment at a time
and answers all queries of the block on it:

1. Term at a time: the lists that hold at most one of ``SHORT`` documents of the
   segment are added up into one accumulator per document.
2. Document at a time: these accumulators now act as one more list, with a bound
   per range of ``RANGE`` documents as every long list has. Ranges are visited by
   falling sum of the bounds; all lists skip to the range, its documents are scored
   in full, and the visit ends at the first range whose bound is below the lowest
   score kept so far, which a task carries on from segment to segment.

A skipped range cannot hold a document that would be kept, ties included, so the
result is exact. Each task passes on ``k`` rows per query.

Result per query: its ``k`` best documents with a score above 0, ties by ascending
doc_id (NULL first). NULL, empty and termless texts are found by nothing, and such
queries find nothing. Rows of queries equal in item_id and text are one query;
different texts that share an item_id are ranked each for itself. Every row of the
documents counts, also when a doc_id is repeated. A very long text is a segment of
its own. Extra columns are ignored; empty tables give an empty result.

Bounds: the driver and each task hold one block of queries (``BLOCK_BYTES`` of
text, or one query if that is longer) and the documents kept for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from knowspark.llm import text as T
from knowspark.llm.repeats import NULL_ID, binaries, contents
from knowspark.llm.scratch import written

#: Bytes of text in a segment, and of queries in a block.
SEGMENT_BYTES = 16 << 20
BLOCK_BYTES = 1 << 20
#: A list is short with at most one of so many documents of its segment.
SHORT = 16
#: Documents that are scored, or skipped, together.
RANGE = 128
#: Ranges visited before the lowest score kept is looked at again.
AT_ONCE = 4
#: Stands for the term in a head row.
HEAD = 0
ROW = "segment long, term long, size long, total long, docs binary, counts binary"


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of every term of some texts, and the text it stands in."""
    low = T.lowered(data)
    starts, ends, _, letters = T.token_bounds(low, offsets)
    starts, ends = starts[letters], ends[letters]
    return T.signed(T.word_prints(low, starts, ends, 5)), \
        np.searchsorted(offsets, starts, "right") - 1


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal neighbours start, and the end."""
    new = np.ones(len(keys[0]) + 1, dtype=bool)
    new[1:-1] = False
    for k in keys:
        new[1:-1] |= k[1:] != k[:-1]
    return np.flatnonzero(new) if len(keys[0]) else np.zeros(1, dtype=np.int64)


def _segment(number: int, ids: list, terms: list, rows: list) -> pa.RecordBatch:
    """The rows of one segment: its head, then a row per term."""
    ids, terms, rows = map(np.concatenate, (ids, terms, rows))
    lengths = np.bincount(rows, minlength=len(ids))
    order = np.argsort(terms, kind="stable")  # rows stay in order
    terms, rows = terms[order], rows[order]
    posting = _runs(terms, rows)
    counts = np.diff(posting).astype(np.int32)
    terms, rows = terms[posting[:-1]], rows[posting[:-1]].astype(np.int32)
    lists = _runs(terms)
    sizes = np.diff(lists)
    head = [np.frombuffer(x.tobytes(), np.uint8) for x in (ids, lengths.astype(np.int32))]
    both = [binaries(np.concatenate((h, x.view(np.uint8))), np.append(len(h), 4 * sizes))
            for h, x in zip(head, (rows, counts))]
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(sizes) + 1, number)),
        pa.array(np.append(HEAD, terms[lists[:-1]])),
        pa.array(np.append(np.count_nonzero(lengths), sizes)),
        pa.array(np.append(lengths.sum(), np.zeros(len(sizes), np.int64))), *both],
        names=["segment", "term", "size", "total", "docs", "counts"])


@dataclass(frozen=True)
class LexicalIndex:
    """Written rows of all segments; documents with a term, and their terms."""

    rows: DataFrame
    documents: int
    terms: int


def build_index(documents: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> LexicalIndex:
    """Index every document. Segments are numbered by the task that writes them, so
    a task that runs again writes the same rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, terms, rows, held, bytes_held = [], [], [], 0, 0
        for batch in batches:
            d = batch["d"].to_numpy()
            for first, end, data, offsets in T.pieces(batch["text"]):
                term, row = terms_of(data, offsets)
                ids.append(d[first:end])
                terms.append(term)
                rows.append(row + held)
                held, bytes_held = held + end - first, bytes_held + len(data)
                if bytes_held >= segment_bytes:
                    yield _segment(number, ids, terms, rows)
                    ids, terms, rows, held, bytes_held = [], [], [], 0, 0
                    number += 1
        if held:
            yield _segment(number, ids, terms, rows)

    rows = written(documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"),
        F.col("text").cast("string").alias("text")).mapInArrow(run, ROW), "lexical-index")
    n, total = rows.filter(F.col("term") == HEAD).agg(
        F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return LexicalIndex(rows, n, total)


class _Block:
    """Some queries: their names, and their terms as places in ``terms``."""

    def __init__(self, names: list, texts: list):
        data = [t.encode() for t in texts]
        joined = np.frombuffer(b"".join(data), np.uint8)
        prints, rows = terms_of(joined, np.concatenate(([0], np.cumsum([len(x) for x in data]))))
        self.names = names
        self.terms, place = np.unique(prints, return_inverse=True)
        ends = np.searchsorted(rows, np.arange(len(texts) + 1))
        self.asks = [np.unique(place[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        self.weights = None

    def weigh(self, documents: int, found: dict) -> None:
        """Weights by the number of documents that hold a term."""
        self.weights = np.array([math.floor(1000 * math.log(
            (2 * documents + 2) / (2 * found.get(t, 0) + 1))) for t in self.terms.tolist()],
            dtype=np.int64)


def _blocks(queries: DataFrame, block_bytes: int) -> Iterator[_Block]:
    """Blocks of distinct queries, read one after another."""
    names, texts, held = [], [], 0
    rows = queries.select("item_id", F.col("text").cast("string").alias("text")) \
        .filter("text IS NOT NULL").distinct()
    for row in rows.toLocalIterator():
        names.append(row.item_id)
        texts.append(row.text)
        held += len(row.text.encode())
        if held >= block_bytes:
            yield _Block(names, texts)
            names, texts, held = [], [], 0
    if names:
        yield _Block(names, texts)


class _Segment:
    """The lists of one segment that a block of queries asks for."""

    def __init__(self, block: _Block, index: tuple[int, int], batch: pa.RecordBatch):
        term = batch["term"].to_numpy()
        docs, ends = contents(batch["docs"])
        counts, count_ends = contents(batch["counts"])
        head = int(np.flatnonzero(term == HEAD)[0])
        self.ids = np.frombuffer(docs[ends[head]:ends[head + 1]].tobytes(), np.int64)
        lengths = np.frombuffer(counts[count_ends[head]:count_ends[head + 1]].tobytes(), np.int32)
        documents, total = index
        sizes, back = np.unique(lengths, return_inverse=True)
        # Python numbers: 90 * length * documents may pass 64 bits before the division.
        norm = np.array([100 - 90 + (90 * n * documents) // total for n in sizes.tolist()],
                        dtype=np.int64)[back]
        self.spans = -(-len(self.ids) // RANGE)
        self.lists: dict[int, tuple] = {}
        places = np.searchsorted(block.terms, term)
        for i, place in enumerate(places.tolist()):
            if i == head:
                continue
            rows = np.frombuffer(docs[ends[i]:ends[i + 1]].tobytes(), np.int32)
            tf = np.frombuffer(counts[count_ends[i]:count_ends[i + 1]].tobytes(), np.int32) \
                .astype(np.int64)
            worth = block.weights[place] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[rows]))
            self.lists[place] = (rows, worth.astype(np.float64))  # exact: far below 2**53
        self.bounds: dict[int, tuple] = {}

    def bounded(self, place: int) -> tuple:
        """Where a list enters each range, and its highest worth there."""
        if place not in self.bounds:
            rows, worth = self.lists[place]
            enters = np.searchsorted(rows, np.arange(self.spans + 1) * RANGE)
            most = np.zeros(self.spans)
            full = np.flatnonzero(np.diff(enters))
            most[full] = np.maximum.reduceat(worth, enters[full])
            self.bounds[place] = enters, most
        return self.bounds[place]

    def best(self, asks: np.ndarray, kept: tuple, k: int) -> tuple:
        """``kept`` (scores, ids), with what is better here."""
        here = [p for p in asks.tolist() if p in self.lists]
        if not here:
            return kept
        short = [p for p in here if len(self.lists[p][0]) * SHORT <= len(self.ids)]
        long = [p for p in here if len(self.lists[p][0]) * SHORT > len(self.ids)]
        size = self.spans * RANGE
        if short:  # term at a time
            rows, worth = (np.concatenate(x) for x in zip(*(self.lists[p] for p in short)))
            summed = np.bincount(rows, worth, size)
        else:
            summed = np.zeros(size)
        reach = summed.reshape(self.spans, RANGE).max(axis=1)
        for p in long:
            reach = reach + self.bounded(p)[1]
        order = np.argsort(-reach, kind="stable")
        order = order[reach[order] > 0]
        for first in range(0, len(order), AT_ONCE):  # document at a time
            spans = order[first:first + AT_ONCE]
            floor = kept[0][k - 1] if len(kept[0]) >= k else 1
            spans = spans[reach[spans] >= floor]
            if not len(spans):
                break
            for span in spans.tolist():
                base = span * RANGE
                scores = summed[base:base + RANGE].copy()
                for p in long:
                    enters = self.bounds[p][0]
                    some = slice(enters[span], enters[span + 1])
                    rows, worth = self.lists[p]
                    scores[rows[some] - base] += worth[some]
                hit = np.flatnonzero(scores >= floor)
                if len(hit):
                    kept = _best(np.append(kept[0], scores[hit].astype(np.int64)),
                                 np.append(kept[1], self.ids[base + hit]), k)
                    floor = kept[0][k - 1] if len(kept[0]) >= k else 1
        return kept


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _whole_segments(batches) -> Iterator[pa.RecordBatch]:
    """One segment after another, over batches sorted by segment."""
    held = []
    for batch in batches:
        edges = _runs(batch["segment"].to_numpy())
        for first, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            part = batch.slice(first, end - first)
            if held and held[0]["segment"][0] != part["segment"][0]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _answers(index: LexicalIndex, block: _Block, k: int) -> DataFrame:
    """The best ``k`` documents of each query in each task."""
    spark = index.rows.sparkSession
    asked = spark.createDataFrame(
        pa.table({"term": np.append(HEAD, block.terms)}))  # at most a block's words
    lists = index.rows.join(F.broadcast(asked), "term", "left_semi")
    block.weigh(index.documents, {r.term: r.found for r in lists.groupBy("term").agg(
        F.sum("size").alias("found")).collect()})
    totals = index.documents, max(index.terms, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        kept = [(none, none)] * len(block.asks)
        for batch in _whole_segments(batches):
            segment = _Segment(block, totals, batch)
            for q, asks in enumerate(block.asks):
                kept[q] = segment.best(asks, kept[q], k)
        sizes = [len(s) for s, _ in kept]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(kept)), sizes)),
                 *(pa.array(np.concatenate(x)) for x in zip(*kept))], names=["q", "score", "d"])

    return lists.repartition("segment").sortWithinPartitions("segment", "term") \
        .mapInArrow(run, "q long, score long, d long")


def search(index: LexicalIndex, queries: DataFrame, k: int = 10,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents of each query."""
    spark = index.rows.sparkSession
    names = queries.select("item_id").schema
    found = None
    order = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    for block in _blocks(queries, block_bytes):
        named = spark.createDataFrame([(q, n) for q, n in enumerate(block.names)],
                                      "q long, item_id " + names["item_id"].dataType.simpleString())
        best = _answers(index, block, k).withColumn("rank", F.row_number().over(order)) \
            .filter(F.col("rank") <= k)
        best = written(best.join(F.broadcast(named), "q").select(
            "item_id", "rank",
            F.when(F.col("d") != NULL_ID, F.col("d")).alias("doc_id"), "score"), "lexical-hits")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "item_id " + names["item_id"].dataType.simpleString()
                                     + ", rank int, doc_id long, score long")
    return found
