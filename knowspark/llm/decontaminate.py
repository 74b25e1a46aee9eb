"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared with A-Z lowered and every run of white space as one
space. An item of ``m`` characters may differ from a passage by ``k = floor(RATE *
m)`` edits. Cut into ``k + 1`` pieces, one piece at least must occur unchanged:
one Aho-Corasick pass over a text finds all exact piece hits of all items. Hits
of an item that lie on neighbouring diagonals make one stretch of text, and
Myers' bit-parallel distance, one column per character, verifies it.

Every stretch that verifies is reported. Items of fewer than ``SHORT`` characters
have no edits to spare and would stand inside longer words: they must occur exactly,
with no letter or digit on either side.

A NULL or empty text has no leaks. Items that are NULL or hold nothing but white
space are left out. Items with equal texts or ids are reported each. Equal documents
are each judged, texts of any length as a whole. All columns of the documents are
kept; the name of the added one is a parameter. Empty tables give no leaks.

The items go to the tasks in blocks of at most ``BLOCK_CHARS`` characters; a
larger benchmark takes several passes over the documents, each written before the
next begins, so the driver and a task hold one block at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from knowspark.llm.scratch import fresh, written

#: Edits allowed per character of an item.
RATE = 0.08
#: Items below are found exactly, on word borders.
SHORT = 20
BLOCK_CHARS = 16_000_000
LEAKS = "array<struct<item_id:long,distance:int,budget:int,start:int,end:int>>"
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def normal(text: str) -> str:
    return _SPACE.sub(" ", text.translate(_UPPER)).strip(" ")


def piece_bounds(size: int, budget: int) -> list[tuple[int, int]]:
    """``budget + 1`` stretches of nearly equal length that make up the item."""
    cuts = [size * k // (budget + 1) for k in range(budget + 2)]
    return list(zip(cuts[:-1], cuts[1:]))


def peq(pattern: str) -> dict:
    """For each character, a bit for each place where the pattern has it."""
    bits: dict = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def best_end(bits: dict, size: int, text: str, limit: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any substring, if within ``limit``,
    and where the first such substring ends (Myers' recurrences)."""
    full, high = (1 << size) - 1, 1 << (size - 1)
    pv, mv, score = full, 0, size
    best = None
    for j, c in enumerate(text):
        eq = bits.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        pv = (mh << 1 & full) | (full & ~(xv | ph))
        mv = ph & xv
        if score <= limit:
            limit, best = score - 1, (score, j + 1)
            if not score:
                break
    return best


class Matcher:
    """All items of a block, ready to be looked for."""

    def __init__(self, items: list[tuple]):
        import ahocorasick
        self.items, self.automaton = [], ahocorasick.Automaton()
        found: dict = {}
        for item_id, text in items:
            budget = int(RATE * len(text)) if len(text) >= SHORT else 0
            n = len(self.items)
            self.items.append((item_id, len(text), budget, peq(text), peq(text[::-1])))
            for a, b in piece_bounds(len(text), budget):
                found.setdefault(text[a:b], []).append((n, a, b - a))
        for piece, places in found.items():
            self.automaton.add_word(piece, places)
        if found:
            self.automaton.make_automaton()

    def leaks(self, text: str) -> list[dict]:
        if not self.items or not text:
            return []
        diagonals: dict = {}
        for last, places in self.automaton.iter(text):
            for n, a, size in places:
                diagonals.setdefault(n, set()).add(last + 1 - size - a)
        return [leak for n in sorted(diagonals) for leak in (
            self._exact(n, diagonals[n], text) if self.items[n][1] < SHORT
            else self._edited(n, diagonals[n], text))]

    def _exact(self, n: int, starts: set, text: str) -> Iterator[dict]:
        """Occurrences of a short item that no letter or digit continues."""
        item_id, size = self.items[n][:2]
        for a in sorted(starts):
            if not (text[a - 1:a].isalnum() or text[a + size:a + size + 1].isalnum()):
                yield {"item_id": item_id, "distance": 0, "budget": 0, "start": a, "end": a + size}

    def _edited(self, n: int, diagonals: set, text: str) -> Iterator[dict]:
        """Stretches around neighbouring diagonals that come within the budget."""
        item_id, size, budget, bits, back = self.items[n]
        stretches: list = []
        for d in sorted(diagonals):
            a, b = max(d - budget, 0), min(d + size + budget, len(text))
            if stretches and a <= stretches[-1][1] - size + budget:
                stretches[-1][1] = max(b, stretches[-1][1])
            else:
                stretches.append([a, b])
        for a, b in stretches:
            hit = best_end(bits, size, text[a:b], budget)
            if hit:
                distance, end = hit[0], a + hit[1]
                length = best_end(back, size, text[a:end][::-1], distance)
                # The reversed pattern must start at the end found: take the
                # shortest stretch that reaches the distance.
                yield {"item_id": item_id, "distance": distance, "budget": budget,
                       "start": end - length[1] if length else a, "end": end}


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """Normal forms of the items, at most about ``limit`` characters at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.col("text").cast("string").alias("text")) \
        .filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = -(-total // limit)
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        texts = sorted(((r.item_id, normal(r.text)) for r in part.collect()), key=repr)
        yield [(i, t) for i, t in texts if t]


def find_leaks(documents: DataFrame, benchmark: DataFrame, column: str = "leaks",
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All columns of the documents, and what each text holds of the benchmark:
    item, distance, budget and the place in the compared form of the text."""
    if column.lower() in (c.lower() for c in documents.columns):
        raise ValueError(f"the documents have a column {column!r}")
    out, begun = documents.withColumn(column, F.array().cast(LEAKS)), False
    for items in _blocks(benchmark, block_chars):
        if items:
            out = _pass(written(out, "leaks") if begun else out, items, column)
            begun = True
    return out


def _pass(documents: DataFrame, items: list[tuple], column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items)
        for batch in batches:
            place = batch.schema.get_field_index(column)
            kind = batch.schema.field(place).type
            leaks = [had + matcher.leaks(normal(text)) if text else had
                     for text, had in zip(batch["text"].to_pylist(), batch[column].to_pylist())]
            yield batch.set_column(place, batch.schema.field(place), pa.array(leaks, kind))

    return documents.mapInArrow(run, documents.schema)


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold nothing of the benchmark, all columns as they are."""
    name, = fresh(documents.columns, "leaks")
    return find_leaks(documents, benchmark, name).filter(F.size(name) == 0) \
        .select(*documents.columns)


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and stretch of it that matches an item."""
    return find_leaks(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                      benchmark).select("doc_id", F.explode("leaks").alias("leak")) \
        .select("doc_id", "leak.*")
