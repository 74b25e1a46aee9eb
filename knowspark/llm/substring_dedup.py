"""Substring deduplication by recompression.

Words get global names, then rounds of *pair* naming: each round splits all names
by a bit of their own fingerprint into left and right ones, and a left name with
a right name behind it becomes one new name, the fingerprint of the two. A name
depends on nothing but what it stands for, so every task names alike without any
exchange, and equal passages get equal names inside, wherever they are cut.
*Runs* of one name are then a single symbol of that name, whatever their length.
A run may hold equal windows of its own, so its windows make two units at least.

How far an edge can reach: in a round a symbol at the edge of a passage may pair
with what stands outside. A symbol pairs only while shorter than ``CAP`` words,
so with ``ROUNDS`` rounds the naming of a passage differs from that of its copy
in at most ``1 + 2 + 4 + 5 + 5 = 17`` words at either end. The middle word of a
window of 35 words has 17 on either side: the symbol over it is the same in every
copy of the window. So each window goes under the name of that symbol, and shared
symbols reveal the repeats, which ``repeats`` then verifies on the whole windows.

Result per document: words, words removed (covered by a window of ``width`` words
whose sequence also starts anywhere else) and the SHA-256 of the kept words,
joined by one space. NULL texts count as empty: no words, nothing removed. Equal
rows are each other's repeats. Texts of fewer words than a window keep all. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from knowspark.llm import repeats, text as T

#: Longest symbol in words that still pairs is one less.
CAP = 6
ROUNDS = 5
WIDTH = 35
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _reach(rounds: int, cap: int) -> int:
    """Words at either end of a passage whose naming may depend on what is outside."""
    return sum(min(2 ** r, cap - 1) for r in range(rounds))


def recompress(names: np.ndarray, bounds: np.ndarray, rounds: int, cap: int) \
        -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after all rounds: their names, first words, and which are runs."""
    at = np.arange(len(names))
    size = np.ones(len(names), dtype=np.int64)
    opens = np.zeros(len(names) + 1, dtype=bool)
    opens[bounds] = True  # the first symbol of each text
    opens = opens[:-1]
    for r in range(rounds):
        if len(names) < 2:
            break
        seed = T.U64((r + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)
        left = (T.mix(names + seed) >> T.U64(63)).astype(bool)
        free = size < cap
        pair = np.zeros(len(names), dtype=bool)
        pair[:-1] = left[:-1] & ~left[1:] & free[:-1] & free[1:] & ~opens[1:]
        first = np.flatnonzero(pair)
        names = names.copy()
        names[first] = T.mix(names[first] * T.U64(T.BASE_A) + T.mix(names[first + 1] ^ seed))
        size = size.copy()
        size[first] += size[first + 1]
        keep = np.ones(len(names), dtype=bool)
        keep[first + 1] = False
        names, at, size, opens = names[keep], at[keep], size[keep], opens[keep]
    keep = np.ones(len(names), dtype=bool)
    keep[1:] = (names[1:] != names[:-1]) | opens[1:]
    first = np.flatnonzero(keep)
    runs = np.diff(np.append(first, len(names))) > 1
    return names[first], at[first], runs


def parser(width: int = WIDTH) -> repeats.Parser:
    half = (width - 1) // 2
    rounds, cap = 0, CAP
    while rounds < ROUNDS and _reach(rounds + 1, cap) <= half:
        rounds += 1

    def elements(data, offsets):
        starts, ends, bounds = T.word_bounds(data, offsets)
        a = T.word_prints(data, starts, ends)
        return bounds, a, T.mix(a + T.U64(0x2545F4914F6CDD1D))

    def units(bounds, a):
        names, at, runs = recompress(a, bounds, rounds, cap)
        if not len(names):
            return at, at, names
        row = np.searchsorted(bounds, at, "right") - 1
        ends = np.minimum(np.append(at[1:], bounds[-1]), bounds[row + 1])
        low = np.maximum(at - half, bounds[row])
        high = np.minimum(ends - half, bounds[row + 1] - width + 1)  # first window after
        fits = low < high
        low, high, names, runs = low[fits], high[fits], names[fits], runs[fits]
        part = np.where(runs, np.clip((high - low + 1) // 2, 1, repeats.MOST_WINDOWS), CAP * 2)
        parts = -(-(high - low) // part)
        first = np.repeat(low, parts) + repeats.steps(parts) * np.repeat(part, parts)
        return (first, np.minimum(np.repeat(high, parts) - first, np.repeat(part, parts)),
                np.repeat(names, parts))

    def carry(data, offsets, bounds, a, start, count):
        first = np.repeat(start, count) + repeats.steps(count)
        return repeats.binaries(T.Prefix(a, T.BASE_A).of(first, first + width).view(np.uint8),
                                count * 8)

    def carried(array, count):
        return repeats.contents(array)[0].view(T.U64)

    return repeats.Parser(width, False, elements, units, carry, carried)


def _emit(data, offsets, bounds, covered):
    starts, ends, _ = T.word_bounds(data, offsets)
    kept = ~covered
    counts = repeats.per_row(bounds, kept)
    starts, sizes = starts[kept], (ends - starts)[kept] + 1
    stops = np.cumsum(sizes)
    source = np.repeat(starts - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)
    line = np.append(data, np.uint8(0x20))[source]
    line[stops - 1] = 0x20
    line = line.tobytes()
    edges = np.concatenate(([0], stops))[np.concatenate(([0], np.cumsum(counts)))]
    digests = [hashlib.sha256(line[a:max(a, b - 1)]).hexdigest()
               for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    words = np.diff(bounds)
    return {"n_words": words.astype(np.int64), "n_removed": words - counts, "kept_sha256": digests}


def remove_repeats(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every document without the words that repeated windows cover."""
    p = parser(width)
    return repeats.apply_ranges(p, documents, repeats.repeated_ranges(p, documents), _emit, SCHEMA)
