"""Finding every repeated window of a fixed width over a whole corpus.

Shared by the two substring operators, which differ in how they name positions.

A parser covers a text's windows (``width`` elements each, by their first
element) with *units*: runs of neighbouring windows under one *name*. It must
give equal windows equal names, wherever they stand. Then:

1. A window whose name occurs once occurs once: its unit drops out.
2. Units that are equal as a whole are settled together.
3. Where one name has different units, their windows are compared one by one:
   whole units meet under their name, or, where a name has more than ``FEW``
   units, single windows meet under their own fingerprints.

Each of the two shuffles goes by fingerprint and is followed by a sort; a task
streams over the sorted rows and holds one name at a time. Before, a task
settles what it can by itself, some megabytes of text at a time, and sends one
representative per unit (or one row that announces a name with more than
``LOCAL`` units), so a passage in a third of all documents costs a few rows per
``ROUND_BYTES`` of text, or per ``ROUND_WINDOWS`` open windows, not one per document.

Names group, and a second 64-bit fingerprint decides within a name.

Identity: a document is its doc_id and a 64-bit fingerprint of its text, so rows
that share a doc_id but not the text are kept apart: what is found is gathered and
joined by both, each place once, so no list outgrows its text. A NULL doc_id counts
as the smallest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from knowspark.llm import text as T
from knowspark.llm.scratch import forget_shuffles, written

#: How a row is packed into one long: first window, windows, kind.
COUNT_BITS, KIND_BITS = 6, 2
MOST_WINDOWS = (1 << COUNT_BITS) - 1
FIRST_SHIFT = COUNT_BITS + KIND_BITS
#: An occurrence to compare (later: with the few units of its name); a name known
#: to have many units; a unit or window known to be repeated; a unit or window to
#: compare window by window.
PLAIN, SEVERAL, REPEATED, OPEN = 0, 1, 2, 3
#: Units of a name that one batch sends, and that are compared as a group.
LOCAL, FEW = 16, 4096
#: Bytes of text, and open windows, that a task settles by itself at a time.
ROUND_BYTES = 8 << 20
ROUND_WINDOWS = 500_000
NULL_ID = -(1 << 63)


@dataclass(frozen=True)
class Parser:
    """What tells the two operators apart."""

    width: int
    #: Only repeats of a document with a smaller doc_id count.
    earlier: bool
    #: ``(bytes, offsets) -> (bounds, values_a, values_b)``: per text the first
    #: element (and the end), and two values of each element.
    elements: Callable
    #: ``(bounds, values_a) -> (first, count, name)`` of all units, in order;
    #: ``first`` counts elements of the whole piece.
    units: Callable
    #: ``(bytes, offsets, bounds, values_a, start, count) -> binary array``: what a
    #: unit's windows are made again from.
    carry: Callable
    #: ``(binary array, count) -> fingerprints`` of all windows of the units.
    carried: Callable


def pack(first: np.ndarray, count, kind) -> np.ndarray:
    return ((first.astype(np.int64) << FIRST_SHIFT)
            | (np.int64(count) if np.isscalar(count) else count.astype(np.int64) << KIND_BITS)
            | kind)


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows."""
    return at >> FIRST_SHIFT, (at >> KIND_BITS) & MOST_WINDOWS


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the row before it."""
    new = np.zeros(len(sorted_keys[0]), dtype=bool)
    if len(new):
        new[0] = True
        for k in sorted_keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run of each row, and the size of each run."""
    return np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(new)))


def _kinds(at: np.ndarray, kind: int) -> np.ndarray:
    return (at & ~np.int64(3)) | kind


def _spread(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key for rows that need no partner: any partition will do."""
    return T.signed(T.mix(at.view(np.uint64) + key.view(np.uint64)))


def _arrays(batch, names) -> list[np.ndarray]:
    return [batch[n].to_numpy(zero_copy_only=False) for n in names]


def _batch(names, arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=list(names))


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Neighbouring stretches of a buffer as a binary array."""
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes),
                                 [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def contents(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary array without NULLs."""
    buffers = array.buffers()
    ends = np.frombuffer(buffers[1], np.int32)[array.offset:array.offset + len(array) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[ends[0]:ends[-1]]
    return data, (ends - ends[0]).astype(np.int64)


ROW = "key long, u long, d long, t long, at long"
NAMES = ("key", "u", "d", "t", "at")


def _first_round(parser: Parser, key, u, d, t, at) -> Iterator[pa.RecordBatch]:
    """What a batch can settle by itself; the rest as one row per unit."""
    order = np.lexsort((d, u, key))
    key, u, d, t, at = key[order], u[order], d[order], t[order], at[order]
    name, size = _runs(_starts(key))
    new = _starts(key, u)
    unit, unit_size = _runs(new)
    units = np.bincount(name, weights=new, minlength=len(size)).astype(np.int64)
    several = units[name] > LOCAL
    if parser.earlier:
        repeated = d > d[np.flatnonzero(new)][unit]
        sent = ~repeated
    else:
        repeated = unit_size[unit] > 1
        sent = new
    plain = sent & ~several
    yield _batch(NAMES, (key[plain], u[plain], d[plain], t[plain], at[plain]))
    for rows, kind in ((repeated, REPEATED), (sent & several, OPEN)):
        if rows.any():
            out = _kinds(at[rows], kind)
            yield _batch(NAMES, (_spread(d[rows] ^ t[rows], out), np.zeros(len(out), np.int64),
                                 d[rows], t[rows], out))
    heads = _starts(key) & several
    if heads.any():
        n = int(heads.sum())
        yield _batch(NAMES, (key[heads], u[heads], np.full(n, NULL_ID),
                             np.zeros(n, np.int64), np.full(n, SEVERAL)))


def _settle(parser: Parser, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Whole names, sorted by (key, u, d): repeated units and units to compare."""
    key, u, d, t, at = _arrays(batch, NAMES)
    kind = at & 3
    known = (kind == REPEATED) | (kind == OPEN)
    out = [(key[known], d[known], t[known], at[known])]
    key, u, d, t, at, kind = (x[~known] for x in (key, u, d, t, at, kind))
    if len(key):
        name, size = _runs(_starts(key))
        announced = np.bincount(name, weights=kind == SEVERAL, minlength=len(size)) > 0
        keep = kind == PLAIN
        name, key, u, d, t, at = (x[keep] for x in (name, key, u, d, t, at))
        new = _starts(key, u)
        units = np.bincount(name, weights=new, minlength=len(size))
        many, several = (announced | (units > FEW))[name], (announced | (units > 1))[name]
        unit, unit_size = _runs(new)
        if parser.earlier:
            repeated = d > d[np.flatnonzero(new)][unit]
            head = ~repeated
        else:
            repeated = unit_size[unit] > 1
            head = new
        for rows, kind in ((repeated, REPEATED), (head & several & ~many, PLAIN),
                           (head & many, OPEN)):
            out.append((key[rows], d[rows], t[rows], _kinds(at[rows], kind)))
    return _batch(("key", "d", "t", "at"), map(np.concatenate, zip(*out)))


def _names_at_a_time(batches, act) -> Iterator[pa.RecordBatch]:
    """Apply ``act`` to whole runs of the first column over sorted batches."""
    held = None
    for batch in batches:
        if held is not None and held.num_rows:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        cut = int(np.flatnonzero(_starts(batch[0].to_numpy()))[-1])
        if cut:
            yield act(batch.slice(0, cut))
        held = batch.slice(cut)
    if held is not None:
        yield act(held)


def with_id(documents: DataFrame) -> DataFrame:
    """``d``: doc_id with NULL as the smallest; and the text."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"),
                            F.col("text").cast("string").alias("text"))


def identified(documents: DataFrame) -> DataFrame:
    """As :func:`with_id`, with the text's fingerprint ``t``."""
    return with_id(documents).withColumn("t", F.xxhash64("text"))


def _occurrences(parser: Parser, docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = batch["d"].to_numpy(), batch["t"].to_numpy()
            parts, held = [], 0
            for first_row, _, data, offsets in T.pieces(batch["text"]):
                held += len(data)
                bounds, a, b = parser.elements(data, offsets)
                first, count, name = parser.units(bounds, a)
                if not len(first):
                    continue
                prefix = T.Prefix(b, T.BASE_B)
                row = np.searchsorted(bounds, first, "right") - 1
                u = prefix.of(first, first + count - 1 + parser.width)
                at = pack(first - bounds[row], count, PLAIN)
                parts.append((T.signed(name), T.signed(u), ids[first_row + row],
                              prints[first_row + row], at))
                if held >= ROUND_BYTES:
                    yield from _first_round(parser, *map(np.concatenate, zip(*parts)))
                    parts, held = [], 0
            if parts:
                yield from _first_round(parser, *map(np.concatenate, zip(*parts)))

    return docs.select("d", "t", "text").mapInArrow(run, ROW)


def _windows(parser: Parser, docs: DataFrame, open_units: DataFrame) -> DataFrame:
    """Units to compare under their name, and the windows of the others."""
    listed = open_units.groupBy("d", "t").agg(
        F.collect_set(F.struct("at", "key")).alias("ats"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, parts, held = batch["d"].to_numpy(), batch["t"].to_numpy(), [], 0
            lists = batch["ats"]
            ends = lists.offsets.to_numpy()
            flat, names = (lists.values.field(c).to_numpy() for c in ("at", "key"))
            for first_row, end_row, data, offsets in T.pieces(batch["text"]):
                bounds, a, b = parser.elements(data, offsets)
                pa_, pb = T.Prefix(a, T.BASE_A), T.Prefix(b, T.BASE_B)
                here = slice(ends[first_row], ends[end_row])
                at, name = flat[here], names[here]
                row = T.rows_of(ends[first_row:end_row + 1])
                first, count = unpack(at)
                start = first + bounds[row]
                few = (at & 3) == PLAIN
                if few.any():
                    yield _batch((*NAMES, "carried"), (
                        name[few], np.zeros(few.sum(), np.int64), ids[first_row + row[few]],
                        prints[first_row + row[few]], at[few],
                        parser.carry(data, offsets, bounds, a, start[few], count[few])))
                count, start, row = (x[~few] for x in (count, start, row))
                for some in _by_sum(count, ROUND_WINDOWS):
                    each = count[some]
                    own = np.repeat(row[some], each)
                    begin = np.repeat(start[some], each) + steps(each)
                    parts.append((T.signed(pa_.of(begin, begin + parser.width)),
                                  T.signed(pb.of(begin, begin + parser.width)),
                                  ids[first_row + own], prints[first_row + own],
                                  pack(begin - bounds[own], 1 << KIND_BITS, OPEN)))
                    held += len(begin)
                    if held >= ROUND_WINDOWS:
                        yield from _window_round(parser, *map(np.concatenate, zip(*parts)))
                        parts, held = [], 0
            if parts:
                yield from _window_round(parser, *map(np.concatenate, zip(*parts)))

    return docs.select("d", "t", "text").join(listed, ["d", "t"]).select("d", "t", "text", "ats") \
        .mapInArrow(run, ROW + ", carried binary")


def _window_round(parser: Parser, key, u, d, t, at) -> Iterator[pa.RecordBatch]:
    """As the first round, but nothing stays open: a window is compared whole."""
    order = np.lexsort((d, u, key))
    key, u, d, t, at = key[order], u[order], d[order], t[order], at[order]
    new = _starts(key, u)
    run, size = _runs(new)
    if parser.earlier:
        repeated = d > d[np.flatnonzero(new)][run]
        sent = ~repeated
    else:
        repeated = size[run] > 1
        sent = new
    none = lambda n: pa.nulls(n, pa.binary())
    yield _batch((*NAMES, "carried"), (key[sent], u[sent], d[sent], t[sent], at[sent],
                                       none(sent.sum())))
    if repeated.any():
        out = _kinds(at[repeated], REPEATED)
        yield _batch((*NAMES, "carried"), (
            _spread(d[repeated] ^ t[repeated], out), np.zeros(len(out), np.int64), d[repeated],
            t[repeated], out, none(len(out))))


def _by_sum(count: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of units that have about ``most`` windows at a time."""
    reach = np.concatenate(([0], np.cumsum(count)))
    first = 0
    while first < len(count):
        end = max(int(np.searchsorted(reach, reach[first] + most, "right")) - 1, first + 1)
        yield slice(first, end)
        first = end


def steps(count: np.ndarray) -> np.ndarray:
    """0, 1, .. count - 1 for each entry."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)


def _repeated_windows(parser: Parser, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Whole keys, sorted by (key, u, d): the repeated windows."""
    key, u, d, t, at = _arrays(batch, NAMES)
    kind = at & 3
    out = [(d[kind == REPEATED], t[kind == REPEATED], at[kind == REPEATED])]
    single = kind == OPEN
    if single.any():
        k, v, i, p, a = (x[single] for x in (key, u, d, t, at))
        hit = _again(parser, i, k, v)
        out.append((i[hit], p[hit], _kinds(a[hit], REPEATED)))
    few = np.flatnonzero(kind == PLAIN)
    if len(few):
        first, count = unpack(at[few])
        prints = parser.carried(batch["carried"].take(pa.array(few)), count)
        unit = np.repeat(np.arange(len(few)), count)
        order = np.lexsort((d[few][unit], prints, key[few][unit]))
        hit = np.zeros(len(prints), dtype=bool)
        hit[order] = _again(parser, d[few][unit][order], key[few][unit][order], prints[order])
        # Neighbouring windows of a unit become one range.
        begins = hit.copy()
        begins[1:] &= ~hit[:-1] | (unit[1:] != unit[:-1])
        stops = hit.copy()
        stops[:-1] &= ~hit[1:] | (unit[1:] != unit[:-1])
        begin, stop = np.flatnonzero(begins), np.flatnonzero(stops)
        unit = unit[begin]
        out.append((d[few][unit], t[few][unit], pack(first[unit] + steps(count)[begin],
                                                     stop - begin + 1, REPEATED)))
    return _batch(("d", "t", "at"), map(np.concatenate, zip(*out)))


def _again(parser: Parser, d: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Rows (sorted by keys and d) whose keys are found again: in a smaller
    document, or anywhere else."""
    new = _starts(*keys)
    run, size = _runs(new)
    return d > d[np.flatnonzero(new)][run] if parser.earlier else size[run] > 1


def repeated_ranges(parser: Parser, documents: DataFrame) -> DataFrame:
    """``d, t, at``: ranges of windows of a document that are repeated."""
    docs = identified(documents)
    settled = written(
        _occurrences(parser, docs).repartition("key").sortWithinPartitions("key", "u", "d")
        .mapInArrow(lambda b: _names_at_a_time(b, lambda x: _settle(parser, x)),
                    "key long, d long, t long, at long"), "repeats-units")
    forget_shuffles(documents.sparkSession)
    repeated = F.col("at").bitwiseAND(F.lit(3)) == REPEATED
    windows = written(
        _windows(parser, docs, settled.filter(~repeated))
        .repartition("key").sortWithinPartitions("key", "u", "d")
        .mapInArrow(lambda b: _names_at_a_time(b, lambda x: _repeated_windows(parser, x)),
                    "d long, t long, at long"), "repeats-windows")
    forget_shuffles(documents.sparkSession)
    return settled.filter(repeated).select("d", "t", "at").unionByName(windows)


def apply_ranges(parser: Parser, documents: DataFrame, ranges: DataFrame, emit: Callable,
                 schema: str) -> DataFrame:
    """Every document with what its ranges cover: ``emit(ids, null ids, bytes,
    offsets, bounds, covered)`` gives the result columns of a piece."""
    listed = ranges.groupBy("d", "t").agg(F.collect_set("at").alias("ats"))
    joined = identified(documents).join(listed, ["d", "t"], "left") \
        .select("doc_id", "text", F.coalesce("ats", F.array().cast("array<bigint>")).alias("ats"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat = batch["ats"].offsets.to_numpy(), batch["ats"].values.to_numpy()
            for first_row, end_row, data, offsets in T.pieces(batch["text"]):
                bounds, _, _ = parser.elements(data, offsets)
                row = T.rows_of(ends[first_row:end_row + 1])
                first, count = unpack(flat[ends[first_row]:ends[end_row]])
                edge = np.zeros(bounds[-1] + 1, dtype=np.int64)
                np.add.at(edge, first + bounds[row], 1)
                np.add.at(edge, first + bounds[row] + count - 1 + parser.width, -1)
                covered = np.cumsum(edge[:-1]) > 0
                columns = emit(data, offsets, bounds, covered)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first_row, end_row - first_row),
                     *map(pa.array, columns.values())], names=["doc_id", *columns])

    return joined.mapInArrow(run, schema)


def per_row(bounds: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]
