"""Words and fingerprints of whole texts, as numpy arrays over Arrow batches.

Texts are looked at as UTF-8 bytes. A word is a longest run of bytes that are
neither space nor 0x09 to 0x0D; these are single bytes in UTF-8, so words never
cut a character. Fingerprints are 64-bit polynomial sums, mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text looked at in one go; a longer text is one piece of its own.
PIECE_BYTES = 1 << 19
U64 = np.uint64
#: Odd multipliers of the polynomial sums.
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F
_POWERS: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    """A random-looking 64-bit value for each byte."""
    return mix((np.arange(256, dtype=U64) + U64(1)) * U64(BASE_A) + U64(seed))


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64, ``size`` of each at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < size:
        size = max(size, PIECE_BYTES + 64)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[base] = tuple(out)
    return have


class Prefix:
    """Fingerprints of any range of a sequence, from one running sum."""

    def __init__(self, values: np.ndarray, base: int):
        forward, self.back = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * forward[:len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def rolling(self, width: int) -> np.ndarray:
        """Fingerprints of all ranges of this width, by their start."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.back[:n]
                   + U64(width * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: ``(first row, end row, bytes, offsets)``.

    NULL counts as empty. ``offsets`` has one entry more than the rows.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if len(texts) else pa.array([], pa.large_binary())
    texts = texts.fill_null(b"")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size \
        else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text (and the end)."""
    solid = ~_BLANK[data]
    n = len(data)
    begins = np.zeros(n + 1, dtype=bool)
    begins[:n] = solid
    begins[1:n] &= ~solid[:-1]
    ends = np.zeros(n + 1, dtype=bool)
    ends[1:] = solid
    ends[1:n] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    joined = cuts[solid[cuts] & solid[cuts - 1]]
    begins[joined] = True
    ends[joined] = True
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends), np.searchsorted(starts, offsets)


def word_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of each word."""
    out = np.empty(len(starts), dtype=U64)
    table = byte_table(seed)
    first = 0
    while first < len(starts):  # a few hundred thousand bytes at a time
        base = starts[first]
        last = max(int(np.searchsorted(ends, base + PIECE_BYTES, "right")), first + 1)
        prefix = Prefix(table[data[base:ends[last - 1]]], BASE_A)
        out[first:last] = prefix.of(starts[first:last] - base, ends[first:last] - base)
        first = last
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte stays."""
    return _LOWER[data]


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each element, given each row's first element and the end."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


#: 0 blank, 1 letters, digits and all bytes beyond ASCII, 2 any other character.
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[_BLANK] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1


def token_bounds(data: np.ndarray, offsets: np.ndarray) \
        -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of letters or of other marks: starts, ends, the first token of
    each text (and the end), and whether it is a run of letters."""
    kind, n = _CLASS[data], len(data)
    change = np.ones(n + 1, dtype=bool)
    change[1:n] = kind[1:] != kind[:-1]
    change[offsets] = True
    starts = np.flatnonzero(change[:-1] & (kind != 0))
    ends = np.flatnonzero(change[1:] & (kind != 0)) + 1
    return starts, ends, np.searchsorted(starts, offsets), kind[starts] == 1
