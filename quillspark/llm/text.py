"""Vectorised scanning of Arrow text columns: word spans and word hashes straight from the UTF-8 buffer.

No Python string is made for a word.  A word's hash is a polynomial over its bytes modulo 2**64,
taken from prefix sums, then mixed; equal words have equal hashes, and a chance clash of two
different words has a probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are scanned together; a longer text is scanned alone.
SLICE_BYTES = 4 << 20
_SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

LETTERS_DIGITS = np.zeros(256, bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    LETTERS_DIGITS[_a : _b + 1] = True
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED_BYTE_VALUES = BYTE_VALUES.copy()
FOLDED_BYTE_VALUES[0x41:0x5B] = BYTE_VALUES[0x61:0x7B]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = {"up": _powers(_BASE, 2 * _SEGMENT), "down": _powers(_INVERSE, 2 * _SEGMENT)}


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offset of each row in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows that hold ``limit`` bytes or are one row."""
    data, offsets = utf8(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """Words of a run of texts: byte spans ``starts``/``ends`` and ``bounds``, the first word of each text (and the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = LETTERS_DIGITS):
        self.data = data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind[data]
        begins = inside[1:-1] & ~inside[:-2]
        stops = inside[1:-1] & ~inside[2:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        cuts = cuts[inside[cuts] & inside[cuts + 1]]  # a word that would run on into the next text
        begins[cuts] = True
        stops[cuts - 1] = True
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def hashes(self, values: np.ndarray = FOLDED_BYTE_VALUES) -> np.ndarray:
        out, i, n = np.empty(len(self), np.uint64), 0, len(self)
        with np.errstate(over="ignore"):
            while i < n:
                j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + _SEGMENT)))
                base, stop = int(self.starts[i]), int(self.ends[j - 1])
                if stop - base > len(_POWERS["up"]):
                    up, down = _powers(_BASE, stop - base), _powers(_INVERSE, stop - base)
                else:
                    up, down = _POWERS["up"], _POWERS["down"]
                sums = np.zeros(stop - base + 1, np.uint64)
                np.cumsum(values[self.data[base:stop]] * up[: stop - base], out=sums[1:])
                a, b = self.starts[i:j] - base, self.ends[i:j] - base
                out[i:j] = (sums[b] - sums[a]) * down[a]
                i = j
            return mixed(out)

    def shingles(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of ``width`` words within a text and their bounds by text.

        A text of fewer words, but not none, has one shingle of all its words.
        """
        counts = self.counts()
        n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
        bounds = np.concatenate([[0], np.cumsum(n)])
        first = np.repeat(self.bounds[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
        span = np.repeat(np.minimum(counts, width), n)
        out = np.zeros(len(first), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(width):
                if (whole := span > j).all():
                    out = out * np.uint64(_BASE) + hashes[first + j]
                else:
                    out[whole] = out[whole] * np.uint64(_BASE) + hashes[first[whole] + j]
            return mixed(out ^ np.uint64(width)), bounds
