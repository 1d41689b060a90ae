"""Words of whole texts, hashed in numpy without a Python loop over words.

A word is a maximal run of characters other than space and the control
characters 0x09 to 0x0D. All of these are single bytes in UTF-8, so words are
found in the bytes. A span of bytes is hashed in blocks of eight: each block is
mixed, mixed again with its number, and the sum is mixed with the length. Spans
of up to eight bytes and equal length never meet; others meet by chance alone,
whatever their pattern. A seed gives an independent second hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer text makes a slice of its own.
SLICE = 1 << 19
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finalizer that spreads 64-bit values (two multiply and shift steps)."""
    x = x + np.uint64(salt & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Of a block of eight bytes, the first so many.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class Slice:
    """Some whole texts: their bytes, where each begins, and the words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None):
        self.data, self.offsets = data, offsets
        self.docs = len(offsets) - 1
        inside = ~_SPACE[data] if inside is None else inside
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: Where each text's words begin among all words.
        self.word_offsets = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.word_offsets)
        self.doc_of_word = np.repeat(np.arange(self.docs), self.counts)
        self._views: dict[bool, np.ndarray] = {}

    def _eights(self, lower: bool) -> np.ndarray:
        """At each byte the eight bytes from there on, as one number: a view, not a copy for each."""
        if lower not in self._views:
            padded = np.zeros(len(self.data) + 9, dtype=np.uint8)
            padded[: len(self.data)] = _LOWER[self.data] if lower else self.data
            self._views[lower] = np.ndarray(len(self.data) + 1, "<u8", padded, 0, (1,))
        return self._views[lower]

    def spans(self, starts: np.ndarray, ends: np.ndarray, lower: bool = True, seed: int = 0) -> np.ndarray:
        """Hashes of byte spans; the length counts too."""
        eights, size = self._eights(lower), ends - starts
        out = mix(eights[starts] & _FIRST[np.minimum(size, 8)], seed)
        long = np.flatnonzero(size > 8)
        if len(long):
            more = (size[long] - 1) // 8
            begin = np.cumsum(more) - more
            number = np.arange(more.sum()) - np.repeat(begin, more) + 1
            at = np.repeat(starts[long], more) + 8 * number
            left = np.minimum(np.repeat(ends[long], more) - at, 8)
            blocks = mix(mix(eights[at] & _FIRST[left], seed) + number.astype(np.uint64) * np.uint64(_ODD))
            out[long] += np.add.reduceat(blocks, begin)
        return mix(out + size.astype(np.uint64) * np.uint64(_ODD), seed)

    def words(self, lower: bool = True) -> np.ndarray:
        return self.spans(self.starts, self.ends, lower)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n lower-cased words, text by text, and where each text's begin.

        A text with fewer words, but one at least, has its whole sequence as the only one.
        """
        h = self.words()
        total = np.zeros(max(len(h) - n + 1, 0), dtype=np.uint64)
        factor = 1
        for i in range(n):
            factor = factor * _ODD & _MASK
            total += mix(h[i : i + len(total)], i + 1) * np.uint64(factor)
        own = self.doc_of_word
        whole = own[: len(total)] == own[n - 1 :] if len(total) else np.zeros(0, dtype=bool)
        out = mix(total[whole], n)
        sizes = np.maximum(self.counts - n + 1, 0)
        short = np.flatnonzero((self.counts > 0) & (self.counts < n))
        if len(short):
            extra = np.zeros(len(short), dtype=np.uint64)
            for i in range(n - 1):
                has = self.counts[short] > i
                at = self.word_offsets[:-1][short[has]] + i
                extra[has] += mix(h[at], i + 1) * np.uint64(pow(_ODD, i + 1, 1 << 64))
            extra = mix(extra, 0x5EED + 0) ^ mix(self.counts[short].astype(np.uint64), 0xABC)
            at = np.concatenate(([0], np.cumsum(sizes)))[short]
            out = np.insert(out, at, extra)
            sizes = sizes.copy()
            sizes[short] = 1
        return out, np.concatenate(([0], np.cumsum(sizes)))


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of whole texts, about SLICE bytes together; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.binary()):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if column.type == pa.binary() else "")
    rows = len(column)
    if not rows:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    begin = 0
    while begin < rows:
        end = int(np.searchsorted(offsets, offsets[begin] + SLICE, side="right")) - 1
        end = min(max(end, begin + 1), rows)
        yield begin, end, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def sort_each(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorts each group in place; returns a mask of the first of equal values in each group."""
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    first = np.ones(len(values), dtype=bool)
    if len(values):
        first[1:] = values[1:] != values[:-1]
        inner = offsets[:-1]
        first[inner[inner < len(values)]] = True
    return first
