"""Vectorised word work on Arrow text columns.

A batch is read in pieces of a few MB, so that memory doesn't follow the batch size; one
text is never split. Words are located by byte classes on the UTF-8 bytes; each gets a
64-bit hash. Equal words have equal hashes; that different ones share one has a
probability of about 2**-64 for each pair, which the operators accept or verify.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
PIECE_BYTES = 4 << 20

#: Everything but blank, tab, line feed, vertical tab, form feed and carriage return.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Lower-case ASCII letters, digits and all that is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> U64(30))) * _C2
    h = (h ^ (h >> U64(27))) * _C3
    return h ^ (h >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes."""
    raw, offs = text_bytes(column)
    n, low = len(offs) - 1, 0
    while low < n:
        high = int(np.searchsorted(offs, offs[low] + limit, "right")) - 1
        high = min(n, max(low + 1, high))
        yield low, high, raw[offs[low] : offs[high]], offs[low : high + 1] - offs[low]
        low = high


class Words:
    """The words of a piece: ``start`` and ``end`` bytes; ``first[d]:first[d+1]`` are those of text d."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, is_word: np.ndarray):
        inside = is_word[data]
        self.data, self.offs = data, offs
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        cuts = offs[:-1][offs[:-1] < len(data)]
        before[cuts] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        after[cuts[cuts > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def text(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_spans(self.data, self.start, self.end)
        return self._hash

    def per_text(self, by_word: np.ndarray) -> np.ndarray:
        """Sums of a value of each word, by text."""
        total = np.zeros(len(by_word) + 1, dtype=np.int64)
        np.cumsum(by_word, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of ``size`` words inside one text."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        text = self.text
        at = np.flatnonzero(text[:n] == text[size - 1 :])
        return at, mix(chained(self.hash, size))[at]


def chained(h: np.ndarray, size: int) -> np.ndarray:
    """Order-dependent combination of each ``size`` consecutive hashes."""
    n = len(h) - size + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for j in range(size if n > 0 else 0):
        out *= _C1
        out += h[j : n + j]
    return out


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes at a step."""
    size = end - start
    h = mix(size.astype(np.uint64) * _C1 + _C2)
    if not len(start):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    live, at = np.arange(len(start)), 0
    while len(live):
        whole = len(live) == len(start)
        block = eight[(start if whole else start[live]) + at].view("<u8").ravel()
        block &= _MASK[np.minimum((size if whole else size[live]) - at, 8)]
        if whole:
            h = (h ^ block) * _C1
            h ^= h >> U64(29)
        else:
            x = (h[live] ^ block) * _C1
            h[live] = x ^ (x >> U64(29))
        at += 8
        live = live[size[live] > at]
    return mix(h)


def sums_at(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of a value of each byte, by text."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words at one of the (distinct) starts."""
    edge = np.zeros(n + size + 1, dtype=np.int32)
    edge[starts] += 1
    edge[starts + size] -= 1
    return np.cumsum(edge[:n]) > 0
