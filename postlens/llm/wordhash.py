"""Words of whole Arrow batches as numpy arrays, without a Python object per word.

A word is ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes.  Texts are taken in pieces of about
``PIECE`` bytes of whole documents, so memory does not follow the batch; one longer document makes
a piece of its own.  A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_B = 0x9E3779B97F4A7C15 | 1                     # odd, so it has an inverse modulo 2**64
_B_INV = pow(_B, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PUNCT = np.zeros(256, bool)
PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n; kept and grown as longer pieces come."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]))
        for k, b in (("up", _B), ("down", _B_INV)):
            a = np.full(size, b, U)
            a[0] = 1
            _powers[k] = np.cumprod(a)
    return _powers["up"][:n], _powers["down"][:n]


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each values[start:end], from prefix sums of a polynomial modulo 2**64."""
    return range_hashes(values, start, [end])[0]


def range_hashes(values: np.ndarray, start: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
    """The same for several ends of each start."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1], out=sums[1:])
    low, scale = sums[start], down[start]
    return [mix((sums[e] - low) * scale + (e - start).astype(U) * U(0xD6E8FEB86659FD93)) for e in ends]


@dataclass
class Piece:
    """Consecutive documents of a batch: rows ``row`` .. ``row + len(bounds) - 2``."""

    row: int
    bounds: np.ndarray      # document k has the words bounds[k]:bounds[k + 1]
    start: np.ndarray       # byte offsets of each word in data
    end: np.ndarray
    hash: np.ndarray        # uint64, by the word's bytes
    data: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.bounds) - 1

    def doc_of(self) -> np.ndarray:
        """Document (within the piece) of each word."""
        return np.repeat(np.arange(self.docs), np.diff(self.bounds))

    def joined(self, words: slice | np.ndarray) -> bytes:
        """These words joined by one space."""
        raw = self.data.tobytes() if self._raw is None else self._raw
        self._raw = raw
        idx = range(words.start, words.stop) if isinstance(words, slice) else words
        return b" ".join([raw[self.start[i]:self.end[i]] for i in idx])

    def prefix_hashes(self, sizes: list[int]) -> list[np.ndarray]:
        """Hash of the first bytes of each word, for each number of bytes."""
        return range_hashes(_BYTE[self.data], self.start, [np.minimum(self.end, self.start + k) for k in sizes])

    def char_offsets(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last character of these words within their document's text."""
        before = np.concatenate([[0], np.cumsum((self.source & 0xC0) != 0x80)])
        doc = np.searchsorted(self.bounds, words, "right") - 1
        base = before[self.offsets[doc]]
        return before[self.origin[self.start[words]]] - base, before[self.origin[self.end[words] - 1] + 1] - base

    _raw: bytes | None = None
    source: np.ndarray | None = None      # the bytes before stripping
    origin: np.ndarray | None = None      # place in source of each byte of data
    offsets: np.ndarray | None = None     # documents in source


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (one more than rows) and the bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    return off.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def raw_pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, byte offsets, bytes) of runs of whole documents."""
    if not len(column):
        return
    off, data = text_buffers(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, "right")) - 1)
        j = min(j, len(column))
        yield i, off[i:j + 1] - off[i], data[off[i]:off[j]]
        i = j


def word_pieces(column: pa.Array, lower: bool = False, strip: bool = False) -> Iterator[Piece]:
    """``lower``: A-Z count as a-z.  ``strip``: ASCII punctuation is left out of the words."""
    for row, off, data in raw_pieces(column):
        source, offsets, origin = data, off, None
        if lower:
            data = LOWER[data]
        if strip:
            keep = ~PUNCT[data]
            origin = np.flatnonzero(keep)
            off = np.concatenate([[0], np.cumsum(keep)])[off]
            data = data[keep]
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~SPACE[data]
        first = np.zeros(n + 1, bool)
        first[off] = True
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
        yield Piece(row, np.searchsorted(start, off), start, end, range_hash(_BYTE[data], start, end), data,
                    source=source, origin=np.arange(n) if origin is None else origin, offsets=offsets)


def windows(values: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` values from each position, and whether they lie in one document."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    start = np.arange(n)
    last = np.repeat(bounds[1:], np.diff(bounds))[:n]
    return range_hash(values, start, start + size), start + size <= last


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    done, out = 1, a
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def as_long(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
