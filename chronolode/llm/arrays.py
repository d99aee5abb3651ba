"""Text batches as flat numpy arrays: words, their 64-bit fingerprints and n-gram fingerprints.

Works on the UTF-8 bytes of an Arrow column. White space and A-Z are ASCII, so splitting and
lower-casing bytes is the same as doing it on code points. Two different words (or n-grams)
share a fingerprint with probability 2^-64; counts and set sizes are exact up to that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2^64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column without NULLs."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line (rows split at line feeds), in order."""
    rows = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    feed_rows = np.searchsorted(offsets, feeds, "right") - 1
    start = np.concatenate([offsets[:-1], feeds + 1])
    row = np.concatenate([np.arange(rows), feed_rows])
    # A line feed may end its row, and so begin where the next row does: order by row first.
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = offsets[row + 1].copy()
    same = np.flatnonzero(row[1:] == row[:-1])
    end[same] = start[same + 1] - 1
    return start, end, row


class Words:
    """Words of all rows of a string column, in order.

    ``start`` and ``end`` are byte positions in ``data``, ``row`` the row of each word,
    ``first`` the index of each row's first word (one more entry than rows), ``hash`` the
    word fingerprints (of the lower-cased word if asked).
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        data, offsets = utf8(column)
        self.data, self.offsets, self.rows = data, offsets, len(column)
        # Comparisons of bytes, not table lookups: they are several times faster.
        gap = (data == 32) | (data - np.uint8(9) < 5)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.ones(len(data), bool)
        before[1:] = gap[:-1]
        after = np.ones(len(data), bool)
        after[:-1] = gap[1:]
        self.start = np.flatnonzero(~gap & (before | edge[:-1]))
        self.end = np.flatnonzero(~gap & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))
        folded = data + (data - np.uint8(65) < 26) * np.uint8(32) if lower else data
        told = folded.astype(np.uint64)
        told += np.uint64(1)
        told *= _power(_BASE, len(data))
        self._total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(told, out=self._total[1:])
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of byte spans (polynomials of their bytes, modulo 2^64, mixed)."""
        back = _power(_INVERSE, len(self.data) + 1)
        return mix((self._total[end] - self._total[start]) * back[start])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of every line (rows split at line feeds), in order."""
        return line_spans(self.data, self.offsets)

    def count(self) -> np.ndarray:
        """Words per row."""
        return np.diff(self.first)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of all runs of n words inside a row, and the index of their first word."""
        last = len(self.hash) - n + 1
        if last <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[:last] == self.row[n - 1 :])
        code = np.zeros(len(at), np.uint64)
        for k in range(n):
            code = code * np.uint64(0x9FB21C651E98DF25) + self.hash[at + k]
        return mix(code), at


def per_row(rows: np.ndarray, n: int) -> np.ndarray:
    """How often each row number occurs, as int64."""
    return np.bincount(rows, minlength=n).astype(np.int64)


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Running number of code points that begin before each byte."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total


def order_of(row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Order by row and then code, by one sort of row numbers and leading code bits.

    Should the bits left out matter, both are sorted whole.
    """
    bits = int(row.max()).bit_length() if len(row) else 0
    if not bits:
        return np.argsort(code)
    key = (row.astype(np.uint64) << np.uint64(64 - bits)) | (code >> np.uint64(bits))
    order = np.argsort(key)
    key, code_in = key[order], code[order]
    if ((key[1:] == key[:-1]) & (code_in[1:] != code_in[:-1])).any():
        return np.lexsort((code, row))
    return order


def sets(
    row: np.ndarray, code: np.ndarray, by: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, code) pairs, ordered by row and then code, or what stands for it."""
    order = order_of(row, code if by is None else by)
    row, code = row[order], code[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[keep], code[keep]
