"""Vectorised spans of texts inside Arrow tasks: words, lines, rolling hashes, ragged gathers.

Texts are handled as the UTF-8 bytes that Arrow already holds. A span is hashed by its blocks of eight
bytes: each is mixed with a key of its place by a bijection that is not linear, and the sum is mixed
again with the length. A polynomial modulo 2**64, whatever its base, gives equal values to texts built by
the Thue-Morse rule and their mirror images; ``Base`` therefore serves short windows only.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = b" \t\n\x0b\x0c\r"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x += _GOLD
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Base:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, seed: int):
        self.b = int(mix(np.array([seed], np.uint64))[0]) | 1
        self.inv = pow(self.b, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)])
                                  for b in (self.b, self.inv))
        return self.up, self.down

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums from which ``span`` takes the hash of any range of ``values``."""
        up, _ = self.upto(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=out[1:])
        return out

    def span(self, prefix, start, end):
        _, down = self.upto(len(prefix))
        return (prefix[end] - prefix[start]) * down[start]


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(7919))
_TEXT = Base(1)
_JOIN = np.uint64(0xD6E8FEB86659FD93)
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)
_WORD = np.ones(256, bool)
_WORD[list(SPACE)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def utf8(column, offset_type=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no rows
        column = pa.array([], column.type)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, offset_type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], (off - off[0]).astype(offset_type)


def pieces(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges of at most ``limit`` bytes; a longer text stands alone. Bounds the arrays of a pass."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def chunks(column, limit: int = 1 << 20):
    """(first row, end row, bytes, offsets) of bounded pieces of a column."""
    data, offsets = utf8(column)
    for a, b in pieces(offsets, limit):
        yield a, b, data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]


@dataclass
class Spans:
    """Spans of a chunk in text order; ``first[i]:first[i+1]`` are those of text i."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self):
        return np.diff(self.first)

    @property
    def text(self):
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def blocks(self, lower=False) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all spans in blocks of eight, the last of each filled with zeros; blocks of each span."""
        size = self.end - self.start
        count = (size + 7) >> 3
        at = ragged(np.zeros(len(count), np.int64), count)
        at *= 8
        left = np.repeat(size, count) - at
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = _LOWER[self.data] if lower else self.data
        at += np.repeat(self.start, count)
        out = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))[at]
        out &= _TAIL[np.minimum(left, 8) - 1]
        return out, count

    def hashes(self, lower=False, second=False) -> np.ndarray:
        return block_hashes(*self.blocks(lower), self.end - self.start, second)


def block_hashes(blocks, count, size, second=False) -> np.ndarray:
    """Hash of each run of ``count`` blocks, which hold ``size`` bytes or values."""
    seed = np.uint64(0x5851F42D4C957F2D if second else 0x14057B7EF767814F)
    place = ragged(np.zeros(len(count), np.int64), count)
    keys = mix(np.arange(int(count.max()) if len(count) else 0, dtype=np.uint64) ^ seed)
    total = np.zeros(len(blocks) + 1, np.uint64)
    np.cumsum(mix(blocks ^ keys[place]), out=total[1:])
    ends = np.cumsum(count)
    return mix((total[ends] - total[ends - count]) ^ mix(size.astype(np.uint64) ^ seed))


def words(data, offsets) -> Spans:
    """Maximal runs of bytes other than ``SPACE`` within each text."""
    inside = _WORD[data]
    opens, closes = inside.copy(), inside.copy()
    if len(data):
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        full = offsets[1:] > offsets[:-1]
        heads, tails = offsets[:-1][full], offsets[1:][full] - 1
        opens[heads] = inside[heads]
        closes[tails] = inside[tails]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Spans(data, offsets, start, end, np.searchsorted(start, offsets))


def lines(data, offsets) -> Spans:
    """Parts of each text between line feeds; every text has one at least."""
    n = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    order = np.searchsorted(feeds, offsets)
    first = order + np.arange(n + 1)
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    head = np.zeros(first[-1], bool)
    head[first[:-1]] = True
    tail = np.zeros(first[-1], bool)
    tail[first[1:] - 1] = True
    start[head], end[tail] = offsets[:-1], offsets[1:]
    start[~head], end[~tail] = feeds + 1, feeds
    return Spans(data, offsets, start, end, first)


def strip(spans: Spans) -> Spans:
    """The same spans without ``SPACE`` at both ends."""
    inside = np.flatnonzero(_WORD[spans.data])
    if not len(inside):
        return Spans(spans.data, spans.offsets, spans.start, spans.start, spans.first)
    lo = np.searchsorted(inside, spans.start)
    hi = np.searchsorted(inside, spans.end)
    full = hi > lo
    start = np.where(full, inside[np.minimum(lo, len(inside) - 1)], spans.start)
    end = np.where(full, inside[np.maximum(hi, 1) - 1] + 1, spans.start)
    return Spans(spans.data, spans.offsets, start, end, spans.first)


def code_points(data, start, end) -> np.ndarray:
    """Number of code points in each span."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return lead[end] - lead[start]


def windows(spans: Spans, n: int) -> np.ndarray:
    """Positions p such that spans p .. p+n-1 lie in one text."""
    total = int(spans.first[-1])
    if total < n:
        return np.zeros(0, np.int64)
    room = np.repeat(spans.first[1:], spans.counts) - np.arange(total)
    return np.flatnonzero(room >= n)


def gram_hashes(values: np.ndarray, at: np.ndarray, n, second=False) -> np.ndarray:
    """Hash of the n values from each position in ``at``; n may be an array.

    Windows of one length are put together from windows of powers of two, each step mixed.
    """
    if isinstance(n, np.ndarray):
        return block_hashes(values[ragged(at, n)], n, n, second)
    x = mix(values ^ np.uint64(0xA5A5A5A5 if second else 0x3C6EF372))
    out, reach, size = None, 0, 1
    while True:
        if n & size:
            part = x[at + reach]
            out = part if out is None else mix(out * _JOIN + part)
            reach += size
        if 2 * size > n:
            return out
        x = mix(x[:-size] * _JOIN + x[size:])
        size *= 2


def ragged(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start[i] .. start[i]+counts[i]-1."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(total)


def covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a window of n that begins at one of ``at``."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + n, total), -1)
    return np.cumsum(step[:-1]) > 0


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values stand in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values
