"""Token sequences of distinct spans, kept by hash within one Python worker."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .spans import Spans, block_hashes, ragged


class _Pile:
    """An array that grows at its end; its room doubles, so appending costs no copy of the whole each time."""

    def __init__(self, dtype, *shape):
        self.room, self.n = np.empty((1 << 12, *shape), dtype), 0

    def add(self, values):
        end = self.n + len(values)
        if end > len(self.room):
            grown = np.empty((2 * end, *self.room.shape[1:]), self.room.dtype)
            grown[: self.n] = self.room[: self.n]
            self.room = grown
        self.room[self.n: end] = values
        self.n = end


class WordCache:
    """Encodes each distinct span once. ``encode`` gets byte strings, gives flat ids and their counts.

    A span counts as known only if its bytes are equal too; one whose hash alone is known is encoded by itself.
    The cache starts afresh before it holds more than ``limit`` spans or ``room`` bytes of text and ids, so a
    worker's memory is bounded by these and by the spans of one piece of text.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 600_000,
                 room: int = 64 << 20):
        self.encode, self.limit, self.room = encode, limit, room
        self._clear()

    def _clear(self):
        self.keys, self.blocks, self.pool = np.zeros(0, np.uint64), _Pile(np.uint64), _Pile(np.int32)
        self.row = np.zeros(0, np.int32)  # of ``at`` for each key: keys are sorted, rows are in the order of learning
        self.at = _Pile(np.int32, 4)  # first id, ids, first block, bytes

    def _full(self, spans: int, blocks: int) -> bool:
        return len(self.keys) + spans > self.limit or 8 * (self.blocks.n + blocks) + 4 * self.pool.n > self.room

    def _learn(self, keys, texts, blocks, count):
        ids, counts = self.encode(texts)
        row = np.stack([self.pool.n + np.cumsum(counts) - counts, counts,
                        self.blocks.n + np.cumsum(count) - count, [len(t) for t in texts]], axis=1)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.row = np.insert(self.row, place, self.at.n + np.arange(len(row)))
        self.at.add(row)
        self.blocks.add(blocks)
        self.pool.add(ids)

    def _unlike(self, at, blocks, count, size) -> np.ndarray:
        """Spans whose bytes differ from those kept under their hash."""
        odd = at[:, 3] != size
        first, n = np.where(odd, 0, at[:, 2]), np.where(odd, 0, count)
        mine = blocks[ragged(np.cumsum(count) - count, n)] if odd.any() else blocks
        differ = self.blocks.room[ragged(first, n)] != mine
        if differ.any():
            odd[np.repeat(np.arange(len(n)), n)[differ]] = True
        return np.flatnonzero(odd)

    def tokens(self, spans: Spans) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans in order, and the number of ids of each text."""
        blocks, n = spans.blocks()
        size = spans.end - spans.start
        distinct, lead, back = np.unique(block_hashes(blocks, n, size), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.keys):
            new = self.keys[np.minimum(place, len(self.keys) - 1)] != distinct
        raw = spans.data.tobytes()
        if new.any():
            if self._full(int(new.sum()), int(n[lead[new]].sum())):
                self._clear()
                new[:] = True
            first = lead[new]
            self._learn(distinct[new], [raw[i:j] for i, j in zip(spans.start[first], spans.end[first])],
                        blocks[ragged((np.cumsum(n) - n)[first], n[first])], n[first])
            place = np.searchsorted(self.keys, distinct)
        at = self.at.room[self.row[place][back]]
        start, count, pool = at[:, 0].astype(np.int64), at[:, 1].astype(np.int64), self.pool.room
        odd = self._unlike(at, blocks, n, size)
        if len(odd):
            ids, counts = self.encode([raw[i:j] for i, j in zip(spans.start[odd], spans.end[odd])])
            start[odd], count[odd] = len(pool) + np.cumsum(counts) - counts, counts
            pool = np.concatenate([pool, ids.astype(np.int32)])
        ids = pool[ragged(start, count)]
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        return ids, np.diff(total[spans.first])
