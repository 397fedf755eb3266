"""Document fingerprints from statistically improbable byte windows.

Every window of 32 bytes has an entropy. The further it lies from that of ordinary prose, the rarer the
window; windows of very low entropy (runs, rulers) say nothing and are never chosen. In every stretch of 32
consecutive windows the rarest, leftmost of equals, scores a point; windows with 8 points or more are
features. Features enter Bloom filters of 2048 bits, five bits each; a filter with 160 features is full
and the next is chained on. The likeness of two fingerprints is the mean, over the filters of the shorter
chain, of the best overlap in the other beyond what chance gives, normalised to 0..1.

Counts of a byte within a window come from ranks among equal bytes, entropies from running integer sums and
minima of stretches from two block-wise scans, all vectorised over a bounded piece of text.

How it scales. The next document is found without a global window: shards are ranges of doc_id, and the first
rows of a shard also go to the shard before it. Cut points and first ids are one number per shard. Texts are
shuffled once.

Edge cases. Null and empty texts have an empty fingerprint; it is like another empty one (1) and unlike the
rest (0). Texts shorter than a window are one feature. Rows that share a doc_id follow each other by text; a
row without one comes last. After the last document comes the first; a lone document follows itself.
"""
from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import spans as S
from .common import partitions, register, table

WINDOW, STRETCH, POINTS = 32, 32, 8
BITS, FEATURES, PROBES = 2048, 160, 5
_UNIT = 1 << 10  # scale of the integer entropy sums
_TYPICAL = int(48 * _UNIT)  # sum of c * log2(c) over a window of ordinary prose, 3.5 bits a byte
_DULL = int(109 * _UNIT)  # above it, less than 1.6 bits a byte
_CHANCE = 0.1  # share of the way from expected to full overlap that still counts as chance
_SUM = np.r_[0, np.round(np.arange(1, WINDOW + 2) * np.log2(np.arange(1, WINDOW + 2)) * _UNIT)].astype(np.int64)
_LATE = np.iinfo(np.int64).max


def _entropy_sums(data: np.ndarray) -> np.ndarray:
    """Sum of c * log2(c) over the counts c of the bytes of the window that ends at each place."""
    n = len(data)
    order = np.argsort(data, kind="stable")
    keys = data[order].astype(np.int64) << 40 | order
    before, after = np.zeros(n, np.int64), np.ones(n, np.int64)
    for lag in range(1, min(WINDOW, n)):  # equal bytes stand side by side; few lags reach far in prose
        near = keys[lag:] - keys[:-lag] < WINDOW
        if not near.any():
            break
        before[lag:] += near
        after[:-lag] += near
    step = np.empty(n, np.int64)
    step[order] = _SUM[before + 1] - _SUM[before]
    gone = np.empty(n, np.int64)
    gone[order] = _SUM[after - 1] - _SUM[after]
    step[WINDOW:] += gone[:-WINDOW]
    return np.cumsum(step)


def features(data: np.ndarray, offsets: np.ndarray):
    """(hashes, counts): the chosen windows of every text in order, each distinct one once."""
    docs = len(offsets) - 1
    size = np.diff(offsets)
    pre = S._TEXT.prefix(S._BYTE[data])
    picks = []
    room = np.maximum(size - WINDOW + 1, 0)  # windows of each text
    if room.any():
        sums = _entropy_sums(data)
        n = len(data)
        rank = np.full(n + 2 * STRETCH, _LATE, np.int64)
        ends = S.ragged(offsets[:-1] + WINDOW - 1, room)
        place = ends - (WINDOW - 1)
        s = sums[ends]
        rare = (512 * _UNIT - np.abs(s - _TYPICAL)) << 40 | place
        rank[place] = np.where(s > _DULL, _LATE, rare)
        blocks = rank[: (len(rank) // STRETCH) * STRETCH].reshape(-1, STRETCH)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        p = S.ragged(offsets[:-1], np.maximum(room - STRETCH + 1, 0))
        best = np.minimum(right[p], left[p + STRETCH - 1])
        best = best[best != _LATE] & ((1 << 40) - 1)
        picks.append(np.flatnonzero(np.bincount(best, minlength=1) >= POINTS))
        few = np.flatnonzero((room > 0) & (room < STRETCH))
        if len(few):
            part = rank[S.ragged(offsets[few], room[few])]
            low = np.minimum.reduceat(part, np.cumsum(room[few]) - room[few])
            picks.append(low[low != _LATE] & ((1 << 40) - 1))
    short = np.flatnonzero((size > 0) & (size < WINDOW))
    start = np.sort(np.concatenate([*picks, offsets[short]]).astype(np.int64))
    owner = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(start + WINDOW, offsets[owner + 1])
    h = S.mix(S._TEXT.span(pre, start, end) + (end - start).astype(np.uint64))
    order = np.lexsort((start, h, owner))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    return h[~again], np.bincount(owner[~again], minlength=docs)


def filters(h: np.ndarray, counts: np.ndarray):
    """(bit rows, filters of each text): the chained Bloom filters of all texts."""
    chains = -(-counts // FEATURES)
    row = S.ragged(np.zeros(len(counts), np.int64), counts) // FEATURES + np.repeat(np.cumsum(chains) - chains, counts)
    bits = np.zeros((int(chains.sum()), BITS), bool)
    for k in range(PROBES):
        bits[row, ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1), chains


def fingerprints(data, offsets) -> list[np.ndarray]:
    """The filters of every text, one row of 256 bytes each."""
    out = []
    for a, b in S.pieces(offsets, 1 << 17):  # small enough for the processor's caches
        bits, chains = filters(*features(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]))
        out += np.split(bits, np.cumsum(chains)[:-1])
    return out


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Normalised overlap of two chains of filters, 0 to 1."""
    if not len(one) or not len(two):
        return float(len(one) == len(two))
    if len(one) > len(two):
        one, two = two, one
    other = two.view(np.uint64)
    m = np.bitwise_count(other).sum(axis=1, dtype=np.int64)
    total = weight = 0.0
    for row in one.view(np.uint64):
        n = int(np.bitwise_count(row).sum())
        both = np.bitwise_count(other & row).sum(axis=1, dtype=np.int64)
        least, most = n * m / BITS, np.minimum(n, m)
        spread = np.sqrt(n * (m / BITS) * (1 - m / BITS))
        floor = least + np.maximum(_CHANCE * (most - least), 4 * spread)  # few bits often fall on a dense filter
        total += n * float(np.max(np.clip((both - floor) / np.maximum(most - floor, 1e-9), 0, 1)))
        weight += n
    return total / weight


def _compare(rows: pa.Table) -> pa.Table:
    """All columns of the result for one shard; rows that are not its own only serve as the next document."""
    rows = rows.sort_by([("own", "descending"), ("doc_id", "ascending"), ("text", "ascending")])
    n = int(np.count_nonzero(rows["own"].to_numpy()))
    texts = rows["text"].to_pylist()
    follow = [*texts[1: n], texts[n] if len(texts) > n else texts[0]] if n else []
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, follow)]
    own = fingerprints(*S.utf8(rows["text"]))[: n + 1] if n else []
    changed = fingerprints(*S.utf8(pa.array(edited, pa.large_string()))) if n else []
    after = [*own[1: n], own[n] if len(texts) > n else own[0]] if n else []
    text = lambda f: base64.b64encode(f.tobytes()).decode()
    return pa.table({
        "doc_id": rows["doc_id"].slice(0, n), "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        "fingerprint": pa.array([text(f) for f in own[:n]], pa.string()),
        "edited_fingerprint": pa.array([text(f) for f in changed], pa.string()),
        "near_edited": pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()),
        "near_next": pa.array([likeness(a, b) for a, b in zip(own, after)], pa.float64())})


def _shards(docs: DataFrame, n: int) -> tuple[np.ndarray, dict[int, int]]:
    """Cut points of doc_id ranges, and for the first id of each range the shard before it."""
    found = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    cuts = np.array(sorted({int(x) for x in found}), np.int64)

    def number(batches):
        for rows in batches:
            ids = rows.column("doc_id").drop_null().to_numpy(zero_copy_only=False)
            shard = np.searchsorted(cuts, ids, "right")
            order = np.lexsort((ids, shard))
            head = order[np.r_[True, shard[order][1:] != shard[order][:-1]]] if len(ids) else order
            yield pa.RecordBatch.from_arrays([pa.array(shard[head], pa.int32()), pa.array(ids[head])], ["shard", "doc_id"])
    first = docs.select("doc_id").mapInArrow(number, "shard int, doc_id bigint").groupBy("shard").agg(F.min("doc_id")).collect()
    first = sorted(map(tuple, first))  # one row per shard
    return cuts, {doc: first[k - 1][0] for k, (_, doc) in enumerate(first)}


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its text with the last half replaced by the beginning of the next
    document, and the likeness of its fingerprint to that and to the next document's."""
    n = 4 * partitions(docs.sparkSession)
    cuts, heads = _shards(docs, n)
    last = max(heads.values(), default=0)

    def deal(batches):
        for rows in batches:
            column, text = rows.column("doc_id"), rows.column("text").fill_null("")
            ids = column.to_numpy(zero_copy_only=False) if not column.null_count else None
            if ids is not None:
                shard = np.searchsorted(cuts, ids, "right")
            else:
                known = ~column.is_null().to_numpy(zero_copy_only=False)
                ids = column.fill_null(0).to_numpy(zero_copy_only=False)
                shard = np.where(known, np.searchsorted(cuts, ids, "right"), last)
            also = np.array([i for i, d in enumerate(column.to_pylist()) if d in heads], np.int64)
            take = np.r_[np.arange(len(ids)), also]
            shard = np.r_[shard, [heads[column[i].as_py()] for i in also]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(np.arange(len(take)) < len(ids)), column.take(pa.array(take)), text.take(pa.array(take))],
                ["shard", "own", "doc_id", "text"])
    dealt = docs.select("doc_id", "text").mapInArrow(deal, "shard int, own boolean, doc_id bigint, text string")
    return dealt.groupBy("shard").applyInArrow(_compare, (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"))


@register("op9_fingerprints")
def op9_fingerprints(spark, sf_dir):
    return fingerprint_neighbours(table(spark, sf_dir, "documents"))
