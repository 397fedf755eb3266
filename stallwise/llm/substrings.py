"""Substring deduplication by fixed-block anchors.

Every text is cut into non-overlapping blocks of half a window; their hashes are the index. Every
rolling window of that length probes it. A window of ``n`` words holds a whole block wherever it
starts, so each repeat of ``n`` words or more has a hit. Hits are then extended to maximal exact
repeats: the windows of ``n`` words around hits are compared by 96 bits of hash, and each word under
a window that also starts earlier is removed.

How it scales. Texts are dealt into buckets by doc_id; one exchange of them serves all three passes.
A bucket sends each distinct hash once, packed five or twelve bytes wide, so a passage that fills a
third of the corpus costs one entry per bucket and no pairs are ever formed. Replies go back packed
by bucket. Nothing passes through the driver.

Edge cases. Null and empty texts have no words. Rows that share a doc_id are ordered by text; rows
equal in both count as one after the other. A null doc_id sorts last. Extra columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import spans as S
from .common import bucketed, partitions, register, table

_BITS = 38  # of a probe's hash beside the part it is sent to; a false hit is discarded by the full comparison
_LAST = np.iinfo(np.int64).max


def _ordered(texts: pa.Table) -> pa.Table:
    """By doc_id, nulls last, and by text where doc_ids are equal."""
    return texts.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _walk(texts: pa.Table):
    """(first row, words) of bounded pieces."""
    for a, _, data, offsets in S.chunks(texts["text"]):
        yield a, S.words(data, offsets)


def _part(h, parts):
    return ((h >> np.uint64(_BITS)) % np.uint64(parts)).astype(np.int64)


def _probe(h):
    return h & np.uint64((1 << _BITS) - 1)


def _pack5(values) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]


def _unpack5(blob) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :5] = raw
    return wide.view("<u8").ravel()


def _rows(bucket: int, part: np.ndarray, *packed: np.ndarray) -> pa.Table:
    """One row for each part from entries sorted by part; a row holds its columns one after another."""
    heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    ends = np.r_[heads[1:], len(part)]
    return pa.table({"bucket": pa.array(np.full(len(heads), bucket), pa.int32()),
                     "part": pa.array(part[heads], pa.int32()),
                     "blob": pa.array([b"".join(x[i:j].tobytes() for x in packed) for i, j in zip(heads, ends)], pa.binary())})


def _replies(buckets, source, values) -> pa.Table:
    """One row for each bucket that gets ``values``; ``source`` is the row each came from."""
    order = np.argsort(source, kind="stable")
    source, values = source[order], values[order]
    heads = np.flatnonzero(np.r_[True, source[1:] != source[:-1]]) if len(source) else np.zeros(0, np.int64)
    ends = np.r_[heads[1:], len(source)]
    return pa.table({"bucket": pa.array(buckets[source[heads]], pa.int32()),
                     "blob": pa.array([values[i:j].tobytes() for i, j in zip(heads, ends)], pa.binary())})


def _anchors(n: int, parts: int):
    """Distinct hashes of all rolling windows of half length; two low bits: is a block, occurs twice."""
    half = n // 2

    def send(texts: pa.Table) -> pa.Table:
        bucket = texts["bucket"][0].as_py()
        found = []
        for _, spans in _walk(texts):
            h, at = spans.hashes(), S.windows(spans, half)
            grams = S.gram_hashes(h, at, half)
            block = (at - np.repeat(spans.first[:-1], spans.counts)[at]) % half == 0
            found.append((grams, block))
        grams, block = (np.concatenate(x) for x in zip(*found))
        key = (_part(grams, parts).astype(np.uint64) << np.uint64(_BITS)) | _probe(grams)
        order = np.argsort(key)
        key, block = key[order], block[order]
        if not len(key):
            return _rows(bucket, np.zeros(0, np.int64), np.zeros((0, 5), np.uint8))
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        twice = np.diff(np.r_[heads, len(key)]) > 1
        block = np.logical_or.reduceat(block, heads)
        key = key[heads]
        values = (_probe(key) << np.uint64(2)) | (block.astype(np.uint64) << np.uint64(1)) | twice.astype(np.uint64)
        return _rows(bucket, (key >> np.uint64(_BITS)).astype(np.int64), _pack5(values))
    return send


def _match(rows: pa.Table) -> pa.Table:
    """Hashes of one part that occur more than once, one of them as a block: back to each bucket that has them."""
    blobs = rows["blob"].to_pylist()
    values = np.concatenate([_unpack5(b) for b in blobs])
    source = np.repeat(np.arange(len(blobs)), [len(b) // 5 for b in blobs])
    order = np.argsort(values >> np.uint64(2), kind="stable")
    values, source = values[order], source[order]
    probe = values >> np.uint64(2)
    heads = np.flatnonzero(np.r_[True, probe[1:] != probe[:-1]])
    size = np.diff(np.r_[heads, len(probe)])
    flags = np.bitwise_or.reduceat(values & np.uint64(3), heads)
    hit = np.repeat(((size > 1) | (flags & np.uint64(1) > 0)) & (flags & np.uint64(2) > 0), size)
    part = np.uint64(rows["part"][0].as_py())
    return _replies(rows["bucket"].to_numpy(), source[hit], (part << np.uint64(_BITS)) | probe[hit])


_ENTRY = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<i8"), ("at", "<u4")])


def _entries(blob: bytes) -> np.ndarray:
    out = np.empty(len(blob) // _ENTRY.itemsize, _ENTRY)
    at = 0
    for name in _ENTRY.names:
        out[name] = np.frombuffer(blob, _ENTRY[name], len(out), at)
        at += out[name].nbytes
    return out


def _extend(n: int, parts: int):
    """The windows of n words around hits, each distinct one with its first place in the bucket."""
    half = n // 2

    def send(texts: pa.Table, hits: pa.Table) -> pa.Table:
        none = _rows(0, np.zeros(0, np.int64), np.zeros((0, 1), np.uint8))
        if not len(texts) or not len(hits):
            return none
        texts = _ordered(texts)
        known = np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in hits["blob"].to_pylist()]))
        ids = texts["doc_id"].fill_null(_LAST).to_numpy()
        found = []
        for row, spans in _walk(texts):
            h, at = spans.hashes(), S.windows(spans, half)
            grams = S.gram_hashes(h, at, half)
            key = (_part(grams, parts).astype(np.uint64) << np.uint64(_BITS)) | _probe(grams)
            total = np.zeros(len(h) + 1, np.int64)
            mark = np.zeros(len(h), bool)
            mark[at] = S.member(key, known)
            np.cumsum(mark, out=total[1:])
            at = S.windows(spans, n)
            at = at[total[at + n - half + 1] > total[at]]
            doc = spans.text[at]
            entry = np.empty(len(at), _ENTRY)
            entry["a"], entry["b"] = S.gram_hashes(h, at, n), S.gram_hashes(h, at, n, second=True) >> np.uint64(32)
            entry["doc"], entry["at"] = ids[row + doc], at - spans.first[doc]
            found.append(entry)
        entry = np.concatenate(found)
        if not len(entry):
            return none
        part = _part(entry["a"], parts)
        order = np.lexsort((entry["b"], entry["a"], part))  # stable: the first place of equal windows leads
        entry, part = entry[order], part[order]
        head = np.r_[True, (entry["a"][1:] != entry["a"][:-1]) | (entry["b"][1:] != entry["b"][:-1])]
        entry, part = entry[head], part[head]
        order = np.lexsort((entry["at"], entry["doc"], part))  # equal doc_ids side by side compress well
        return _rows(texts["bucket"][0].as_py(), part[order], *(entry[c][order] for c in _ENTRY.names))
    return send


def _earliest(rows: pa.Table) -> pa.Table:
    """Windows of one part that start earlier in another bucket: told to every bucket but the first."""
    blobs = rows["blob"].to_pylist()
    entry = np.concatenate([_entries(b) for b in blobs])
    source = np.repeat(np.arange(len(blobs)), [len(b) // _ENTRY.itemsize for b in blobs])
    order = np.lexsort((entry["at"], entry["doc"], entry["b"], entry["a"]))
    entry, source = entry[order], source[order]
    later = np.r_[False, (entry["a"][1:] == entry["a"][:-1]) & (entry["b"][1:] == entry["b"][:-1])]
    return _replies(rows["bucket"].to_numpy(), source[later], entry["a"][later])


def _remove(n: int, with_text: bool):
    """Drops the words under windows that start earlier elsewhere or in this bucket."""
    def work(texts: pa.Table, later: pa.Table) -> pa.Table:
        texts = _ordered(texts)
        known = np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in later["blob"].to_pylist()]
                                       or [np.zeros(0, np.uint64)]))
        grams, bounds = [], [0]
        for _, spans in _walk(texts):
            grams.append(S.gram_hashes(spans.hashes(), S.windows(spans, n), n))
            bounds.append(bounds[-1] + len(grams[-1]))
        grams = np.concatenate(grams or [np.zeros(0, np.uint64)])
        order = np.argsort(grams, kind="stable")
        again = np.zeros(len(grams), bool)
        if len(grams):
            sorted_ = grams[order]
            again[order[1:]] = sorted_[1:] == sorted_[:-1]
        again |= S.member(grams, known)
        words_, gone, digest, texts_ = [], [], [], []
        for (_, spans), i, j in zip(_walk(texts), bounds, bounds[1:]):
            drop = S.covered(S.windows(spans, n)[again[i:j]], n, len(spans.start))
            keep = ~drop
            doc = spans.text
            counts = np.bincount(doc[drop], minlength=len(spans.offsets) - 1)
            data = spans.data.copy()
            mask = np.zeros(len(data) + 1, np.int8)
            np.add.at(mask, spans.start[keep], 1)
            np.add.at(mask, spans.end[keep], -1)
            mask = np.cumsum(mask[:-1]).astype(bool)
            kept = np.flatnonzero(keep)
            joined = kept[:-1][doc[kept[1:]] == doc[kept[:-1]]]  # a kept word follows in the same text
            mask[spans.end[joined]] = True
            data[spans.end[joined]] = 32
            place = np.zeros(len(mask) + 1, np.int64)
            np.cumsum(mask, out=place[1:])
            out = data[mask].tobytes()
            cuts = place[spans.offsets]
            words_.append(spans.counts)
            gone.append(counts)
            for i, j in zip(cuts[:-1], cuts[1:]):
                digest.append(hashlib.sha256(out[i:j]).hexdigest())
                if with_text:
                    texts_.append(out[i:j].decode())
        done = {"doc_id": texts["doc_id"], "n_words": pa.array(np.concatenate(words_), pa.int64()),
                "n_removed": pa.array(np.concatenate(gone), pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if with_text:
            done["kept_text"] = pa.array(texts_, pa.string())
        return pa.table(done)

    def send(texts: pa.Table, later: pa.Table) -> pa.Table:
        if len(texts):
            return work(texts, later)
        names = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}
        names |= {"kept_text": pa.string()} if with_text else {}
        return pa.table({k: pa.array([], t) for k, t in names.items()})
    return send


def drop_repeats(docs: DataFrame, n: int = 20, with_text: bool = False) -> DataFrame:
    """Per document: words, words removed because a window of ``n`` words over them also starts earlier,
    digest of the rest and, on request, the rest itself."""
    p = partitions(docs.sparkSession)
    texts = bucketed(docs, 4 * p, "text")
    parts = p
    reply = "bucket int, blob binary"
    message = "bucket int, part int, blob binary"
    hits = texts.groupBy("bucket").applyInArrow(_anchors(n, parts), message).groupBy("part").applyInArrow(_match, reply)
    places = texts.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(_extend(n, parts), message)
    later = places.groupBy("part").applyInArrow(_earliest, reply)
    out = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if with_text else "")
    return texts.groupBy("bucket").cogroup(later.groupBy("bucket")).applyInArrow(_remove(n, with_text), out)


@register("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir):
    return drop_repeats(table(spark, sf_dir, "documents"))
