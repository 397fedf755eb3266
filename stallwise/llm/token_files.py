"""Token-id files with Elias-Fano document boundaries.

Documents are range-partitioned by doc_id and encoded in order. A file set is a folder of blocks. A
block holds the concatenated ids of its documents (two bytes each where all fit, else four), the ends
of the documents and their doc_ids. Both are monotone and stored as Elias-Fano codes: low bits as they
are, high bits in unary with a select directory, so the i-th boundary is found without a table of
64-bit offsets. A block knows its place in its shard; shards are numbered in doc_id order. Spark's own
writer commits the blocks, so a lost task leaves nothing behind.

How it scales. The start of a shard is the sum of the shards before it: one row per shard, however many
documents there are. Each distinct word of a worker is encoded once.

Edge cases. Null and empty texts are the end id alone. Rows without a doc_id come last. Repeated rows
stay. An empty table gives an empty file set.
"""
from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import spans as S
from .common import partitions, register, scratch, table
from .wordcache import WordCache

_SAMPLE = 64
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1).astype(np.int64)  # in each byte
_PLACE = np.argsort(1 - _BITS, axis=1, kind="stable")  # of the k-th one of each byte


class EliasFano:
    """A monotone sequence of non-negative integers in near-minimal space."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.bits, self.low, self.high, self.samples = n, bits, low, high, samples

    @classmethod
    def of(cls, values) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        bits = max(0, int(int(values[-1]) // n).bit_length() - 1)
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = ((values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        high = np.zeros(ones[-1] + 1, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"),
                   ones[::_SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBII", self.n, self.bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> "EliasFano":
        n, bits, low, high = struct.unpack_from("<QBII", blob)
        at = struct.calcsize("<QBII")
        take = lambda i, k, t: np.frombuffer(blob, t, k, i)
        return cls(n, bits, take(at, low, np.uint8), take(at + low, high, np.uint8),
                   take(at + low + high, -(-n // _SAMPLE), "<u4"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for b in range(self.bits):
            at = i * self.bits + b
            out |= ((self.low[at >> 3] >> (at & 7)) & 1).astype(np.uint64) << np.uint64(b)
        return out

    def select(self, i) -> np.ndarray:
        """The i-th values, each from the sampled position before it: bytes are passed by their number of ones."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        at = self.samples[i // _SAMPLE].astype(np.int64)
        byte, need = at >> 3, i % _SAMPLE
        word = self.high[byte] & (np.uint8(255) << (at & 7).astype(np.uint8))
        live = np.flatnonzero(_ONES[word] <= need)
        while len(live):
            need[live] -= _ONES[word[live]]
            byte[live] += 1
            word[live] = self.high[byte[live]]
            live = live[_ONES[word[live]] <= need[live]]
        place = 8 * byte + _PLACE[word, need]
        return (((place - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)).astype(np.int64)

    def values(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        i = np.arange(self.n)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - i
        return ((ones.astype(np.uint64) << np.uint64(self.bits)) | self._low(i)).astype(np.int64)


@lru_cache(maxsize=2)
def _cache(path: str) -> WordCache:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)

    def encode(words):
        ids, counts = [], np.empty(len(words), np.int64)
        for a in range(0, len(words), 4096):
            found = tokenizer.encode_batch_fast([w.decode() for w in words[a: a + 4096]], add_special_tokens=False)
            for i, e in enumerate(found):
                one = e.ids
                counts[a + i] = len(one)
                ids += one
        return np.array(ids, np.int32), counts
    return WordCache(encode)


_BLOCK = ("shard int, start_in_shard bigint, n_docs bigint, n_ids bigint, n_without bigint, first_doc bigint, "
          "docs binary, ends binary, width int, ids binary")


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the file set of a table of (doc_id, text) to a folder all executors share.

    White space never falls inside a token of this tokenizer, so words are encoded apart.
    """
    def work(batches):
        cache, shard, at = _cache(tokenizer), TaskContext.get().partitionId(), 0
        for rows in batches:
            docs_, texts = rows.column("doc_id"), rows.column("text")
            for a, b, data, offsets in S.chunks(texts):
                ids, counts = cache.tokens(S.words(data, offsets))
                ends = np.cumsum(counts + 1)
                whole = np.full(ends[-1], end_id, np.int32)
                inner = np.ones(ends[-1], bool)
                inner[ends - 1] = False
                whole[inner] = ids
                part = docs_.slice(a, b - a)
                known = part.drop_null().to_numpy(zero_copy_only=False)
                first = int(known[0]) if len(known) else 0
                width = 2 if whole.max() < 1 << 16 else 4
                yield pa.RecordBatch.from_pylist([{
                    "shard": shard, "start_in_shard": at, "n_docs": b - a, "n_ids": int(ends[-1]),
                    "n_without": part.null_count, "first_doc": first,
                    "docs": EliasFano.of((known - first).view(np.uint64)).to_bytes(), "ends": EliasFano.of(ends).to_bytes(),
                    "width": width, "ids": whole.astype(f"<u{width}").tobytes()}], schema=_ARROW)
                at += int(ends[-1])
    p = partitions(docs.sparkSession)
    ordered = (docs.select("doc_id", "text").repartitionByRange(p, F.col("doc_id").asc_nulls_last())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text"))
    ordered.mapInArrow(work, _BLOCK).write.option("compression", "zstd").parquet(path)


_ARROW = pa.schema([("shard", pa.int32()), *((n, pa.int64()) for n in (
    "start_in_shard", "n_docs", "n_ids", "n_without", "first_doc")), ("docs", pa.binary()), ("ends", pa.binary()),
    ("width", pa.int32()), ("ids", pa.binary())])


def read_ids(spark, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and on request the ids of every document of a file set."""
    blocks = spark.read.schema(_BLOCK).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def work(batches):
        for rows in batches:
            for r in rows.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
                ends = EliasFano.from_bytes(r["ends"]).select(np.arange(r["n_docs"]))
                starts = np.r_[0, ends[:-1]]
                known = EliasFano.from_bytes(r["docs"]).values() + r["first_doc"]
                raw = memoryview(ids.tobytes())
                out = {"doc_id": pa.array([*known.tolist(), *[None] * r["n_without"]], pa.int64()),
                       "start": pa.array(starts + r["base"] + r["start_in_shard"]),
                       "n_tokens": pa.array(ends - starts),
                       "ids_crc32": pa.array([zlib.crc32(raw[4 * i: 4 * j]) for i, j in zip(starts, ends)], pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)
    return blocks.join(base, "shard").mapInArrow(
        work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else ""))


def fetch_ids(wanted: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids of the documents of a file set whose doc_id is in ``wanted``.

    The doc_ids of the blocks are met with those wanted; a block with hits is read, and ``select`` gives both ends
    of each hit. Nothing else of it is decoded. A doc_id wanted twice counts once; one the files lack gives no row.
    """
    spark = wanted.sparkSession
    blocks = spark.read.schema(_BLOCK).parquet(path)

    def place(batches):
        for rows in batches:
            for r in rows.to_pylist():
                known = EliasFano.from_bytes(r["docs"]).values() + r["first_doc"]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(known), "shard": pa.array(np.full(len(known), r["shard"], np.int32)),
                    "start_in_shard": pa.array(np.full(len(known), r["start_in_shard"])), "i": pa.array(np.arange(len(known)))})
    places = blocks.select("shard", "start_in_shard", "first_doc", "docs").mapInArrow(
        place, "doc_id bigint, shard int, start_in_shard bigint, i bigint")
    hits = places.join(wanted.select("doc_id"), "doc_id", "left_semi")

    def cut(batches):
        for rows in batches:
            column = {c: rows.column(c) for c in ("doc_id", "i", "ends", "width", "ids")}
            for k in range(rows.num_rows):
                i = column["i"][k].as_py()
                ends = EliasFano.from_bytes(column["ends"][k].as_py()).select([max(i - 1, 0), i])
                lo, hi = (int(ends[0]) if i else 0), int(ends[1])
                width = column["width"][k].as_py()
                ids = np.frombuffer(column["ids"][k].as_buffer(), f"<u{width}")[lo:hi].astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": column["doc_id"].slice(k, 1), "n_tokens": pa.array([hi - lo]),
                    "ids": pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), pa.array(ids))})
    payload = blocks.select("shard", "start_in_shard", "ends", "width", "ids")
    return (hits.join(payload, ["shard", "start_in_shard"]).select("doc_id", "i", "ends", "width", "ids")
            .mapInArrow(cut, "doc_id bigint, n_tokens bigint, ids array<int>"))


@register("op7_token_files")
def op7_token_files(spark, sf_dir):
    import public_tokenizers
    path = scratch(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_ids(spark, path)
