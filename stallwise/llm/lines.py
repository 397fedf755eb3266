"""Line deduplication over levelled sorted runs.

Documents come in batches of ascending doc_id. The keys of a batch, one row each with its smallest
document, are merge-anti-joined with the runs of keys that earlier batches left; what is new forms a
run of its own. A run is a table bucketed and sorted by key hash, so neither the join nor a
compaction shuffles it again. ``fanout`` runs of a level are compacted into one of the next. A key is
in one run at most, so compaction is a plain union.

How it scales. Runs hold 24 bytes a key and no text. A key in a third of all documents is one row after
the first aggregation; the later join that finds its lines is a plain sort-merge join, which adaptive
execution splits. Texts are shuffled once, by doc_id, to meet the keys they lose.

Edge cases. Null and empty texts are one empty line. Rows that share a doc_id count as one document; so
do rows without one, which come last. Keys shorter than ``min_chars`` code points are never dropped.
An empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import spans as S
from .common import bucketed, kept, partitions, register, scratch, table

_LAST = np.iinfo(np.int64).max
_KEY = ["h1", "h2"]


def _keyed(data, offsets, min_chars):
    """Lines, their two key hashes and which keys are long enough to be compared."""
    spans = S.lines(data, offsets)
    inner = S.strip(spans)
    compared = S.code_points(data, inner.start, inner.end) >= min_chars
    return spans, inner.hashes(lower=True).view(np.int64), inner.hashes(lower=True, second=True).view(np.int64), compared


def line_keys(docs: DataFrame, cuts: list[int], min_chars: int) -> DataFrame:
    """batch, h1, h2, doc_id: the distinct keys of each document."""
    def work(batches):
        for rows in batches:
            ids = rows.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in S.chunks(rows.column("text")):
                spans, h1, h2, compared = _keyed(data, offsets, min_chars)
                doc = ids[a + spans.text[compared]]
                entry = np.unique(np.stack([doc, h1[compared], h2[compared]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.searchsorted(np.array(cuts, np.int64), entry[:, 0]), pa.int32()),
                     *(pa.array(entry[:, i]) for i in (1, 2, 0))], ["batch", *_KEY, "doc_id"])
    return docs.select("doc_id", "text").mapInArrow(work, "batch int, h1 bigint, h2 bigint, doc_id bigint")


class Runs:
    """Sorted runs by level in the shared folder, known to the session's catalog while in use."""

    def __init__(self, spark, buckets: int, fanout: int):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (keys.repartition(self.buckets, *_KEY).write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY)
         .option("path", scratch(self.spark, "run")).format("parquet").saveAsTable(name))
        return name

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds."""
        for name in self.names():
            keys = keys.join(self.spark.table(name).select(*_KEY).hint("merge"), _KEY, "left_anti")
        return keys

    def add(self, keys: DataFrame, level: int = 0) -> None:
        """A run more; a full level is compacted into the next."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._write(keys.select(*_KEY)))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            whole = self.spark.table(full[0])
            for name in full[1:]:
                whole = whole.unionAll(self.spark.table(name))
            self.add(whole, level + 1)
            self._forget(full)

    def _forget(self, names):
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        self._forget(self.names())


def repeated_keys(keys: DataFrame, batches: int, fanout: int) -> DataFrame:
    """batch, h1, h2, keeper: keys whose lines go in that batch, except in the keeper (null: in all)."""
    spark = keys.sparkSession
    runs = Runs(spark, partitions(spark), fanout)
    found = None
    try:
        for b in range(batches):
            new = kept(keys.where(F.col("batch") == b).groupBy(*_KEY)
                       .agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")), "keys")
            fresh = kept(runs.fresh(new), "fresh") if b else new
            shared = fresh.where("keeper <> last").select(*_KEY, "keeper")
            if b:
                old = new.join(fresh.select(*_KEY).hint("merge"), _KEY, "left_anti")
                shared = shared.unionByName(old.select(*_KEY, F.lit(None).cast("bigint").alias("keeper")))
            part = shared.withColumn("batch", F.lit(b))
            found = part if found is None else found.unionByName(part)
            if b + 1 < batches:
                runs.add(fresh)
        return kept(found, "repeated")
    finally:
        runs.close()


def _cuts(docs: DataFrame, batches: int) -> list[int]:
    found = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.02) if batches > 1 else []
    return sorted({int(x) for x in found})


def _rewrite(carry: list[str], fields, min_chars: int):
    def send(texts: pa.Table, gone: pa.Table) -> pa.Table:
        ids = texts["doc_id"].fill_null(_LAST).to_numpy()
        lost = np.unique(np.stack([gone["doc_id"].to_numpy(), gone["h1"].to_numpy()], axis=1), axis=0)
        lost = S.mix(S.mix(lost[:, 0].view(np.uint64)) ^ lost[:, 1].view(np.uint64)) if len(lost) else np.zeros(0, np.uint64)
        lost.sort()
        n_lines, n_dropped, digest, out = [], [], [], []
        for a, b, data, offsets in S.chunks(texts["text"]):
            spans, h1, _, compared = _keyed(data, offsets, min_chars)
            doc = spans.text
            drop = compared & S.member(S.mix(S.mix(ids[a + doc].view(np.uint64)) ^ h1.view(np.uint64)), lost)
            raw = data.tobytes()
            dropped = np.bincount(doc[drop], minlength=b - a)
            n_lines.append(spans.counts)
            n_dropped.append(dropped)
            for i in range(b - a):
                if dropped[i]:
                    p, q = spans.first[i], spans.first[i + 1]
                    rest = b"\n".join(raw[spans.start[k]: spans.end[k]] for k in range(p, q) if not drop[k])
                else:
                    rest = raw[offsets[i]: offsets[i + 1]]
                digest.append(hashlib.sha256(rest).hexdigest())
                if carry is not None:
                    out.append(rest.decode())
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        done = {"doc_id": texts["doc_id"], "n_lines": pa.array(cat(n_lines), pa.int64()),
                "n_dropped": pa.array(cat(n_dropped), pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if carry is not None:
            done |= {"text": pa.array(out, pa.string())} | {c: texts[c] for c in carry}
        return pa.table(done)
    return send


def drop_lines(docs: DataFrame, batches: int = 6, fanout: int = 3, min_chars: int = 10, carry: list[str] | None = None) -> DataFrame:
    """Per row: lines, lines dropped and the digest of the rest; with ``carry`` also the text that is
    left and the named columns."""
    cuts = _cuts(docs, batches)
    path = scratch(docs.sparkSession, "lines")
    line_keys(docs, cuts, min_chars).write.partitionBy("batch").parquet(path)
    keys = docs.sparkSession.read.schema("h1 bigint, h2 bigint, doc_id bigint, batch int").parquet(path)
    repeated = repeated_keys(keys, len(cuts) + 1, fanout)
    gone = (keys.join(repeated, ["batch", *_KEY]).where(F.col("keeper").isNull() | (F.col("keeper") != F.col("doc_id")))
            .select("doc_id", "h1"))
    n = 8 * partitions(docs.sparkSession)
    missing = F.when(F.col("doc_id") != _LAST, F.col("doc_id"))  # rows without a doc_id meet in one bucket
    gone = gone.select("doc_id", "h1", F.pmod(F.xxhash64(missing), F.lit(n)).cast("int").alias("bucket"))
    texts = bucketed(docs, n, "text", *(carry or []))
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_lines", T.LongType()),
              T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if carry is not None:
        fields += [T.StructField("text", T.StringType()), *(T.StructField(c, docs.schema[c].dataType) for c in carry)]
    return (texts.groupBy("bucket").cogroup(gone.groupBy("bucket"))
            .applyInArrow(_rewrite(carry, None, min_chars), T.StructType(fields)))


SQL = r"""
WITH l AS (SELECT doc_id, u.i, u.line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
           LATERAL (SELECT unnest(a) AS line, generate_subscripts(a, 1) AS i) u),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


@register("op6_line_dedup", SQL)
def op6_line_dedup(spark, sf_dir):
    return drop_lines(table(spark, sf_dir, "documents"))
