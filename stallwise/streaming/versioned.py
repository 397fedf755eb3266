"""Keyed tables that a stream keeps up to date by writing only what changes."""
from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

PIECES = "bucket int, epoch bigint, kind string, rows bigint, schema string"


class VersionedTable:
    """Rows by key as of every epoch.

    Keys are dealt to ``buckets`` by hash. An epoch writes the rows it changes, by bucket, and a record of the
    pieces that make up each bucket: a whole one and the changes since. A bucket whose changes outgrow ``fold`` times its
    whole piece is written anew, so over time an epoch costs its changes times a constant, and a read at most
    1 + ``fold`` times the table. Nothing that an earlier epoch names is touched: a repeated epoch reads the record
    of the one before and writes the same again, and readers of earlier epochs are not disturbed. Pieces that no kept record
    names may be deleted.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = 16, fold: float = 0.5):
        self.spark, self.root, self.keys, self.buckets, self.fold = spark, root, list(keys), buckets, fold

    def _path(self, kind: str, epoch: int) -> str:
        return os.path.join(self.root, kind, f"epoch={epoch}")

    def pieces(self, epoch: int) -> list:
        """The record of an epoch: at most a few pieces a bucket, and a row with the schema."""
        return [] if epoch < 0 else self.spark.read.schema(PIECES).parquet(self._path("commits", epoch)).collect()

    def _rows(self, pieces: Sequence, schema: T.StructType) -> DataFrame:
        """The rows that the pieces hold, each key's latest; removed ones marked."""
        stored = T.StructType([*schema.fields, T.StructField("__removed", T.BooleanType()), T.StructField("bucket", T.IntegerType())])
        folders: dict[tuple, list[int]] = {}
        for p in pieces:
            folders.setdefault((p.epoch, p.kind), []).append(p.bucket)
        found = None
        for (epoch, kind), own in sorted(folders.items()):
            part = self.spark.read.schema(stored).parquet(self._path(kind, epoch)).where(F.col("bucket").isin(own)).withColumn("__epoch", F.lit(epoch))
            found = part if found is None else found.unionByName(part)
        if len(pieces) > len({p.bucket for p in pieces}):
            rest = [c for c in stored.names if c not in (*self.keys, "bucket")]
            latest = found.groupBy("bucket", *self.keys).agg(F.max_by(F.struct(*rest), "__epoch").alias("__r"))
            found = latest.select(*self.keys, "bucket", "__r.*")
        return found.select(*schema.names, "__removed", "bucket")

    def read(self, epoch: int) -> DataFrame | None:
        """The table as of an epoch; None before the first."""
        record = self.pieces(epoch)
        if not record:
            return None
        schema = T.StructType.fromJson(json.loads(next(p.schema for p in record if p.bucket < 0)))
        pieces = [p for p in record if p.bucket >= 0]
        if not pieces:
            return self.spark.createDataFrame([], schema)
        return self._rows(pieces, schema).where(~F.col("__removed")).drop("__removed", "bucket")

    def changes(self, epoch: int) -> DataFrame:
        """The rows that an epoch wrote because they changed."""
        record = self.pieces(epoch)
        schema = T.StructType.fromJson(json.loads(next(p.schema for p in record if p.bucket < 0)))
        stored = T.StructType([*schema.fields, T.StructField("__removed", T.BooleanType())])
        return self.spark.read.schema(stored).parquet(self._path("changes", epoch)).where(~F.col("__removed")).select(*schema.names)

    def apply(self, epoch: int, changed: DataFrame, removed: DataFrame | None = None) -> int:
        """Write the rows an epoch changes and those it removes (one row a key); returns how many rows were written."""
        schema = changed.schema
        rows = changed.withColumn("__removed", F.lit(False))
        if removed is not None:
            rows = rows.unionByName(removed.select(*self.keys).withColumn("__removed", F.lit(True)), allowMissingColumns=True)
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path("changes", epoch))
        stored = T.StructType([T.StructField("__removed", T.BooleanType()), T.StructField("bucket", T.IntegerType())])
        counts = self.spark.read.schema(stored).parquet(self._path("changes", epoch)).groupBy("bucket").count().collect()
        new = {r["bucket"]: T.Row(bucket=r["bucket"], epoch=epoch, kind="changes", rows=r["count"], schema=None) for r in counts}
        record: dict[int, list] = {}
        for p in self.pieces(epoch - 1):
            if p.bucket >= 0:
                record.setdefault(p.bucket, []).append(p)
        for b, p in new.items():
            record.setdefault(b, []).append(p)
        written = sum(p.rows for p in new.values())
        grown = {b for b, ps in record.items() if b in new and len(ps) > 1 and sum(p.rows for p in ps[1:]) > self.fold * ps[0].rows}
        if grown:
            whole = self._rows([p for b in sorted(grown) for p in record[b]], schema).where(~F.col("__removed"))
            whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path("whole", epoch))
            sizes = {r["bucket"]: r["count"] for r in self.spark.read.schema(stored).parquet(self._path("whole", epoch)).groupBy("bucket").count().collect()}
            for b in grown:
                record[b] = [T.Row(bucket=b, epoch=epoch, kind="whole", rows=sizes[b], schema=None)] if b in sizes else []
            written += sum(sizes.values())
        lines = [(-1, epoch, "schema", 0, schema.json())] + [(p.bucket, p.epoch, p.kind, p.rows, None) for ps in record.values() for p in ps]
        self.spark.createDataFrame(lines, PIECES).coalesce(1).write.mode("overwrite").parquet(self._path("commits", epoch))
        return written
