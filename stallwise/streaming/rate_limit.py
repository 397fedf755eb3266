"""Admission limits that count accepted rows only, and the plain attempt count."""
from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stallwise import vocab
from stallwise.streaming.runner import each_batch
from stallwise.streaming.versioned import VersionedTable

MICROS = 1_000_000


class Ring:
    """The accepted times of one key: the last ``limit`` of them decide every later attempt."""

    def __init__(self, limit: int, window_us: int, times=()):
        self.times, self.window = deque(times, maxlen=limit), window_us

    def admit(self, t: int) -> bool:
        """Accept unless the ring is full of times within the window; a full ring forgets its oldest."""
        full = len(self.times) == self.times.maxlen
        if self.times.maxlen == 0 or full and self.times[0] > t - self.window:
            return False
        self.times.append(t)
        return True


def _verdicts(key: str, limit: int, window_us: int):
    """Rows (key, __times, id, ts_us) sorted by key, a stored ring first: verdicts, then the ring each key ends with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ring, schema = None, None, None
        for b in batches:
            schema = b.schema
            out: dict[str, list] = {c: [] for c in ("key", "id", "ts", "accepted", "times")}

            def put(*row):
                for column, value in zip(out.values(), row):
                    column.append(value)
            for k, times, id_, t in zip(*(c.to_pylist() for c in b.columns)):
                if ring is None or k != now:
                    if ring is not None:
                        put(now, None, None, None, list(ring.times))
                    now, ring = k, Ring(limit, window_us, times or ())
                if times is None:
                    put(k, id_, t, ring.admit(t), None)
            yield _batch(out, schema, key)
        if ring is not None:
            yield _batch({"key": [now], "id": [None], "ts": [None], "accepted": [None], "times": [list(ring.times)]}, schema, key)
    return run


def _batch(out: dict[str, list], schema: pa.Schema, key: str) -> pa.RecordBatch:
    kinds = [schema.field(0).type, schema.field(2).type, pa.int64(), pa.bool_(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), kinds)], [key, "id", "ts_us", "accepted", "times"])


def rate_limit(stream: DataFrame, root: str, key: str, ts_us: str, id: str, *, limit=vocab.RATE_LIMIT_KEY,
               window_seconds=vocab.RATE_WINDOW_SECONDS, buckets: int = 16) -> DataFrame:
    """Attempts with their verdict: accepted if fewer than ``limit`` of the key were accepted in the window.

    All available input is processed. A verdict depends on every earlier one of its key. A micro-batch is dealt by key and
    sorted by time, and a task reads it in Arrow batches with one ring of at most ``limit`` times in hand: a
    key that holds a third of all rows passes one task in order, at the memory of any other. Stored rings come
    first in their key's rows; changed ones are written, and rings whose last time has left the window of all
    later attempts are removed. Attempts must not come later than ``window_seconds`` after newer ones.
    """
    window_us, spark = int(window_seconds) * MICROS, stream.sparkSession
    rings = VersionedTable(spark, os.path.join(root, "rings"), [key], buckets)
    shaped = stream.select(key, F.lit(None).cast("array<bigint>").alias("__times"), F.col(id).alias("id"), F.col(ts_us).cast("bigint").alias("ts_us"))
    types = dict(shaped.dtypes)
    schema = f"`{key}` {types[key]}, id {types['id']}, ts_us bigint, accepted boolean, times array<bigint>"

    def step(batch: DataFrame, epoch: int) -> None:
        known, rows = rings.read(epoch - 1), batch
        if known is not None:
            mine = known.join(batch.select(key).distinct(), key, "left_semi")
            rows = batch.unionByName(mine.select(key, F.col("times").alias("__times")), allowMissingColumns=True)
        ordered = rows.repartition(key).sortWithinPartitions(key, F.col("__times").isNull(), "ts_us", "id")
        out = os.path.join(root, "verdicts", f"epoch={epoch}")
        ordered.mapInArrow(_verdicts(key, limit, window_us), schema).write.mode("overwrite").parquet(out)
        done = spark.read.schema(schema).parquet(out)
        ends = done.where(F.col("times").isNotNull()).select(key, "times")
        now = done.agg(F.max("ts_us").alias("now")).first()["now"] or 0
        old = lambda df: df.where(F.try_element_at("times", F.lit(-1)) <= now - 2 * window_us)
        rings.apply(epoch, ends, old(known).join(ends, key, "left_anti").select(key) if known is not None else None)
    each_batch(shaped, step, root)
    return spark.read.schema(schema).parquet(os.path.join(root, "verdicts")).where(F.col("accepted").isNotNull()).select(key, "id", "ts_us", "accepted")


def recent_attempts(df: DataFrame, key: str, ts_us: str, window_seconds: int, name="recent") -> DataFrame:
    """Number of earlier attempts of the key within the window before each attempt (batch).

    The timeline of a key is cut into window-long slots and every slot also sees the one before
    it, so that the attempts of a busy key are counted in many tasks.
    """
    span = int(window_seconds) * MICROS
    slot = F.floor(F.col(ts_us) / span)
    copies = df.withColumn("__own", slot).withColumn("__slot", F.explode(F.array(slot, slot + 1)))
    w = Window.partitionBy(key, "__slot").orderBy(ts_us).rangeBetween(-span, -1)
    counted = copies.withColumn(name, F.count(F.lit(1)).over(w))
    return counted.where(F.col("__slot") == F.col("__own")).drop("__own", "__slot")
