"""Running a streaming result to completion and reading what it wrote."""
from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.session import work_dir


def file_stream(spark: SparkSession, folder: str, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of the files already there."""
    known = spark.read.parquet(os.path.join(folder, glob) if glob else folder)
    reader = spark.readStream.schema(known.schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], root: str) -> None:
    """Process all available input, one micro-batch after another; a batch that failed is repeated with its epoch."""
    query = (stream.writeStream.foreachBatch(step).option("checkpointLocation", os.path.join(root, "checkpoint"))
             .trigger(availableNow=True).start())
    query.awaitTermination()


def drain(stream: DataFrame, purpose: str, root: str | None = None) -> DataFrame:
    """Process all available input in append mode into a Parquet table and read it."""
    spark = stream.sparkSession
    root = root or work_dir(spark, purpose)
    out = os.path.join(root, "rows")
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", os.path.join(root, "checkpoint")).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, keys: Sequence[str], purpose: str, root: str | None = None) -> DataFrame:
    """Process all available input in update mode; of every key the latest row is returned.

    Every micro-batch overwrites its own folder, so a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    root = root or work_dir(spark, purpose)
    out = os.path.join(root, "rows")

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch}"))
    query = (stream.writeStream.outputMode("update").foreachBatch(save)
             .option("checkpointLocation", os.path.join(root, "checkpoint")).trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.parquet(out)
    values = [c for c in stream.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("v"))
    return latest.select(*keys, "v.*")
