"""Writers for flat and nested exports, and tables that a later step reads again."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from stallwise.session import work_dir


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with a header and a fixed column order, one file per partition, no byte order mark."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).option(
        "escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines; NULL fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_snapshots(df: DataFrame, path: str, by: Sequence[str] = ("profile", "run")) -> None:
    """Snapshot log as Parquet, partitioned so that a profile and run prune to their folders."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result to the shared work folder and read it back.

    For results that several later steps use; unlike a cache it survives the loss of executors.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
