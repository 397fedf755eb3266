"""Settings, tables and small Spark helpers that the operators share."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_OWN: dict[str, str] = {}

#: Between words and around lines: space and the five ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def register(name: str, sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows if there is one."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a local session without it gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="llm-")
        _OWN[spark.sparkContext.applicationId] = root
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(docs: DataFrame, n: int, *columns: str) -> DataFrame:
    """doc_id, the named columns and a bucket of the doc_id; equal plans share one exchange."""
    return docs.select("doc_id", *columns, F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("bucket"))
