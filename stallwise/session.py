"""Session construction and the shared work folder."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "stallwise", **conf) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC.

    Partition counts are left to the cluster (or to ``conf``): adaptive execution coalesces
    from ``spark.sql.shuffle.partitions`` down, so large clusters set that high.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        b = b.config(key, value)
    return b.getOrCreate()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for one job under the cluster's shared ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        root = tempfile.mkdtemp(prefix="stallwise-")
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
