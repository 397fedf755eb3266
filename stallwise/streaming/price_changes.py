"""Price changes of a stream of observations, folded batch by batch onto stored prices."""
from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stallwise import vocab
from stallwise.operators import snapshots
from stallwise.streaming.runner import each_batch
from stallwise.streaming.versioned import VersionedTable


def price_changes(stream: DataFrame, root: str, keys: Sequence[str] = ("id",), run="run_us", tie: str | None = None,
                  tol=vocab.PRICE_TOLERANCE, buckets: int = 16) -> DataFrame:
    """First price and every change of every listing: keys, run_us, price, currency, prev_price, change.

    All available input is processed. A micro-batch is folded by windows over its rows and the stored prices of its
    listings, which sort and spill; no listing's rows are held in a Python frame. The state is one row a
    listing, and a batch writes only the prices it moves. Points of an epoch go to a folder of their own, so a
    repeated batch changes nothing.
    """
    keys, spark = list(keys), stream.sparkSession
    prices = VersionedTable(spark, os.path.join(root, "prices"), keys, buckets)
    order = F.struct(F.col(run).alias("at"), F.col(tie or run).alias("tie"))
    shaped = stream.select(*keys, order.alias("run"), F.col("price").cast("double").alias("price"), "currency")

    def step(batch: DataFrame, epoch: int) -> None:
        known = prices.read(epoch - 1)
        if known is not None:
            known = known.join(batch.select(*keys).distinct(), keys, "left_semi")
        points = snapshots.price_history(snapshots.fold_prices(batch, keys, tol, known), keys)
        change = F.when(F.col("prev_price").isNull(), "new").otherwise(snapshots.change_class(F.col("price"), F.col("prev_price")))
        out = os.path.join(root, "points", f"epoch={epoch}")
        points.withColumn("change", change).write.mode("overwrite").parquet(out)
        last = spark.read.parquet(out).groupBy(*keys).agg(F.max_by(F.struct("price", "currency"), "run").alias("p"))
        prices.apply(epoch, last.select(*keys, "p.price", "p.currency"))
    each_batch(shaped, step, root)
    points = spark.read.parquet(os.path.join(root, "points"))
    return points.select(*keys, F.col("run.at").alias("run_us"), "price", "currency", "prev_price", "change")
