"""The collection cycle over a stream of snapshots: merge, enrich, summarise."""
from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise import vocab
from stallwise.operators import joins, snapshots
from stallwise.sources.sinks import stored
from stallwise.streaming.runner import each_batch
from stallwise.streaming.versioned import VersionedTable

COMMIT = "epoch bigint, state_rows bigint, detail_rows bigint"


class CycleTables:
    """The tables of a cycle under one folder, as of the last committed epoch or an earlier one.

    State and details are kept by key and written as changes. A listing that is on the market was seen in the last run of
    its scope, so its ``last_seen`` is not stored but read from the audit; a run that sees it again changes
    nothing. History, audit and summary are written once an epoch. The commit record is written last: what an
    epoch left before it failed is not read, and its repetition writes the same folders again.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = ("profile", "id"), scope: Sequence[str] = ("profile",),
                 buckets: int = 16):
        self.spark, self.root, self.keys, self.scope = spark, root, list(keys), list(scope)
        self.kept = VersionedTable(spark, os.path.join(root, "state"), keys, buckets)
        self.cards = VersionedTable(spark, os.path.join(root, "details"), ["id"], buckets)

    def _folder(self, name: str, epoch: int) -> str:
        return os.path.join(self.root, name, f"epoch={epoch}")

    def save(self, name: str, epoch: int, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self._folder(name, epoch))
        return self.spark.read.schema(df.schema).parquet(self._folder(name, epoch))

    def commits(self) -> DataFrame:
        """Epochs with the rows each wrote to state and details."""
        return self.spark.read.schema(COMMIT).parquet(os.path.join(self.root, "commits"))

    def last_epoch(self) -> int:
        return self.commits().agg(F.max("epoch")).first()[0]

    def upto(self, name: str, epoch: int) -> DataFrame:
        """The rows of history or audit of all epochs to the given one."""
        return self.spark.read.parquet(os.path.join(self.root, name)).where(F.col("epoch") <= epoch).drop("epoch")

    def state(self, epoch: int) -> DataFrame | None:
        kept = self.kept.read(epoch)
        if kept is None:
            return None
        runs = self.upto("audit", epoch).groupBy(*self.scope).agg(F.max("run").alias("__run"))
        return kept.join(runs, self.scope, "left").withColumn("last_seen", F.coalesce("last_seen", "__run")).drop("__run")

    def details(self, epoch: int) -> DataFrame | None:
        return self.cards.read(epoch)

    def summary(self, epoch: int) -> DataFrame:
        return self.spark.read.parquet(self._folder("summary", epoch))


def cycle_step(batch: DataFrame, epoch: int, tables: CycleTables, cards: Callable[[DataFrame], DataFrame], *,
               tol=vocab.PRICE_TOLERANCE, latest: Sequence[str] = (), first: Sequence[str] = ()) -> None:
    """One cycle: replay the new runs on the stored state, fetch cards, write the summary and the commit record.

    ``latest`` and ``first`` name the listing columns that the state carries, as in ``replay``. ``cards`` returns
    the details of given ids. Whole runs must arrive in one batch.
    """
    keys, scope = tables.keys, tables.scope
    log = stored(batch, "cycle-log")
    before = tables.state(epoch - 1)
    result = snapshots.replay(log, keys, scope, tol, before, store=True, latest=latest, first=first)
    tables.save("history", epoch, result.history)
    tables.save("audit", epoch, result.audit)

    new = result.state.withColumn("last_seen", F.when(F.col("gone_at").isNotNull(), F.col("last_seen")))
    kept = tables.kept.read(epoch - 1)
    if kept is not None:
        values = [c for c in new.columns if c not in keys]
        old = kept.select(*keys, F.struct(*values).alias("__old"))
        new = new.join(old, keys, "left").where(~F.struct(*values).eqNullSafe(F.col("__old"))).drop("__old")
    written = tables.kept.apply(epoch, new)

    state, known = tables.kept.read(epoch), tables.details(epoch - 1)
    wanted = joins.missing_details(state, known) if known is not None else state.where(F.col("gone_at").isNull())
    wanted = wanted.select("id")
    if known is not None:
        wanted = wanted.union(joins.changed_since_fetch(state, known).select("id"))
    fetched = tables.cards.apply(epoch, cards(wanted.distinct()))
    started = log.agg(F.min("run").alias("since")).scalar()
    marked = tables.kept.changes(epoch).withColumn("__since", started)
    tables.save("summary", epoch, snapshots.cycle_summary(marked, F.col("__since")))
    line = tables.spark.createDataFrame([(epoch, written, fetched)], COMMIT)
    line.coalesce(1).write.mode("overwrite").parquet(os.path.join(tables.root, "commits", f"cycle={epoch}"))


def run_cycles(stream: DataFrame, root: str, cards: Callable[[DataFrame], DataFrame],
               prepare: Callable[[DataFrame], DataFrame] = lambda df: df, *, keys: Sequence[str] = ("profile", "id"),
               scope: Sequence[str] = ("profile",), **options) -> dict[str, DataFrame]:
    """Run cycles over all available snapshots and return the resulting tables."""
    tables = CycleTables(stream.sparkSession, root, keys, scope)

    def step(batch: DataFrame, epoch: int) -> None:
        cycle_step(prepare(batch), epoch, tables, cards, **options)
    each_batch(stream, step, root)
    return results(tables)


def results(tables: CycleTables) -> dict[str, DataFrame]:
    """All tables of a cycle as of its last commit."""
    last = tables.last_epoch()
    return {"state": tables.state(last), "details": tables.details(last), "summary": tables.summary(last),
            "history": tables.upto("history", last), "audit": tables.upto("audit", last)}
