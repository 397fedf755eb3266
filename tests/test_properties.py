"""Identities of the change tracking, and streams against their batch twins for split inputs."""
import os

import pytest
from pyspark.sql import functions as F

from catalog import changes, streams
from stallwise.operators import snapshots
from stallwise.session import work_dir
from stallwise.streaming import daily, price_changes, runner

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def log(spark):
    return changes.snapshot_log(spark, SF).cache()


def test_audit_balances(spark, log):
    state, history, audit = snapshots.replay(log)
    active = 0
    for r in audit.orderBy("run").collect():
        active += r.added + r.back - r.gone
        assert active == r.fetched
    assert active == state.where("gone_at is null").count()
    moves = audit.agg(F.sum("price_down") + F.sum("price_up")).first()[0]
    assert history.count() == state.count() + moves


def test_replay_in_pieces(spark, log):
    whole = snapshots.replay(log)
    runs = [r.run for r in log.select("run").distinct().orderBy("run").collect()]
    cuts = [runs[:7], runs[7:8], runs[8:20], runs[20:]]
    state, pieces, audits = None, None, None
    for part in cuts:
        got = snapshots.replay(log.where(F.col("run").isin(part)), state=state, store=True)
        state = spark.createDataFrame(got.state.collect(), got.state.schema)
        pieces = got.history if pieces is None else pieces.unionByName(got.history)
        audits = got.audit if audits is None else audits.unionByName(got.audit)
    columns = ["id", "price", "currency", "first_price", "prev_price", "price_changed_at", "first_seen", "last_seen", "gone_at"]
    assert rows(state, *columns) == rows(whole.state, *columns)
    assert rows(pieces, "id", "run", "price", "prev_price") == rows(whole.history, "id", "run", "price", "prev_price")
    names = ["run", "fetched", "added", "back", "gone", "price_down", "price_up"]
    assert rows(audits, *names) == rows(whole.audit, *names)


@pytest.fixture(scope="module")
def split_events(spark, tmp_path_factory):
    """The events in one file per few days, so that a stream sees many micro-batches."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    days = [r.d for r in events.select(F.col("ts").cast("date").alias("d")).distinct().orderBy("d").collect()]
    for i in range(0, len(days), 6):
        part = events.where(F.col("ts").cast("date").isin(days[i:i + 6])).coalesce(1)
        part.write.parquet(os.path.join(folder, f"part{i:02d}"))
        [name] = [f for f in os.listdir(os.path.join(folder, f"part{i:02d}")) if f.endswith(".parquet")]
        target = os.path.join(folder, f"{i:02d}.parquet")
        os.link(os.path.join(folder, f"part{i:02d}", name), target)
        stamp = 1_700_000_000 + i
        os.utime(target, (stamp, stamp))
    return folder


def stream(spark, folder):
    return runner.file_stream(spark, folder, "*.parquet", files_per_trigger=1)


def test_price_changes_do_not_depend_on_the_split(spark, split_events):
    def run(df):
        seen = df.select(F.col("user_id").alias("id"), streams.micros().alias("run_us"), "event_id",
                         F.col("value").alias("price"), F.lit("EUR").alias("currency"))
        return price_changes.price_changes(seen, work_dir(spark, "t1"), tie="event_id")
    one = run(streams.events(spark, SF))
    many = run(stream(spark, split_events))
    names = ["id", "run_us", "price", "prev_price", "change"]
    assert rows(one, *names) == rows(many, *names)


def test_daily_changes_equal_the_batch_count(spark, split_events):
    got = runner.drain_updates(daily.daily_changes(stream(spark, split_events), "1 day"), ["day"], "t2")
    want = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    assert rows(got, "day", "n") == rows(want, "day", "n")


def test_cycle_equals_the_batch_replay(spark, split_events, log):
    tables = streams.cycle_tables(spark, SF, stream(spark, split_events))
    whole = snapshots.replay(log)
    names = ["run", "fetched", "added", "back", "gone", "price_down", "price_up"]
    assert rows(tables["audit"], *names) == rows(whole.audit, *names)
    assert rows(tables["history"], "id", "run", "price") == rows(whole.history, "id", "run", "price")
    assert rows(tables["state"], "id", "price", "gone_at", "prev_price") == rows(whole.state, "id", "price", "gone_at", "prev_price")
    assert tables["details"].count() <= whole.state.count() and tables["summary"].count() > 0
