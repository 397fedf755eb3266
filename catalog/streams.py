"""Streaming queries: each drains its whole input and returns the table it wrote."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.changes import FOLD, LISTING_STATE, _audit_sql, full_log
from catalog.registry import query
from stallwise.operators import snapshots
from stallwise.session import work_dir
from stallwise.streaming import cycle, daily, price_changes, rate_limit, runner

MICROS = "epoch_us(ts)"


def events(spark, sf):
    return runner.file_stream(spark, sf, "events.parquet", files_per_trigger=1)


def micros(ts="ts"):
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))


@query("stream_price_changes", f"""WITH RECURSIVE seq AS (SELECT user_id AS id, {MICROS} AS run_us, value AS price, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  fold AS (SELECT id, k, run_us, price AS stored, NULL::double AS was, true AS is_point FROM seq WHERE k = 1
    UNION ALL SELECT s.id, s.k, s.run_us, CASE WHEN abs(s.price - f.stored) > 0.5 THEN s.price ELSE f.stored END,
      CASE WHEN abs(s.price - f.stored) > 0.5 THEN f.stored END, coalesce(abs(s.price - f.stored) > 0.5, false) FROM fold f JOIN seq s ON s.id = f.id AND s.k = f.k + 1)
  SELECT id, run_us, round(stored, 4) AS price, round(was, 4) AS prev_price, CASE WHEN was IS NULL THEN 'new' WHEN stored < was THEN 'down' ELSE 'up' END AS change FROM fold WHERE is_point""")
def _(spark, sf):
    seen = events(spark, sf).select(F.col("user_id").alias("id"), micros().alias("run_us"), "event_id",
                                    F.col("value").alias("price"), F.lit("EUR").alias("currency"))
    points = price_changes.price_changes(seen, work_dir(spark, "price-changes"), tie="event_id")
    return points.select("id", "run_us", "price", "prev_price", "change")


@query("stream_daily_changes", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return runner.drain_updates(daily.daily_changes(events(spark, sf), "1 day"), ["day"], "daily-changes")


@query("stream_snapshot_dedup", "SELECT DISTINCT user_id AS id, strftime(ts, '%Y-%m-%d') AS run FROM events")
def _(spark, sf):
    keyed = events(spark, sf).select(F.col("user_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("run"), "ts")
    return runner.drain(daily.snapshot_dedup(keyed, ["id", "run"], "2 days").select("id", "run"), "dedup")


def cards(spark, sf):
    """Details of wanted ids: one card row per user, dated by the user's first event."""
    def of(ids):
        source = b.table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(
            F.min("ts").cast("date").alias("fetched_at"), F.max("value").alias("top_value"))
        return source.join(ids, "id", "left_semi")
    return of


def cycle_tables(spark, sf, stream=None):
    def prepare(batch):
        log = batch.groupBy(F.col("user_id").alias("id"), F.col("ts").cast("date").alias("run")).agg(
            F.max_by("value", F.struct("ts", "event_id")).alias("price"))
        return log.withColumns({"currency": F.lit("EUR"), "profile": F.lit("market")})
    return cycle.run_cycles(stream if stream is not None else events(spark, sf), work_dir(spark, "cycle"), cards(spark, sf), prepare)


@query("stream_cycle", _audit_sql(FOLD, False))
def _(spark, sf):
    return cycle_tables(spark, sf)["audit"].drop("profile")


def cycles_of_parts(spark, sf, parts=3):
    """The whole log as cycles over ``parts`` stretches of its runs, every listing column carried."""
    log = full_log(spark, sf)
    ends = log.agg(F.percentile("run_no", F.array(*[F.lit(i / parts) for i in range(1, parts)])).alias("p")).first()["p"]
    cuts = [float("-inf"), *(ends or [0.0] * (parts - 1)), float("inf")]
    tables = cycle.CycleTables(spark, work_dir(spark, "cycle"))
    for epoch, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = log.where((F.col("run_no") > low) & (F.col("run_no") <= high)).drop("run_no")
        cycle.cycle_step(part, epoch, tables, cards(spark, sf), latest=snapshots.LATEST, first=snapshots.FIRST)
    return cycle.results(tables)


@query("stream_cycle_state", LISTING_STATE)
def _(spark, sf):
    """Every column of the listing table after several cycles."""
    return cycles_of_parts(spark, sf)["state"]


@query("stream_cycle_details", """SELECT user_id AS id, min(ts::date)::varchar AS fetched_at, round(max(value), 4) AS top_value FROM events GROUP BY 1""")
def _(spark, sf):
    return cycles_of_parts(spark, sf)["details"]


@query("rate_limit", f"""WITH RECURSIVE seq AS (SELECT user_id, event_id, {MICROS} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  st AS (SELECT user_id, k, event_id, true AS ok, [t] AS acc FROM seq WHERE k = 1
    UNION ALL SELECT s.user_id, s.k, s.event_id, len(list_filter(st.acc, lambda x: x > s.t - 86400000000)) < 2,
      CASE WHEN len(list_filter(st.acc, lambda x: x > s.t - 86400000000)) < 2 THEN list_append(list_filter(st.acc, lambda x: x > s.t - 86400000000), s.t) ELSE st.acc END
    FROM st JOIN seq s ON s.user_id = st.user_id AND s.k = st.k + 1)
  SELECT event_id AS id, user_id, ok::bigint AS accepted FROM st""")
def _(spark, sf):
    tries = events(spark, sf).select("event_id", "user_id", micros().alias("ts_us"))
    verdicts = rate_limit.rate_limit(tries, work_dir(spark, "rate-limit"), "user_id", "ts_us", "event_id", limit=2, window_seconds=86400)
    return verdicts.select("id", "user_id", "accepted")


@query("rate_attempts", f"""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY {MICROS} RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS recent FROM events""")
def _(spark, sf):
    tries = b.table(spark, sf, "events").select("event_id", "user_id", micros().alias("ts_us"))
    return rate_limit.recent_attempts(tries, "user_id", "ts_us", 86400).select("event_id", "recent")
