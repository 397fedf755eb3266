"""Queries over the snapshot log: changes, state, history, audit and upserts."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.listings import VIEW, sql_columns
from catalog.registry import query
from stallwise.functions.labels import as_ntz
from stallwise.operators import joins, paging, snapshots, stats, upserts
from stallwise.sources.sinks import stored


def snapshot_log(spark, sf, by_type=False):
    """One price per user and day: the last event of the day."""
    keys = (["event_type"] if by_type else []) + ["user_id", F.col("ts").cast("date").alias("run")]
    log = b.table(spark, sf, "events").groupBy(*keys).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("price"))
    log = log.withColumnRenamed("user_id", "id").withColumn("currency", F.lit("EUR"))
    return log.withColumnRenamed("event_type", "profile") if by_type else log


def _snap(by_type=False):
    keys = "event_type AS profile, user_id AS id, ts::date AS run" if by_type else "user_id AS id, ts::date AS run"
    part = "event_type, user_id, ts::date" if by_type else "user_id, ts::date"
    return f"""snap AS (SELECT {keys.replace(' AS ', ' AS ')}, value AS price FROM (
    SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"""


def _fold(by_type=False):
    p = "profile, " if by_type else ""
    sp = "s.profile, " if by_type else ""
    on = "s.profile = f.profile AND " if by_type else ""
    return f"""seq AS (SELECT *, row_number() OVER (PARTITION BY {p}id ORDER BY run) AS k FROM snap),
  fold AS (SELECT {p}id, k, run, price AS stored, price AS seen, NULL::double AS was, true AS is_point FROM seq WHERE k = 1
    UNION ALL SELECT {sp}s.id, s.k, s.run, CASE WHEN abs(s.price - f.stored) > 0.5 THEN s.price ELSE f.stored END, s.price,
      CASE WHEN abs(s.price - f.stored) > 0.5 THEN f.stored END, coalesce(abs(s.price - f.stored) > 0.5, false)
    FROM fold f JOIN seq s ON {on}s.id = f.id AND s.k = f.k + 1)"""


def _presence(by_type=False):
    p = "profile, " if by_type else ""
    over = "PARTITION BY profile " if by_type else ""
    using = "(profile, run)" if by_type else "(run)"
    return f"""runs AS (SELECT *, lag(run) OVER ({over}ORDER BY run) AS prev_run, lead(run) OVER ({over}ORDER BY run) AS next_run
    FROM (SELECT DISTINCT {p}run FROM snap)),
  pres AS (SELECT *, lag(run) OVER (PARTITION BY {p}id ORDER BY run) AS before, lead(run) OVER (PARTITION BY {p}id ORDER BY run) AS after
    FROM snap JOIN runs USING {using})"""


SNAP = b.with_(_snap())
FOLD = b.with_(_snap(), _fold(), _presence(), recursive=True)
FOLD_TYPED = b.with_(_snap(True), _fold(True), _presence(True), recursive=True)


def folded(spark, sf):
    return snapshots.fold_prices(snapshot_log(spark, sf))


def last_pair(spark, sf):
    """State before the last run and the snapshot of the last run."""
    log = snapshot_log(spark, sf)
    last = log.agg(F.max("run").alias("last")).scalar()
    marked = log.withColumn("last", last)
    before, now = marked.where(F.col("run") < F.col("last")), marked.where(F.col("run") == F.col("last"))
    state = snapshots.replay(before.drop("last")).state
    return state, now.drop("last")


@query("snapshot_dedup", """SELECT l_orderkey, l_linenumber::bigint AS l_linenumber, l_partkey, round(l_extendedprice, 4) AS l_extendedprice
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def _(spark, sf):
    lines = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    first = snapshots.snapshot_dedup(lines, "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice"])
    return first.drop("l_shipdate")


# state before the last run, as the fold over all earlier runs
_PAIR = FOLD.rstrip("\n") + """,
  lastrun AS (SELECT max(run) AS last FROM snap),
  known AS (SELECT id, arg_max(stored, k) AS was, max(run) AS last_seen FROM fold, lastrun WHERE run < last GROUP BY id),
  prevrun AS (SELECT max(run) AS prev FROM snap, lastrun WHERE run < last),
  d AS (SELECT coalesce(k.id, s.id) AS id, was, s.price AS now, k.id IS NOT NULL AS known, s.id IS NOT NULL AS seen,
      k.last_seen < prev AS was_gone
    FROM known k FULL JOIN (SELECT snap.* FROM snap, lastrun WHERE run = last) s ON s.id = k.id, prevrun),
  c AS (SELECT *, CASE WHEN NOT known THEN 'new' WHEN NOT seen THEN CASE WHEN was_gone THEN 'absent' ELSE 'gone' END
      WHEN abs(now - was) > 0.5 THEN CASE WHEN now < was THEN 'down' ELSE 'up' END ELSE 'unchanged' END AS status FROM d)
"""


def _events(spark, sf):
    log = snapshot_log(spark, sf, True)
    return snapshots.presence_events(log, ["profile", "id"], snapshots.run_calendar(log, ["profile"]), ["profile"])


PRESENCE = b.with_(_snap(True), _presence(True))


@query("snapshot_new", PRESENCE + "SELECT profile, id, run::varchar AS run FROM pres WHERE before IS NULL")
def _(spark, sf):
    return _events(spark, sf).where(F.col("added")).select("profile", "id", "run")


@query("snapshot_gone", PRESENCE + """SELECT profile, id, next_run::varchar AS run FROM pres
  WHERE next_run IS NOT NULL AND (after IS NULL OR after <> next_run)""")
def _(spark, sf):
    return (_events(spark, sf).where(F.col("gone_run").isNotNull())
            .select("profile", "id", F.col("gone_run").alias("run")))


@query("snapshot_reappear", PRESENCE + "SELECT profile, id, run::varchar AS run FROM pres WHERE before IS NOT NULL AND before <> prev_run")
def _(spark, sf):
    return _events(spark, sf).where(F.col("back")).select("profile", "id", "run")


@query("change_class", _PAIR + "SELECT id, round(was, 4) AS was, round(now, 4) AS now, status FROM c")
def _(spark, sf):
    return snapshots.diff(*last_pair(spark, sf)).select("id", "was", "now", "status")


@query("change_report", _PAIR + """SELECT *, round(now - was, 4) AS delta, round(CASE WHEN was <> 0 THEN (now - was) / was * 100 END, 4) AS delta_pct FROM (
    (SELECT 'new' AS part, id, was, now FROM c WHERE status = 'new' ORDER BY id::varchar LIMIT 10)
    UNION ALL (SELECT 'down', id, was, now FROM c WHERE status = 'down' ORDER BY now - was, id::varchar LIMIT 10))""")
def _(spark, sf):
    return snapshots.change_report(snapshots.diff(*last_pair(spark, sf)))


@query("price_change_fold", FOLD + """SELECT id, round(arg_max(stored, k), 4) AS price, round(arg_max(was, k) FILTER (was IS NOT NULL), 4) AS prev_price,
    max(run) FILTER (was IS NOT NULL)::varchar AS price_changed_at, round(arg_min(seen, k), 4) AS first_price, count(was) AS changes
  FROM fold GROUP BY id""")
def _(spark, sf):
    state, history, _ = snapshots.replay(snapshot_log(spark, sf), store=True)
    changes = history.groupBy("id").agg(F.count("prev_price").alias("changes"))
    return state.join(changes, "id").select("id", "price", "prev_price", "price_changed_at", "first_price", "changes")


@query("price_history", FOLD + "SELECT id, run::varchar AS run, round(stored, 4) AS price, round(was, 4) AS prev_price FROM fold WHERE is_point")
def _(spark, sf):
    return snapshots.price_history(folded(spark, sf)).select("id", "run", "price", "prev_price")


@query("price_series", FOLD + """SELECT id, string_agg(run || '=' || printf('%.2f', stored), ',' ORDER BY run) AS series, count(*) AS points
  FROM fold WHERE is_point GROUP BY id HAVING count(*) > 1""")
def _(spark, sf):
    s = snapshots.price_series(snapshots.price_history(folded(spark, sf)))
    text = F.transform("series", lambda p: F.format_string("%s=%.2f", p["ts"].cast("string"), p["price"]))
    return s.select("id", F.array_join(text, ",").alias("series"), F.size("series").alias("points"))


@query("history_count", b.with_(b.SQL_ADS, _snap(), _fold(), recursive=True) + """SELECT ads.id, coalesce(n, 0) AS hist_points FROM ads
  LEFT JOIN (SELECT id, count(*) AS n FROM fold WHERE is_point GROUP BY id) h ON h.id = ads.id""")
def _(spark, sf):
    counts = joins.history_counts(snapshots.price_history(folded(spark, sf)))
    return (b.ads(spark, sf).join(counts, "id", "left")
            .select("id", F.coalesce("hist_points", F.lit(0).cast("bigint")).alias("hist_points")))


@query("listing_projection", b.with_(b.SQL_ADS, b.SQL_DET, b.SQL_FLAGS, b.SQL_LISTINGS, _snap(), _fold(), recursive=True)
       + f"SELECT {sql_columns(['l.' + c if c == 'id' else c for c in VIEW])}, coalesce(h.hn, 0) AS hist_points FROM listings l LEFT JOIN (SELECT id AS hid, count(*) AS hn FROM fold WHERE is_point GROUP BY id) h ON h.hid = l.id".replace(", 4)", ", 8)"),
       digits=8)
def _(spark, sf):
    history = snapshots.price_history(folded(spark, sf))
    view = joins.listing_view(b.ads(spark, sf), b.details(spark, sf), b.flags(spark, sf), history)
    return view.select(*VIEW, "hist_points")


@query("changes_by_day", FOLD + "SELECT strftime(run, '%Y-%m-%d') AS day, count(*) AS n FROM fold WHERE is_point GROUP BY 1 ORDER BY 1 DESC LIMIT 60")
def _(spark, sf):
    return stats.changes_by_day(snapshots.price_history(folded(spark, sf)), ts="run")


@query("changes_by_day_of_profile", b.with_(b.SQL_ADS, _snap(), _fold(), recursive=True) + """SELECT profile, day, n FROM (
    SELECT *, row_number() OVER (PARTITION BY profile ORDER BY day DESC) AS place FROM (
      SELECT profile, strftime(run, '%Y-%m-%d') AS day, count(*) AS n FROM fold JOIN ads USING (id) WHERE is_point GROUP BY ALL)) WHERE place <= 60""")
def _(spark, sf):
    return stats.changes_by_day_of_profile(snapshots.price_history(folded(spark, sf)), b.ads(spark, sf), ts="run")


LISTING_STATE = b.with_(_snap(), _fold(), recursive=True) + """,
  full_log AS (SELECT user_id AS id, ts::date AS run, event_type, event_id, props, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, ts::date ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1),
  runs AS (SELECT run AS last_seen, lead(run) OVER (ORDER BY run) AS gone_at FROM (SELECT DISTINCT run FROM snap)),
  ends AS (SELECT id, min(run) AS first_seen, max(run) AS last_seen FROM snap GROUP BY id),
  prices AS (SELECT id, round(arg_max(stored, k), 4) AS price, round(arg_max(was, k) FILTER (was IS NOT NULL), 4) AS prev_price,
    max(run) FILTER (was IS NOT NULL) AS price_changed_at, round(arg_min(seen, k), 4) AS first_price FROM fold GROUP BY id)
  SELECT ends.id, 'market' AS profile, f.event_id AS subcategory_id, f.event_type AS subcategory, l.props AS title, price, 'EUR' AS currency,
    round(l.value * 2, 4) AS old_price, CASE WHEN l.event_id % 2 = 0 THEN 'EUR' ELSE '' END AS old_currency, l.event_type AS street,
    round(l.event_id / 1000.0, 4) AS lat, CASE WHEN l.event_id % 3 > 0 THEN round(l.event_id / 500.0, 4) END AS lon, first_seen::varchar AS first_seen,
    last_seen::varchar AS last_seen, gone_at::varchar AS gone_at, first_price, prev_price, price_changed_at::varchar AS price_changed_at
  FROM ends JOIN runs USING (last_seen) JOIN prices USING (id) JOIN full_log f ON f.id = ends.id AND f.run = first_seen
    JOIN full_log l ON l.id = ends.id AND l.run = last_seen"""


@query("snapshot_state", LISTING_STATE)
def _(spark, sf):
    """Every column of the listing table from snapshots, replayed in two pieces."""
    log = full_log(spark, sf)
    middle = log.agg(F.percentile("run_no", F.lit(0.5)).alias("m")).scalar()
    marked = log.withColumn("late", F.col("run_no") > middle).drop("run_no")
    options = {"keys": ["profile", "id"], "scope": ["profile"], "latest": snapshots.LATEST, "first": snapshots.FIRST}
    early = stored(snapshots.replay(marked.where("not late").drop("late"), **options).state, "early-state")
    return snapshots.replay(marked.where("late").drop("late"), state=early, **options).state


def full_log(spark, sf):
    """Snapshot rows with every listing column: one per user and day, from the last event of the day."""
    last = b.table(spark, sf, "events").groupBy(F.col("user_id").alias("id"), F.col("ts").cast("date").alias("run")).agg(
        F.max_by(F.struct("event_id", "event_type", "props", "value"), F.struct("ts", "event_id")).alias("e"))
    number = F.col("e.event_id")
    return last.select(
        F.lit("market").alias("profile"), "id", "run", F.datediff("run", F.lit("1970-01-01")).alias("run_no"), number.alias("subcategory_id"),
        F.col("e.event_type").alias("subcategory"), F.col("e.props").alias("title"), F.col("e.value").alias("price"), F.lit("EUR").alias("currency"),
        (F.col("e.value") * 2).alias("old_price"), F.when(number % 2 == 0, "EUR").otherwise("").alias("old_currency"),
        F.col("e.event_type").alias("street"), (number / 1000).alias("lat"), F.when(number % 3 > 0, number / 500).alias("lon"))


@query("lifecycle_state", b.with_(_snap(), _presence()) + """SELECT id, min(run)::varchar AS first_seen, max(run)::varchar AS last_seen,
    arg_max(next_run, run)::varchar AS gone_at FROM (SELECT *, coalesce(next_run, NULL) AS nr FROM pres) GROUP BY id
    HAVING max(run) < (SELECT max(run) FROM snap)
  UNION ALL SELECT id, min(run)::varchar, max(run)::varchar, NULL FROM pres GROUP BY id HAVING max(run) = (SELECT max(run) FROM snap)""")
def _(spark, sf):
    return snapshots.lifecycle(snapshot_log(spark, sf)).select("id", "first_seen", "last_seen", "gone_at")


def _audit_sql(prelude, by_type):
    p = "profile, " if by_type else ""
    using = "(profile, run)" if by_type else "(run)"
    return prelude + f"""SELECT {p}run::varchar AS run, fetched, added, back, coalesce(gone, 0) AS gone, coalesce(price_down, 0) AS price_down, coalesce(price_up, 0) AS price_up
  FROM (SELECT {p}run, count(*) AS fetched, count(*) FILTER (before IS NULL) AS added,
      count(*) FILTER (before IS NOT NULL AND before <> prev_run) AS back FROM pres GROUP BY ALL)
  LEFT JOIN (SELECT {p}next_run AS run, count(*) AS gone FROM pres WHERE next_run IS NOT NULL AND (after IS NULL OR after <> next_run) GROUP BY ALL) USING {using}
  LEFT JOIN (SELECT {p}run, count(*) FILTER (stored < was) AS price_down, count(*) FILTER (stored >= was) AS price_up FROM fold WHERE was IS NOT NULL GROUP BY ALL) USING {using}"""


@query("run_audit", _audit_sql(FOLD, False))
def _(spark, sf):
    return snapshots.replay(snapshot_log(spark, sf)).audit


@query("run_audit_by_profile", _audit_sql(FOLD_TYPED, True))
def _(spark, sf):
    return snapshots.replay(snapshot_log(spark, sf, True), ["profile", "id"], ["profile"]).audit


@query("cycle_runs", "SELECT profile, run, fetched AS total, added, gone, price_down, price_up FROM (" + _audit_sql(FOLD_TYPED, True) + ") WHERE run >= '2024-01-15'")
def _(spark, sf):
    audit = snapshots.replay(snapshot_log(spark, sf, True), ["profile", "id"], ["profile"]).audit
    return snapshots.cycle_runs(audit, F.lit("2024-01-15").cast("date"))


@query("latest_runs", "SELECT * FROM (" + _audit_sql(FOLD_TYPED, True) + ") ORDER BY run DESC, profile DESC LIMIT 12")
def _(spark, sf):
    audit = snapshots.replay(snapshot_log(spark, sf, True), ["profile", "id"], ["profile"]).audit
    return paging.latest_runs(audit)


@query("cycle_summary", b.W_ADS + """SELECT *, round(price - prev_price, 4) AS delta, round((price - prev_price) / prev_price * 100, 4) AS delta_pct FROM (
    SELECT 'new' AS part, profile, place, id, price, NULL::double AS prev_price FROM (
      SELECT *, row_number() OVER (PARTITION BY profile ORDER BY price NULLS FIRST, id::varchar) AS place FROM ads WHERE first_seen >= TIMESTAMP '1999-01-01') WHERE place <= 5
    UNION ALL (SELECT 'down', profile, NULL, id, price, round(prev_price, 4) FROM ads WHERE price_changed_at >= TIMESTAMP '1999-01-01' AND prev_price > price
      ORDER BY price - prev_price, id::varchar LIMIT 5))""")
def _(spark, sf):
    return snapshots.cycle_summary(b.ads(spark, sf), as_ntz("1999-01-01 00:00:00"))


# ---- upserts -----------------------------------------------------------------------------

_SPLIT = b.with_(_snap()).rstrip("\n") + """,
  lastrun AS (SELECT max(run) AS last FROM snap),
  base AS (SELECT id, arg_max(run, run) AS run, arg_max(price, run) AS price FROM snap, lastrun WHERE run < last GROUP BY id),
  delta AS (SELECT snap.* FROM snap, lastrun WHERE run = last)
"""


def _base_delta(spark, sf):
    log = snapshot_log(spark, sf).drop("currency")
    marked = log.withColumn("last", log.agg(F.max("run").alias("last")).scalar())
    base = (marked.where(F.col("run") < F.col("last")).groupBy("id")
            .agg(F.max_by("price", "run").alias("price"), F.max("run").alias("run")))
    return base, marked.where(F.col("run") == F.col("last")).drop("last")


@query("keyed_upsert", _SPLIT + """SELECT id, run::varchar AS run, round(price, 4) AS price FROM base WHERE id NOT IN (SELECT id FROM delta)
  UNION ALL SELECT id, run::varchar, round(price, 4) FROM delta""")
def _(spark, sf):
    base, delta = _base_delta(spark, sf)
    return upserts.keyed_upsert(base, delta, ["id"])


@query("partial_upsert", _SPLIT + """SELECT coalesce(b.id, d.id) AS id, coalesce(CASE WHEN d.price > 10 THEN 1 END, b.favorite, 0)::bigint AS favorite,
    coalesce(b.hidden, 0)::bigint AS hidden, coalesce(CASE WHEN d.price < 5 THEN 'cheap' END, b.note, '') AS note
  FROM (SELECT id, CASE WHEN price > 20 THEN 1 ELSE 0 END AS favorite, CASE WHEN price < 1 THEN 1 ELSE 0 END AS hidden, 'old' AS note FROM base) b
  FULL JOIN delta d ON d.id = b.id""")
def _(spark, sf):
    base, delta = _base_delta(spark, sf)
    flags = base.select("id", (F.col("price") > 20).cast("int").alias("favorite"),
                        (F.col("price") < 1).cast("int").alias("hidden"), F.lit("old").alias("note"))
    patch = delta.select("id", F.when(F.col("price") > 10, 1).alias("favorite"), F.when(F.col("price") < 5, "cheap").alias("note"))
    return upserts.partial_upsert(flags, patch, ["id"], {"favorite": 0, "hidden": 0, "note": ""})


@query("replace_children", """WITH base AS (SELECT l_partkey AS building, l_orderkey AS unit, l_linenumber::bigint AS floor FROM lineitem WHERE l_linestatus = 'F'),
  delta AS (SELECT l_partkey AS building, l_orderkey AS unit, l_linenumber::bigint AS floor FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'R')
  SELECT * FROM base WHERE building NOT IN (SELECT building FROM delta) UNION ALL SELECT * FROM delta""")
def _(spark, sf):
    lines = b.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("building"), F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("floor"),
        "l_linestatus", "l_returnflag")
    base = lines.where(F.col("l_linestatus") == "F").select("building", "unit", "floor")
    delta = lines.where((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")).select("building", "unit", "floor")
    return upserts.replace_children(base, delta, ["building"])
