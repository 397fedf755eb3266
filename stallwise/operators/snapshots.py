"""From full snapshots to state, price history and run audit.

A snapshot log has one row per listing and run. That uniqueness bounds every per-listing
collection below by the number of runs, whatever the number of listings.
"""
from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from stallwise import vocab
from stallwise.operators.skew import first_per_key
from stallwise.sources.sinks import stored


LATEST = ("title", "old_price", "old_currency", "street", "lat", "lon")
FIRST = ("subcategory_id", "subcategory")


class Replay(NamedTuple):
    state: DataFrame
    history: DataFrame
    audit: DataFrame


def snapshot_dedup(pages: DataFrame, id: str, position: Sequence) -> DataFrame:
    """First occurrence of every id in page order; empty ids are dropped."""
    present = F.col(id).isNotNull() & (F.col(id).cast("string") != "")
    return first_per_key(pages.where(present), [id], list(position))


def price_changed(price: Column, currency: Column, old_price: Column, old_currency: Column,
                  tol=vocab.PRICE_TOLERANCE) -> Column:
    """A known price that moved by more than the tolerance or changed its currency."""
    moved = F.abs(price - old_price) > F.lit(float(tol))
    other = F.coalesce(currency, F.lit("")) != F.coalesce(old_currency, F.lit(""))
    return price.isNotNull() & old_price.isNotNull() & (moved | other)


def change_class(price: Column, old_price: Column) -> Column:
    """Cheaper is down; anything else that counts as a change is up."""
    return F.when(price < old_price, "down").otherwise("up")


def diff(known: DataFrame, snapshot: DataFrame, keys: Sequence[str] = ("id",),
         tol=vocab.PRICE_TOLERANCE) -> DataFrame:
    """Compare one snapshot with the known state: new, gone, back and price changes.

    ``known`` carries price, currency and gone_at. One full outer join covers all cases.
    """
    old = known.select(*keys, F.col("price").alias("was"), F.col("currency").alias("was_currency"), "gone_at",
                       F.lit(True).alias("__known"))
    new = snapshot.select(*keys, F.col("price").alias("now"), "currency", F.lit(True).alias("__seen"))
    both = old.join(new, list(keys), "full")
    changed = price_changed(F.col("now"), F.col("currency"), F.col("was"), F.col("was_currency"), tol)
    status = (F.when(F.col("__known").isNull(), "new")
              .when(F.col("__seen").isNull(), F.when(F.col("gone_at").isNull(), "gone").otherwise("absent"))
              .when(changed, change_class(F.col("now"), F.col("was"))).otherwise("unchanged"))
    back = F.col("__known").isNotNull() & F.col("__seen").isNotNull() & F.col("gone_at").isNotNull()
    return both.withColumns({"status": status, "back": back}).drop("__known", "__seen")


_CHUNK = 64


def _fold(drift: Column, start: Column, tol: float, run: str) -> Column:
    """The changes among prices that drift by small steps, from a stored price on.

    The array is folded in chunks, each with a short list of its own, so that appending does not copy all
    earlier changes.
    """
    kind = f"array<struct<run:{run},price:double,prev_price:double>>"

    def step(acc, x):
        moved = F.struct(x["price"].alias("price"), F.concat(acc["moves"], F.array(
            F.struct(x["run"].alias("run"), x["price"].alias("price"), acc["price"].alias("prev_price")))).alias("moves"))
        return F.when(F.abs(x["price"] - acc["price"]) > F.lit(float(tol)), moved).otherwise(acc)

    def chunk(acc, i):
        opening = F.struct(acc["price"].alias("price"), F.array().cast(kind).alias("moves"))
        inner = F.aggregate(F.slice(drift, i * _CHUNK + 1, F.lit(_CHUNK)), opening, step)
        return F.struct(inner["price"].alias("price"), F.concat(acc["parts"], F.array(inner["moves"])).alias("parts"))
    opening = F.struct(start.alias("price"), F.array().cast(f"array<{kind}>").alias("parts"))
    chunks = F.sequence(F.lit(0), F.floor((F.size(drift) - 1) / _CHUNK).cast("int"))
    folded = F.flatten(F.aggregate(chunks, opening, chunk)["parts"])
    return F.when(F.size(drift) > 0, folded).otherwise(F.array().cast(kind))


def fold_prices(log: DataFrame, keys: Sequence[str] = ("id",), tol=vocab.PRICE_TOLERANCE,
                state: DataFrame | None = None) -> DataFrame:
    """Per listing and segment: its change points, the price it ends with, first and last run.

    The stored price is never further than the tolerance from the last price seen. So a step of well over twice the tolerance,
    or another currency, is a change whatever came before: a window finds it without folding, and it starts a
    segment. Only smaller steps, collected within their segment, are folded one by one from the segment's price on.
    A listing without a first price keeps none. Windows and groupings share one shuffle on the keys.
    """
    keys, run = list(keys), log.schema["run"].dataType
    obs = log.select(*keys, "run", F.col("price").cast("double").alias("price"),
                     F.coalesce("currency", F.lit("")).alias("currency"), F.lit(False).alias("known"))
    if state is not None:
        obs = obs.unionByName(state.select(
            *keys, F.lit(None).cast(run).alias("run"), "price", "currency", F.lit(True).alias("known")))
    in_order = Window.partitionBy(*keys).orderBy(F.col("run").asc_nulls_first())
    priced = F.when(F.col("price").isNotNull(), F.struct("price", "currency"))
    marked = obs.withColumns({
        "__first": F.row_number().over(in_order) == 1,
        "__prev": F.last(priced, ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)),
        "__none": F.first("price").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).isNull()})
    later = ~F.col("__first") & ~F.col("__none") & F.col("price").isNotNull()
    step = price_changed(F.col("price"), F.col("currency"), F.col("__prev.price"), F.col("__prev.currency"), 2.5 * float(tol))
    marked = marked.withColumn("__head", F.col("__first") | (later & step))
    drift = later & ~F.col("__head") & (F.col("price") != F.col("__prev.price"))
    marked = marked.withColumns({"segment": F.count_if("__head").over(in_order.rowsBetween(Window.unboundedPreceding, 0)), "__drift": drift})
    segments = marked.groupBy(*keys, "segment").agg(
        F.max(F.when(F.col("__head"), F.struct("run", "price", "currency", "known"))).alias("head"),
        F.array_sort(F.collect_list(F.when(F.col("__drift"), F.struct("run", "price")))).alias("drift"),
        F.min("run").alias("first_run"), F.max("run").alias("last_run"))
    segments = segments.withColumn("moves", _fold(F.col("drift"), F.col("head.price"), tol, run.simpleString()))
    last = F.coalesce(F.try_element_at("moves", F.lit(-1))["price"], F.col("head.price"))
    before = F.lag("price").over(Window.partitionBy(*keys).orderBy("segment"))
    entry = lambda run, price, prev: F.struct(run.alias("run"), price.alias("price"), F.col("head.currency").alias("currency"),
                                              prev.alias("prev_price"))
    own = F.when(F.col("head.known"), F.lit(0)).otherwise(F.lit(1))
    points = F.concat(F.slice(F.array(entry(F.col("head.run"), F.col("head.price"), F.col("__before"))), F.lit(1), own),
                      F.transform("moves", lambda m: entry(m["run"], m["price"], m["prev_price"])))
    return (segments.withColumn("price", last).withColumn("__before", before).withColumn("points", points)
            .select(*keys, "segment", "first_run", "last_run", F.col("head.known").alias("known"), F.col("head.price").alias("first_price"),
                    "price", F.col("head.currency").alias("currency"), "points"))


def price_history(folded: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """The first price and every change, one row each."""
    return folded.select(*keys, F.inline("points"))


def listing_prices(folded: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Per listing: first and last price, the last change, first and last run, whether it was known before."""
    change = F.try_element_at(F.filter("points", lambda p: p["prev_price"].isNotNull()), F.lit(-1))
    each = folded.withColumn("change", F.when(change.isNotNull(), F.struct(change["run"].alias("run"), change["prev_price"].alias("prev_price"))))
    return each.groupBy(*keys).agg(
        F.max_by("price", "segment").alias("price"), F.max_by("currency", "segment").alias("currency"),
        F.min_by("first_price", "segment").alias("first_price"), F.max("change").alias("change"),
        F.min("first_run").alias("first_run"), F.max("last_run").alias("last_run"), F.bool_or("known").alias("known"))


def price_series(history: DataFrame, keys: Sequence[str] = ("id",), ts="run") -> DataFrame:
    """Ordered (time, price) array of listings with more than one point."""
    series = history.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col("price").alias("price")))).alias("series"))
    return series.where(F.size("series") > 1)


def _scope(columns: Sequence[str]):
    return Window.partitionBy(*(columns or [F.lit(1)]))


def run_calendar(log: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Runs with their neighbours: one small row per run.

    Written to the work folder, so that later joins are planned with its true size and the log
    itself is not shuffled by run.
    """
    runs = log.select(*scope, "run").distinct()
    w = _scope(scope).orderBy("run")
    return stored(runs.withColumns({"prev_run": F.lag("run").over(w), "next_run": F.lead("run").over(w)}), "runs")


def presence_events(log: DataFrame, keys: Sequence[str], calendar: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Every sighting with its neighbours: is it the first, a return, the last before a gap."""
    w = Window.partitionBy(*keys).orderBy("run")
    seen = log.select(*keys, "run").withColumns({"__lag": F.lag("run").over(w), "__lead": F.lead("run").over(w)})
    dated = seen.join(calendar, [*scope, "run"], "left")
    return dated.select(
        *keys, "run", "next_run", F.col("__lag").isNull().alias("added"),
        (F.col("__lag").isNotNull() & ~F.col("__lag").eqNullSafe(F.col("prev_run"))).alias("back"),
        F.when(F.col("next_run").isNotNull() & ~F.col("__lead").eqNullSafe(F.col("next_run")),
               F.col("next_run")).alias("gone_run"))


def lifecycle(log: DataFrame, keys: Sequence[str] = ("id",), scope: Sequence[str] = ()) -> DataFrame:
    """First and last sighting and the run at which a listing was found gone for good."""
    spans = log.groupBy(*keys).agg(F.min("run").alias("first_seen"), F.max("run").alias("last_seen"))
    after = run_calendar(log, scope).select(*scope, F.col("run").alias("last_seen"), F.col("next_run").alias("gone_at"))
    return spans.join(after, [*scope, "last_seen"], "left")


def attributes(log: DataFrame, keys: Sequence[str], latest: Sequence[str], first: Sequence[str] = (),
               state: DataFrame | None = None) -> DataFrame:
    """Per listing the ``latest`` columns as last seen and the ``first`` columns as first seen.

    One partially aggregated pass; an earlier state keeps its first values and, for listings that were not
    seen again, its latest ones.
    """
    def pick(of, names, name):
        return [of(F.struct(*names), "run").alias(name)] if names else []
    parts = {"__l": list(latest), "__f": list(first)}
    parts = {k: v for k, v in parts.items() if v}
    seen = log.groupBy(*keys).agg(*pick(F.max_by, latest, "__l"), *pick(F.min_by, first, "__f"))
    if state is not None:
        known = state.select(*keys, *[F.struct(*names).alias(f"{k}0") for k, names in parts.items()])
        both = known.join(seen, list(keys), "full")
        order = {"__l": ("__l", "__l0"), "__f": ("__f0", "__f")}
        seen = both.select(*keys, *[F.coalesce(*order[k]).alias(k) for k in parts])
    return seen.select(*keys, *[F.col(k)[c].alias(c) for k, names in parts.items() for c in names])


def replay(log: DataFrame, keys: Sequence[str] = ("id",), scope: Sequence[str] = (),
           tol=vocab.PRICE_TOLERANCE, state: DataFrame | None = None, store=False,
           latest: Sequence[str] = (), first: Sequence[str] = ()) -> Replay:
    """Replay full snapshots, optionally on top of an earlier state.

    ``latest`` names the columns of the log that the state refreshes at every sighting, ``first`` those it
    keeps from the first one (``LATEST`` and ``FIRST`` for rows of ``snapshot_rows``).

    Returns the new state, the history points and the audit of the replayed runs. Replaying a
    log in pieces gives the same result as replaying it at once. ``store`` writes the folded
    prices once for callers that use more than one of the results.
    """
    keys, scope = list(keys), list(scope)
    folded = fold_prices(log, keys, tol, state)
    if store:
        folded = stored(folded, "folded")
    history = price_history(folded, keys)

    sightings = log.select(*keys, "run")
    spans = listing_prices(folded, keys)
    if state is None:
        calendar = run_calendar(sightings, scope)
    else:
        before = state.select(*keys, F.col("last_seen").alias("run"))
        last_known = state.groupBy(*scope).agg(F.max("last_seen").alias("run"))
        calendar = run_calendar(sightings.select(*scope, "run").unionByName(last_known.select(*scope, "run")), scope)
        spans = spans.join(state.select(*keys, F.col("first_seen").alias("o_first_seen"),
                                        F.col("last_seen").alias("o_last_seen"), F.col("gone_at").alias("o_gone_at"),
                                        F.col("first_price").alias("o_first_price"),
                                        F.col("prev_price").alias("o_prev_price"),
                                        F.col("price_changed_at").alias("o_price_changed_at")), keys, "left")
        sightings = sightings.unionByName(before)

    after = calendar.select(*scope, F.col("run").alias("last_seen"), F.col("next_run").alias("gone_at"))
    if state is None:
        rows = spans.select(*keys, "price", "currency", "first_price", F.col("change.prev_price").alias("prev_price"),
                            F.col("change.run").alias("price_changed_at"),
                            F.col("first_run").alias("first_seen"), F.col("last_run").alias("last_seen"))
        new_state = rows.join(after, [*scope, "last_seen"], "left")
    else:
        rows = spans.select(
            *keys, "price", "currency",
            F.when(F.col("o_first_seen").isNull(), F.col("first_price"))
            .otherwise(F.col("o_first_price")).alias("first_price"),
            F.coalesce(F.col("change.prev_price"), F.col("o_prev_price")).alias("prev_price"),
            F.coalesce(F.col("change.run"), F.col("o_price_changed_at")).alias("price_changed_at"),
            F.coalesce("o_first_seen", "first_run").alias("first_seen"),
            F.coalesce("last_run", "o_last_seen").alias("last_seen"),
            F.when(F.col("last_run").isNull(), F.col("o_gone_at")).alias("o_gone_at"))
        new_state = (rows.join(after, [*scope, "last_seen"], "left")
                     .withColumn("gone_at", F.coalesce("o_gone_at", "gone_at")).drop("o_gone_at"))

    if latest or first:
        new_state = new_state.join(attributes(log, keys, latest, first, state), keys, "left")

    events = presence_events(sightings, keys, calendar, scope)
    counted = events.select(*scope, F.inline(F.array(
        F.struct(F.col("run"), F.lit(1).alias("fetched"), F.col("added").cast("int").alias("added"),
                 F.col("back").cast("int").alias("back"), F.lit(0).alias("gone")),
        F.struct(F.col("gone_run").alias("run"), F.lit(0).alias("fetched"), F.lit(0).alias("added"),
                 F.lit(0).alias("back"), F.lit(1).alias("gone")))))
    moved = history.where(F.col("prev_price").isNotNull()).groupBy(*scope, "run").agg(
        F.count_if(change_class(F.col("price"), F.col("prev_price")) == "down").alias("price_down"),
        F.count_if(change_class(F.col("price"), F.col("prev_price")) == "up").alias("price_up"))
    audit = counted.where(F.col("run").isNotNull()).groupBy(*scope, "run").agg(
        *[F.sum(c).alias(c) for c in ("fetched", "added", "back", "gone")])
    audit = audit.join(moved, [*scope, "run"], "left").fillna(0, ["price_down", "price_up"])
    # runs of the earlier state only serve as neighbours
    audit = audit.join(log.select(*scope, "run").distinct(), [*scope, "run"], "left_semi")
    return Replay(new_state, history, audit)


def change_report(changes: DataFrame, k=10) -> DataFrame:
    """First ``k`` new listings and the ``k`` largest price cuts of a run."""
    new = (changes.where(F.col("status") == "new").orderBy(F.col("id").cast("string")).limit(k)
           .select(F.lit("new").alias("part"), "id", "was", "now"))
    down = (changes.where(F.col("status") == "down").orderBy(F.col("now") - F.col("was"), F.col("id").cast("string"))
            .limit(k).select(F.lit("down").alias("part"), "id", "was", "now"))
    delta = F.col("now") - F.col("was")
    return new.unionByName(down).withColumns({
        "delta": delta, "delta_pct": F.when(F.col("was") != 0, delta / F.col("was") * 100)})


def cycle_runs(audit: DataFrame, since: Column) -> DataFrame:
    """The runs since a moment with their totals, as the summary of a cycle lists them."""
    return audit.where(F.col("run") >= since).select(
        *[c for c in audit.columns if c not in ("fetched", "added", "back", "gone", "price_down", "price_up")],
        F.col("fetched").alias("total"), "added", "gone", "price_down", "price_up")


def cycle_summary(ads: DataFrame, since: Column, k=5) -> DataFrame:
    """Since a moment: the cheapest new listings per profile and the largest price cuts."""
    w = Window.partitionBy("profile").orderBy(F.col("price").asc_nulls_first(), F.col("id").cast("string"))
    new = (ads.where(F.col("first_seen") >= since).withColumn("place", F.row_number().over(w))
           .where(F.col("place") <= k)
           .select(F.lit("new").alias("part"), "profile", "place", "id", "price", F.lit(None).cast("double").alias("prev_price")))
    cuts = (ads.where((F.col("price_changed_at") >= since) & (F.col("prev_price") > F.col("price")))
            .orderBy(F.col("price") - F.col("prev_price"), F.col("id").cast("string")).limit(k))
    down = cuts.select(F.lit("down").alias("part"), "profile", F.lit(None).cast("int").alias("place"), "id", "price", "prev_price")
    delta = F.col("price") - F.col("prev_price")
    return new.unionByName(down).withColumns({
        "delta": delta, "delta_pct": F.when(F.col("prev_price") != 0, delta / F.col("prev_price") * 100)})
