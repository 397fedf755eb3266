"""Joins of listings with their details, flags, history and benchmark."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import prices
from stallwise.sources.sinks import stored


def with_details(ads: DataFrame, details: DataFrame, how="inner") -> DataFrame:
    return ads.join(details, "id", how)


def history_counts(history: DataFrame, id="id") -> DataFrame:
    return history.groupBy(id).agg(F.count(F.lit(1)).alias("hist_points"))


def listing_view(ads: DataFrame, details: DataFrame, flags: DataFrame | None = None,
                 history: DataFrame | None = None) -> DataFrame:
    """Every listing with its details, flags, history size and derived prices."""
    df = ads.join(details, "id", "left")
    if flags is not None:
        df = df.join(flags.select("id", "favorite", "hidden", "note"), "id", "left")
        df = df.withColumns({"favorite": F.coalesce("favorite", F.lit(0)),
                             "hidden": F.coalesce("hidden", F.lit(0)),
                             "note": F.coalesce("note", F.lit(""))})
    if history is not None:
        df = df.join(history_counts(history), "id", "left")
        df = df.withColumn("hist_points", F.coalesce("hist_points", F.lit(0).cast("bigint")))
    return df.withColumns({
        "terms_flag": F.coalesce(F.col("terms_flag").cast("int"), F.lit(0)),
        "ppm": prices.unit_price(),
        "drop_abs": prices.drop_abs(),
        "drop_pct": prices.drop_pct(),
    })


def missing_details(ads: DataFrame, details: DataFrame) -> DataFrame:
    """Active listings that have no details row."""
    return ads.where(F.col("gone_at").isNull()).join(details.select("id"), "id", "left_anti")


def changed_since_fetch(ads: DataFrame, details: DataFrame) -> DataFrame:
    """Active listings whose price changed after their details were fetched."""
    active = ads.where(F.col("gone_at").isNull() & F.col("price_changed_at").isNotNull())
    return (active.join(details.select("id", "fetched_at"), "id")
            .where(F.col("price_changed_at") > F.col("fetched_at")))


def stale_details(ads: DataFrame, details: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Active listings without details or with details older than ``days``."""
    active = ads.where(F.col("gone_at").isNull())
    old = F.col("fetched_at") < as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    return (active.join(details.select("id", "fetched_at"), "id", "left")
            .where(F.col("fetched_at").isNull() | old))


def work_selection(ads: DataFrame, details: DataFrame, mode="missing", *, as_of: Column | None = None,
                   days: int | None = None, profile: str | None = None, limit: int | None = None) -> DataFrame:
    """Ids to fetch again: missing, changed, stale or all; newest first."""
    if profile:
        ads = ads.where(F.col("profile") == profile)
    if mode == "missing":
        picked = missing_details(ads, details)
    elif mode == "changed":
        picked = changed_since_fetch(ads, details)
    elif mode == "stale":
        picked = stale_details(ads, details, days, as_of)
    else:
        picked = ads.where(F.col("gone_at").isNull())
    picked = picked.select("id", "first_seen")
    ordered = picked.orderBy(F.col("first_seen").desc_nulls_last(), F.col("id"))
    return ordered.limit(limit) if limit else ordered


def baselines(runs: DataFrame) -> DataFrame:
    """First finished run of every profile.

    One row per profile, stored so that joins on the few profile values are planned with that size
    and never shuffle the listings by profile.
    """
    return stored(runs.groupBy("profile").agg(F.min("finished").alias("baseline")), "baselines")
