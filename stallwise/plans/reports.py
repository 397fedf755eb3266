"""Report tables composed from the statistics operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stallwise import vocab
from stallwise.functions import prices
from stallwise.operators import stats


def district_report(active: DataFrame) -> DataFrame:
    """Head row and rooms table of every district, as two grouping sets of one pass.

    Head rows have no room count and carry the number of price cuts; rooms rows need three listings.
    """
    named = active.where(stats.filled("district"))
    sets = named.groupingSets([["district"], ["district", "rooms_n"]], "district", "rooms_n").agg(
        F.grouping("rooms_n").alias("head"), F.count(F.lit(1)).alias("n"), F.round(F.avg("ppm")).alias("avg_ppm"),
        F.round(F.avg("price")).alias("avg_price"), F.round(F.avg("area"), 1).alias("avg_area"),
        F.count_if(prices.drop_abs() < 0).alias("down"))
    head = F.col("head") == 1
    return sets.where(head | (F.col("rooms_n").isNotNull() & (F.col("n") >= 3))).select(
        "district", "rooms_n", "n", "avg_ppm", "avg_price", F.when(~head, F.col("avg_area")).alias("avg_area"),
        F.when(head, F.col("down")).alias("down"))


# fixed values: part of the overview -> (profile it is for, listings a group needs)
OVERVIEW_PARTS = {"count": (None, 1), "district": (None, 3), "rooms": ("apartments", 5), "kind": ("commercial", 3)}


def market_overview(listings: DataFrame, kind_feature=vocab.FEATURE_NAMES["premise"]) -> DataFrame:
    """Counts, district, rooms and kind tables of the start pages as (part, profile, label) rows.

    Every listing is expanded to the groups it belongs to, so one pass and one partially
    aggregated shuffle serve all tables.
    """
    labels = {"count": F.lit(""), "district": F.nullif(F.col("district"), F.lit("")),
              "rooms": F.col("rooms_n").cast("string"), "kind": F.nullif(F.col("features")[kind_feature], F.lit(""))}
    groups = F.array(*[F.struct(
        F.lit(part).alias("part"), (c if OVERVIEW_PARTS[part][0] is None else F.when(
            F.col("profile") == OVERVIEW_PARTS[part][0], c)).alias("label")) for part, c in labels.items()])
    expanded = (listings.where(F.col("gone_at").isNull()).select("profile", "price", "ppm", "area", F.inline(groups))
                .where(F.col("label").isNotNull()))
    measured = expanded.groupBy("part", "profile", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("price")).alias("avg_price"), F.round(F.avg("ppm")).alias("avg_ppm"),
        F.when(F.col("part").isin("rooms", "kind"), F.round(F.avg("area"), 1)).alias("avg_area"))
    least = F.create_map(*[F.lit(x) for part, (_, n) in OVERVIEW_PARTS.items() for x in (part, n)])[F.col("part")]
    counted = F.col("part") == "count"
    return measured.where(F.col("n") >= least).withColumns({
        c: F.when(~counted, F.col(c)) for c in ("avg_price", "avg_ppm")})
