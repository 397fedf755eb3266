"""Whole requests composed from the operators: list page, map layer, trend and listing card.

A request is a plain dict of filter values (keys as in ``operators.filters.apply_filters``) plus
sort, dir, limit, offset, group, months and min_n. Zero and missing limits mean the default.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from stallwise import vocab
from stallwise.functions import labels
from stallwise.operators import filters, linkage, mapview, paging, privacy, snapshots
from stallwise.plans import trends


def list_request(view: DataFrame, spec: Mapping, *, as_of: Column, baselines: DataFrame | None = None,
                 history: DataFrame | None = None, ids: DataFrame | None = None, max_rows=500, **options) -> DataFrame:
    """One page of listings with the total, the new mark and the price series of changed listings.

    A page has ``max_rows`` rows at most, whatever the request asks for. ``view`` carries the benchmark columns. History is cut to the page before it is collected.
    """
    deals = spec.get("tab") == "deals"
    found = filters.apply_filters(view, {"profile": "apartments", **spec}, as_of=as_of, baselines=baselines,
                                  ids=ids, **options)
    key = spec.get("sort") or ("discount" if deals else "posted")
    if key not in paging.SORT_COLUMNS or (key == "discount" and not deals):
        key = "posted"
    limit, offset = min(int(spec.get("limit") or 100), max_rows), max(0, int(spec.get("offset") or 0))
    page = paging.sort_page(found, key, "asc" if spec.get("dir") == "asc" else "desc", limit, offset)
    page = page.withColumn("total", paging.page_total(found).scalar())
    if baselines is not None:
        page = page.join(baselines, "profile", "left").withColumn(
            "is_new", labels.is_new(F.col("first_seen"), F.col("baseline"))).drop("baseline")
    if history is not None:
        wanted = history.join(page.select("id"), "id", "left_semi")
        page = page.join(snapshots.price_series(wanted), "id", "left")
    return page


def map_request(view: DataFrame, spec: Mapping, *, as_of: Column, max_points=20000, **options) -> DataFrame:
    """The points of a map layer, ``max_points`` at most."""
    found = filters.apply_filters(view, {"profile": "apartments", **spec}, as_of=as_of, **options)
    return mapview.map_points(found, min(int(spec.get("limit") or 12000), max_points))


def trend_request(view: DataFrame, spec: Mapping, *, as_of: Column, authors: Mapping = vocab.AUTHORS,
                  months_between=(3, 120), **options) -> DataFrame:
    """The shown series of a trend over the filtered listings; the horizon is held within ``months_between``."""
    months = max(months_between[0], min(int(spec.get("months") or 24), months_between[1]))
    found = filters.apply_filters(view, {"profile": "apartments", **spec}, as_of=as_of, authors=authors, **options)
    group = spec.get("group", "none")
    keys = labels.trend_groups(authors=authors)
    return trends.trend_cube(found, keys.get(group, keys["none"]), as_of, months,
                             order=vocab.TREND_ORDER.get(group))


def listing_cards(view: DataFrame, history: DataFrame, matches: DataFrame, buildings: DataFrame | None = None, **private) -> DataFrame:
    """Every listing as a card: its row, its price history and its register match, without private data.

    The history of one listing has at most one point per run: run, price and currency. ``matches`` carry the
    building of each matched listing; with ``buildings`` (keyed by building) their attributes become ``house``. The units of a
    match stay rows (``listing_units``).
    """
    points = history.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("run", "price", "currency"))).alias("history"))
    names = [c for c in ("building", "tolerance", "n", "value_min", "value_med", "value_max") if c in matches.columns]
    match = matches.select("id", F.struct(*names).alias("register"))
    card = view.join(points, "id", "left").join(match, "id", "left")
    if buildings is not None:
        facts = [c for c in buildings.columns if c != "building"]
        houses = buildings.select(F.col("building").alias("__b"), F.struct(*facts).alias("house"))
        card = card.join(houses, F.col("register.building") == F.col("__b"), "left").drop("__b")
    return privacy.strip_private(card, **private)


def listing_units(listings: DataFrame, matches: DataFrame, units: DataFrame) -> DataFrame:
    """The units behind each matched listing in order of area: id, place and the columns of the unit.

    ``listings`` carry id, building, floor and area; ``matches`` the tolerance of each matched id.
    """
    placed = listings.select("id", "building", "floor", "area").join(matches.select("id", "tolerance"), "id")
    found = linkage.matched_units(placed, units)
    rows = placed.join(found, ["building", "floor", "area", "tolerance"])
    order = Window.partitionBy("id").orderBy("unit_area", "code")
    return rows.withColumn("place", F.row_number().over(order))
