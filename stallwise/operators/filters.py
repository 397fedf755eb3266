"""Composable listing filters. Each predicate is a boolean ``Column`` over listing columns."""
from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stallwise import vocab
from stallwise.functions import prices

# filter key -> (column, is a lower bound)
RANGES = {
    "price_min": ("price", True), "price_max": ("price", False),
    "ppm_min": ("ppm", True), "ppm_max": ("ppm", False),
    "area_min": ("area", True), "area_max": ("area", False),
    "floor_min": ("floor", True), "floor_max": ("floor", False),
    "floors_min": ("floors_total", True), "floors_max": ("floors_total", False),
    "views_min": ("views_total", True),
    "photos_min": ("photos_count", True),
}
SETS = {"districts": "district", "housing": "housing_stock", "developers": "developer"}


def conjunction(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def lifecycle(gone: str | None = None, gone_at="gone_at") -> Column:
    """``"1"`` gone only, ``"both"`` everything, otherwise active only."""
    if gone == "1":
        return F.col(gone_at).isNotNull()
    return F.lit(True) if gone == "both" else F.col(gone_at).isNull()


def posted_within(days: int, as_of: Column, posted="posted") -> Column:
    return F.col(posted) > as_of - F.expr(f"INTERVAL {int(days)} DAYS")


def ranges(spec: Mapping[str, float]) -> list[Column]:
    out = []
    for key, (column, lower) in RANGES.items():
        bound = spec.get(key)
        if bound is not None:
            out.append(F.col(column) >= bound if lower else F.col(column) <= bound)
    return out


def rooms(wanted: Iterable[int], column="rooms_n", top=5) -> Column:
    """Room counts; the top value means "that many or more"."""
    wanted = {int(r) for r in wanted}
    exact = sorted(wanted - {top}) if top in wanted else sorted(wanted)
    parts = [F.col(column) >= top] if top in wanted else []
    if exact:
        parts.append(F.col(column).isin(exact))
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def author(kind: str, authors: Mapping[str, str] = vocab.AUTHORS,
           author_type="author_type", business="owner_is_business") -> Column:
    """Author kind by label; an empty label falls back to the owner's business mark."""
    label = F.coalesce(F.col(author_type), F.lit(""))
    if kind == "developer":
        return label == authors["developer"]
    mark = F.coalesce(F.col(business).cast("int"), F.lit(0))
    return (label == authors[kind]) | ((label == "") & (mark == (1 if kind == "business" else 0)))


def feature_in(name: str, values: Iterable[str], features="features") -> Column:
    return F.col(features)[name].isin(list(values))


def amenity(key: str, amenities: Mapping = vocab.AMENITIES, features="features") -> Column:
    name, test, values = amenities[key]
    value = F.col(features)[name]
    if test == "true":
        return value == "True"
    if test == "present":
        return value.isNotNull()
    inside = value.isin(list(values))
    return inside if test == "in" else ~inside


def not_first_floor() -> Column:
    return F.col("floor") > 1


def not_last_floor() -> Column:
    return F.col("floors_total").isNull() | (F.col("floor") < F.col("floors_total"))


def has_photo() -> Column:
    return F.coalesce(F.col("photos_count"), F.lit(0)) > 0


def text_search(query: str, columns: Iterable[str]) -> Column:
    """Case-insensitive substring in any of the columns; ``%`` and ``_`` are literal."""
    escaped = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    hits = [F.coalesce(F.col(c).cast("string").ilike(f"%{escaped}%"), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, hits)


def pool_rules(min_area=vocab.MIN_AREA, price_floor=vocab.PRICE_FLOOR,
               ppm_range=vocab.PPM_DEAL_RANGE, city: str | None = vocab.CITY) -> Column:
    """Listings comparable enough to enter a segment median."""
    parts = [F.col("area").between(float(min_area), vocab.AREA_MAX),
             F.col("price") >= price_floor,
             F.col("ppm").between(*ppm_range),
             F.col("rooms_n").isNotNull(),
             F.col("housing_stock") != ""]
    if city is not None:
        parts.append(F.col("city") == city)
    return conjunction(parts)


def deal_rules(min_area=vocab.MIN_AREA, price_floor=vocab.PRICE_FLOOR,
               ppm_range=vocab.PPM_DEAL_RANGE, city: str | None = vocab.CITY) -> Column:
    """The stricter gate for a deal: also a middle floor and a plausible area per room."""
    per_room = F.col("area") / F.greatest(F.col("rooms_n"), F.lit(1))
    return (pool_rules(min_area, price_floor, ppm_range, city)
            & (F.col("floor") > 1) & (F.col("floor") < F.col("floors_total"))
            & (per_room <= vocab.AREA_PER_ROOM_MAX))


def in_ids(df: DataFrame, ids: DataFrame, column="id") -> DataFrame:
    """Rows whose id is listed; an empty list keeps nothing."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")


def after_baseline(df: DataFrame, baselines: DataFrame, profile="profile") -> DataFrame:
    """Rows first seen after the baseline of their profile."""
    return df.join(baselines, profile, "left").where(
        F.col("baseline").isNull() | (F.col("first_seen") > F.col("baseline")))


def apply_filters(df: DataFrame, spec: Mapping, *, as_of: Column, authors=vocab.AUTHORS,
                  feature_names=vocab.FEATURE_NAMES, amenities=vocab.AMENITIES,
                  search_columns=("title", "description", "street", "id"),
                  ids: DataFrame | None = None, baselines: DataFrame | None = None) -> DataFrame:
    """Apply a whole filter request to a listing view (columns as in ``joins.listing_view``).

    All row predicates go into one conjunction so that Catalyst can push what it can to the scan.
    """
    parts = [lifecycle(spec.get("gone"))]
    if spec.get("profile"):
        parts.append(F.col("profile") == spec["profile"])
    tab = spec.get("tab", "all")
    if tab == "new" and spec.get("new_by") != "base":
        parts.append(posted_within(spec.get("new_days") or 7, as_of))
    if tab == "down":
        parts.append(prices.is_price_down())
    if tab == "deals":
        low = spec.get("discount_min")
        high = spec.get("discount_max")
        min_area = spec.get("min_area")
        parts += [deal_rules(vocab.MIN_AREA if min_area is None else min_area,
                             spec.get("price_floor", vocab.PRICE_FLOOR),
                             spec.get("ppm_range", vocab.PPM_DEAL_RANGE), spec.get("city", vocab.CITY)),
                  F.col("pool_n") >= int(spec.get("pool_min") or vocab.POOL_MIN),
                  F.col("discount") >= (vocab.DISCOUNT_RANGE[0] if low is None else low),
                  F.col("discount") <= (vocab.DISCOUNT_RANGE[1] if high is None else high)]
        if not spec.get("show_terms"):
            parts.append(F.coalesce(F.col("terms_flag").cast("int"), F.lit(0)) == 0)
    if tab == "hidden":
        parts.append(F.coalesce(F.col("hidden"), F.lit(0)) == 1)
    elif not spec.get("show_hidden"):
        parts.append(F.coalesce(F.col("hidden"), F.lit(0)) == 0)
    parts += ranges(spec)
    if spec.get("rooms"):
        parts.append(rooms(spec["rooms"]))
    parts += [F.col(column).isin(list(spec[key])) for key, column in SETS.items() if spec.get(key)]
    if spec.get("author"):
        parts.append(author(spec["author"], authors))
    parts += [feature_in(name, spec[key]) for key, name in feature_names.items() if spec.get(key)]
    parts += [amenity(key, amenities) for key in spec.get("amen", ()) if key in amenities]
    if spec.get("not_first"):
        parts.append(not_first_floor())
    if spec.get("not_last"):
        parts.append(not_last_floor())
    if spec.get("has_photo"):
        parts.append(has_photo())
    if spec.get("hide_suspect"):
        parts.append(F.coalesce(F.col("suspect"), F.lit(0)) == 0)
    if spec.get("age_max") is not None:
        parts.append(posted_within(spec["age_max"], as_of))
    if spec.get("q"):
        parts.append(text_search(spec["q"], [c for c in search_columns if c in df.columns]))
    out = df.where(conjunction(parts))
    if tab == "new" and spec.get("new_by") == "base":
        out = after_baseline(out, baselines)
    if tab == "fav":
        out = out.where(F.lit(False)) if ids is None else in_ids(out, ids)
    return out
