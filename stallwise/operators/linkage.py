"""Linking listings to an official register of buildings and units."""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stallwise import vocab
from stallwise.functions import address, geo
from stallwise.operators.skew import first_per_key, group_quantiles
from stallwise.sources.sinks import stored

PLACE = ("building", "floor")


def _band(area: Column, width: float) -> Column:
    return F.floor(F.ln(area) / F.lit(width))


def _area_bands(area: Column, reach: float, width: float) -> Column:
    return F.sequence(_band_of(area, -reach, width), _band_of(area, reach, width))


def _band_of(area: Column, shift: float, width: float) -> Column:
    return F.floor((F.ln(area) + F.lit(shift)) / F.lit(width))


def _near_pairs(probes: DataFrame, units: DataFrame, keys: Sequence[str], tolerances: Sequence[float]) -> DataFrame:
    """Probe and unit rows whose areas lie within the widest tolerance, with their tier.

    The join key includes a logarithmic area band one tolerance wide. A probe looks into the at
    most three bands it can touch, so a crowded building spreads over tasks by area.
    """
    reach = -math.log(1 - max(tolerances))
    width = reach * 1.001
    area, unit_area = F.col("area"), F.col("unit_area")
    left = (probes.where(area > 0)
            .withColumn("__band", F.explode(_area_bands(area, reach, width))))
    right = units.where(unit_area > 0).withColumn("__band", _band(unit_area, width))
    tier = F.coalesce(*[F.when(unit_area.between(area * F.lit(1 - t), area * F.lit(1 + t)), F.lit(float(t)))
                        for t in sorted(tolerances)])
    return (left.join(right, [*keys, "__band"]).withColumn("tolerance", tier)
            .where(F.col("tolerance").isNotNull()).drop("__band"))


def tolerance_match(ads: DataFrame, units: DataFrame, keys: Sequence[str] = PLACE,
                    tolerances: Sequence[float] = vocab.AREA_TOLERANCES) -> DataFrame:
    """Register values of the units that may be a listing, at the first tolerance that finds any.

    ``ads`` has the keys and area; ``units`` the keys, area and value. The result has one row per
    distinct (keys, area): equal listings share it, and equal units are counted before the join,
    so neither side's repetition multiplies.
    """
    keys = list(keys)
    probes = ads.select(*keys, F.col("area").cast("double").alias("area")).distinct()
    counted = (units.where(F.col("value") > 0)
               .groupBy(*keys, F.col("area").cast("double").alias("unit_area"), "value")
               .agg(F.count(F.lit(1)).alias("__c")))
    pairs = _near_pairs(probes, counted, keys, tolerances)
    tiers = group_quantiles(pairs, [*keys, "area", "tolerance"], "value", {"med": 0.5}, weight="__c", extremes=True, store=True)
    result = F.struct("tolerance", "n", F.col("min").cast("bigint").alias("value_min"),
                      F.bround("med").cast("bigint").alias("value_med"), F.col("max").cast("bigint").alias("value_max"))
    best = tiers.groupBy(*keys, "area").agg(F.min_by(result, "tolerance").alias("m"))
    return best.select(*keys, "area", "m.*")


def match_listings(ads: DataFrame, units: DataFrame, keys: Sequence[str] = PLACE,
                   tolerances: Sequence[float] = vocab.AREA_TOLERANCES) -> DataFrame:
    """Listings with their match; unmatched ones are absent."""
    return ads.join(tolerance_match(ads, units, keys, tolerances), [*keys, "area"])


def matched_units(matches: DataFrame, units: DataFrame, keys: Sequence[str] = PLACE) -> DataFrame:
    """The units behind every distinct match, one row each (order by unit_area, code to list them)."""
    keys = list(keys)
    probes = matches.select(*keys, "area", F.col("tolerance").alias("tier")).distinct()
    sides = units.where(F.col("value") > 0).withColumnRenamed("area", "unit_area")
    tolerances = vocab.AREA_TOLERANCES
    pairs = _near_pairs(probes, sides, keys, tolerances)
    return pairs.where(F.col("tolerance") <= F.col("tier")).drop("tolerance").withColumnRenamed("tier", "tolerance")


def unit_lookup(matches: DataFrame, units: DataFrame, buildings: DataFrame, keys: Sequence[str] = PLACE) -> DataFrame:
    """Matched units with the attributes of their building."""
    return matched_units(matches, units, keys).join(buildings, "building", "left")


def rematch_merge(stored: DataFrame, touched: DataFrame, recomputed: DataFrame, id="id") -> DataFrame:
    """Replace the matches of all touched listings; those that no longer match disappear."""
    return (stored.join(touched.select(id).distinct(), id, "left_anti")
            .unionByName(recomputed.select(*stored.columns)))


def match_coverage(ads: DataFrame, matches: DataFrame, by: Sequence[str] = (), id="id") -> DataFrame:
    """Listings, matched listings and matches per tolerance."""
    marked = ads.select(id, *by).join(matches.select(id, "tolerance"), id, "left")
    t = F.col("tolerance")
    return marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count(t).alias("found"),
        *[F.count_if(t == F.lit(float(x))).alias(f"within_{round(x * 100)}") for x in vocab.AREA_TOLERANCES])


# ---- addresses ---------------------------------------------------------------------------

def address_parts(df: DataFrame, column: str) -> DataFrame:
    """Street and house of an address column; the parts are split once and then read."""
    street, house = address.split_parts(F.col("__parts"))
    return (df.withColumn("__parts", address.address_parts(column))
            .withColumns({"street": street, "house": house}).drop("__parts"))


def score_names(names: DataFrame, score: Callable[[Column, Column], Column] = address.edit_similarity) -> DataFrame:
    """Similarity of distinct (street, b_street) pairs.

    The sound keys are derived once per distinct name and joined, so that neither a pushed filter
    nor a repeated reference evaluates them again per pair.
    """
    names = stored(names, "street-names")
    every = names.select("street").union(names.select("b_street")).distinct()
    keys = every.withColumn("__key", address.street_key("street"))
    keyed = (names.join(keys.withColumnRenamed("__key", "__a"), "street")
             .join(keys.withColumnsRenamed({"street": "b_street", "__key": "__b"}), "b_street"))
    return keyed.withColumn("score", score(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def score_streets(pairs: DataFrame, score: Callable[[Column, Column], Column] = address.edit_similarity) -> DataFrame:
    """Pairs with the similarity of their street names, computed once per distinct pair of names."""
    return pairs.join(score_names(pairs.select("street", "b_street").distinct(), score), ["street", "b_street"])


# ---- survey of points --------------------------------------------------------------------

def _band_of_latitude(lat: Column) -> Column:
    """How often the scale of the projection has doubled from the equator to a latitude."""
    return F.floor(-F.log2(F.greatest(F.cos(F.radians(lat)), F.lit(2.0 ** -40)))).cast("int")


def _cells(df: DataFrame, size: Column) -> DataFrame:
    return df.withColumns({"__cx": F.floor(F.col("__x") / size), "__cy": F.floor(F.col("__y") / size)})


def near_places(points: DataFrame, places: DataFrame, radii: Sequence[float] = (0.0, *vocab.RING_METRES),
                extra_keys: Sequence[str] = (), directions=vocab.RING_DIRECTIONS) -> DataFrame:
    """Pairs of points and places within the widest radius, with the ring and the direction the place lies in.

    Points look into their own and the eight neighbouring cells of a square grid in projected metres. Cells are nested
    by band of latitude: each band in which the projection's scale doubles has cells of its own size, so cells
    follow the latitude of their point and no other. A place is filed in the bands of all points that may see it,
    which are two only at a border. ``direction`` is the nearest of the probe directions, 0 at the centre. Callers pass distinct
    rows.
    """
    reach = 1.01 * max(radii)
    size = F.lit(reach) * F.pow(F.lit(2.0), F.col("__band") + 1)
    margin = reach / 110_000.0
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    at = lambda df: df.withColumns({"__x": geo.mercator_x("lon"), "__y": geo.mercator_y("lat")})
    left = _cells(at(points).withColumn("__band", _band_of_latitude(F.col("lat"))), size)
    left = left.withColumnsRenamed({"__x": "__px", "__y": "__py"}).withColumn("__dx", F.explode(steps)).withColumn("__dy", F.explode(steps))
    left = left.withColumns({"__cx": F.col("__cx") + F.col("__dx"), "__cy": F.col("__cy") + F.col("__dy")})
    bands = F.array_distinct(F.array(*[_band_of_latitude(F.col("lat") + d) for d in (-margin, 0.0, margin)]))
    right = _cells(at(places).withColumn("__band", F.explode(bands)), size).withColumnsRenamed({c: f"place_{c}" for c in ("lat", "lon")})
    pairs = left.join(right, ["__band", "__cx", "__cy", *extra_keys])
    scale = F.cos(F.radians("lat"))
    east, north = (F.col("__x") - F.col("__px")) * scale, (F.col("__y") - F.col("__py")) * scale
    metres = F.sqrt(F.pow(east, F.lit(2)) + F.pow(north, F.lit(2)))
    ring = F.coalesce(*[F.when(metres <= r, F.lit(float(r))) for r in sorted(radii)])
    turn = F.pmod(F.round(F.atan2(north, east) * F.lit(directions / (2 * math.pi))).cast("int"), F.lit(directions))
    return (pairs.withColumn("ring", ring).where(F.col("ring").isNotNull()).withColumn("direction", F.when(F.col("ring") > 0, turn).otherwise(F.lit(0)))
            .drop("__band", "__cx", "__cy", "__dx", "__dy", "__px", "__py", "__x", "__y"))


POINT = ("lat", "lon")


def near_addresses(here: DataFrame, there: DataFrame, radii: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """Near spots, and near addresses of one house number; both sides carry lat, lon and house_key.

    Distinct spots are searched, as ``near_places`` does, and addresses join what was found: none is copied to nine cells.
    """
    spots = stored(near_places(here.select(*POINT).distinct(), there.select(*POINT).distinct(), radii), "near-spots")
    around = there.withColumnsRenamed({c: f"place_{c}" for c in POINT})
    return spots, here.join(spots, list(POINT)).join(around, ["place_lat", "place_lon", "house_key"])


def _spot(df: DataFrame) -> DataFrame:
    """Coordinates to six decimals, the street, and the house number as it is compared."""
    return df.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6), "street": F.coalesce("street", F.lit("")),
                           "house_key": address.norm_house("house")})


def match_points(listings: DataFrame, places: DataFrame, radii: Sequence[float] = (0.0, *vocab.RING_METRES),
                 min_score=vocab.STREET_SCORE_MIN, score: Callable[[Column, Column], Column] = address.edit_similarity) -> DataFrame:
    """The building of every distinct address at a point: lat, lon, street, house_key, b_street, code, score.

    ``listings`` carry lat, lon, street, house and all_new; ``places`` lat, lon, street, house and code. A survey of a point
    meets places ring by ring and direction by direction, of equal ones by code, and stops at the first that suits an
    address of the point; points of new builds only are surveyed in the inner ring. Among the places met by
    then, an address takes the best street of its house number, the earliest one on ties.

    Addresses and places meet by cell and house number, so the work follows what stands around a point. Places of
    one spot, street and number count once, and street names are scored once per distinct pair.
    """
    spots = _spot(listings).where(F.col("house_key") != "").select(*POINT, "street", "house_key", "all_new")
    fresh = stored(spots.groupBy(*POINT).agg(F.bool_and("all_new").alias("__new")).where("__new"), "new-points")
    here = spots.select(*POINT, "street", "house_key").distinct()
    there = _spot(places).groupBy(*POINT, F.col("street").alias("b_street"), "house_key").agg(F.min("code").alias("code"))
    inner = sorted(radii)[1] if len(radii) > 1 else max(radii)
    near = near_places(here, there, radii, ["house_key"]).join(fresh, list(POINT), "left").where(F.col("__new").isNull() | (F.col("ring") <= inner))
    good = stored(score_streets(stored(near.drop("__new"), "near-places"), score).where(F.col("score") >= min_score), "similar-places")
    order = F.struct("ring", "direction")
    stops = stored(good.groupBy(*POINT).agg(F.min(order).alias("__stop")), "stops")
    met = good.join(stops, list(POINT)).where(order <= F.col("__stop"))
    best = first_per_key(met, [*POINT, "street", "house_key"], [F.col("score").desc(), "ring", "direction", "code", "b_street"])
    return best.select(*POINT, "street", "house_key", "b_street", "code", "score")


def rematch(listings: DataFrame, places: DataFrame, units: DataFrame, **options) -> DataFrame:
    """Register matches of listings from their coordinates on: id, building, tolerance, n and values.

    ``listings`` carry id, lat, lon, street, house, area, floor and all_new; ``units`` building, floor, area, value. Listings
    without a house, a building, an area or a floor have no match and are absent.
    """
    found = match_points(listings, places, **options).select(*POINT, "street", "house_key", F.col("code").alias("building"))
    placed = _spot(listings).join(found, [*POINT, "street", "house_key"]).where("area <> 0 and floor is not null")
    matched = match_listings(placed.select("id", "building", "floor", "area"), units)
    return matched.select("id", "building", "tolerance", "n", "value_min", "value_med", "value_max")


def probe_candidates(points: DataFrame, places: DataFrame, radii: Sequence[float] = (0.0, *vocab.RING_METRES),
                     min_score=vocab.STREET_SCORE_MIN,
                     score: Callable[[Column, Column], Column] = address.edit_similarity) -> DataFrame:
    """Survey result of every point: found at which ring, nomatch or empty.

    ``points`` and ``places`` carry lat, lon, street and house. A point is found at the first ring
    with a place of the same house number and a similar street.
    """
    house = address.norm_house("house").alias("house_key")
    here = points.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "street", house).distinct()
    there = places.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
                          F.col("street").alias("b_street"), house).distinct()
    spots, pairs = near_addresses(here, there, radii)
    near = spots.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("places"))
    matched = (score_streets(pairs, score).where(F.col("score") >= min_score)
               .groupBy("lat", "lon").agg(F.min("ring").alias("ring")))
    every = here.select("lat", "lon").distinct()
    joined = every.join(near, ["lat", "lon"], "left").join(matched, ["lat", "lon"], "left")
    status = (F.when(F.col("ring").isNotNull(), "found").when(F.col("places").isNotNull(), "nomatch")
              .otherwise("empty"))
    return joined.withColumns({"status": status, "places": F.coalesce("places", F.lit(0).cast("bigint"))})


def survey_coverage(survey: DataFrame) -> DataFrame:
    """How many surveyed points ended in each status, and at which ring those found were."""
    return survey.groupBy("status", "ring").agg(F.count(F.lit(1)).alias("points"), F.sum("places").alias("places"))


def probe_points(points: DataFrame, all_new: Column | None = None) -> DataFrame:
    """The probe positions of every survey point: centre, then rings."""
    rings = geo.rings_for(F.lit(False) if all_new is None else all_new)
    exploded = points.select("*", F.posexplode(geo.ring_offsets(rings)).alias("probe", "__o"))
    x, y = geo.probe_xy("lat", "lon", F.col("__o.radius"), F.col("__o.step"))
    return exploded.withColumns({"x": x, "y": y}).drop("__o")
