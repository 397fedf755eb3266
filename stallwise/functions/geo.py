"""Coordinates: projection, probe rings, cells and boxes."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from stallwise import vocab


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mercator_x(lon) -> Column:
    return F.radians(_c(lon)) * F.lit(vocab.EARTH_RADIUS)


def mercator_y(lat) -> Column:
    return F.lit(vocab.EARTH_RADIUS) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(_c(lat)) / 2))


def ring_offsets(rings: Column, directions=vocab.RING_DIRECTIONS) -> Column:
    """Array of (radius, step): the centre and ``directions`` points on every ring."""
    around = F.flatten(F.transform(rings, lambda r: F.transform(
        F.sequence(F.lit(0), F.lit(directions - 1)),
        lambda i: F.struct(r.cast("double").alias("radius"), i.cast("int").alias("step")))))
    centre = F.array(F.struct(F.lit(0.0).alias("radius"), F.lit(0).alias("step")))
    return F.concat(centre, around)


def rings_for(all_new: Column, rings=vocab.RING_METRES) -> Column:
    """Only the inner ring where every listing of the point is new build."""
    every = F.array(*[F.lit(float(r)) for r in rings])
    return F.when(all_new, F.slice(every, 1, 1)).otherwise(every)


def probe_xy(lat, lon, radius, step, directions=vocab.RING_DIRECTIONS) -> tuple[Column, Column]:
    """Projected probe point; radii are metres on the ground, hence the 1/cos(lat) scale."""
    reach = _c(radius) / F.cos(F.radians(_c(lat)))
    angle = F.lit(2 * math.pi) * _c(step) / F.lit(directions)
    return mercator_x(lon) + reach * F.cos(angle), mercator_y(lat) + reach * F.sin(angle)


def point_key(lat, lon, digits=6) -> Column:
    return F.format_string(f"%.{digits}f,%.{digits}f", _c(lat), _c(lon))


def within_bbox(lat, lon, bbox=vocab.BBOX) -> Column:
    lat_min, lon_min, lat_max, lon_max = bbox
    return _c(lat).between(lat_min, lat_max) & _c(lon).between(lon_min, lon_max)
