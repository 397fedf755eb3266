"""Derived price columns. Every function takes and returns ``Column``."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from stallwise import vocab


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unit_price(price="price", area="area", given="price_per_m2") -> Column:
    """The stated price per square metre, else price over a positive area."""
    area = _c(area)
    return F.coalesce(_c(given), F.when(area > 0, F.try_divide(_c(price), area)))


def drop_abs(price="price", prev="prev_price") -> Column:
    return _c(price) - _c(prev)


def drop_pct(price="price", prev="prev_price") -> Column:
    price, prev = _c(price), _c(prev)
    return F.when(prev > 0, F.try_divide((price - prev) * 100.0, prev))


def effective_drop_abs(price="price", prev="prev_price", old="old_price") -> Column:
    """The tracked drop, else the drop against a crossed-out older price."""
    price, old = _c(price), _c(old)
    crossed_out = F.when((old != 0) & (old > price), price - old)
    return F.coalesce(drop_abs(price, prev), crossed_out)


def effective_drop_pct(price="price", prev="prev_price", old="old_price") -> Column:
    change = effective_drop_abs(price, prev, old)
    base = F.coalesce(_c(prev), _c(old))
    return F.when((change != 0) & (base != 0), F.try_divide(change, base) * 100.0)


def discount(ppm="ppm", med="med_ppm") -> Column:
    med = _c(med)
    return F.try_divide((med - _c(ppm)) * 100.0, med)


def vs_median(ppm="ppm", med="med_ppm", pool_n="pool_n", pool_min=vocab.POOL_MIN) -> Column:
    med = _c(med)
    return F.when(_c(pool_n) >= pool_min, F.try_divide((_c(ppm) - med) * 100.0, med))


def suspect(ppm="ppm", med="med_ppm", pool_n="pool_n", terms="terms_flag",
            pool_min=vocab.POOL_MIN, share=vocab.SUSPECT_SHARE) -> Column:
    """1 for an unexplained price far below a reliable median, else 0 (unknown counts as 0)."""
    hit = ((_c(pool_n) >= pool_min)
           & (F.coalesce(_c(terms).cast("int"), F.lit(0)) == 0)
           & (_c(ppm) < _c(med) * F.lit(float(share))))
    return F.when(hit, 1).otherwise(0)


def price_step(price="price", steps: Sequence = vocab.PRICE_STEPS) -> Column:
    """Label of the first step whose upper edge exceeds the price."""
    price, out = _c(price), None
    for edge, label in steps:
        if edge is None:
            return out.otherwise(F.lit(label)) if out is not None else F.lit(label)
        out = F.when(price < edge, label) if out is None else out.when(price < edge, label)
    return out


def is_price_down(price="price", prev="prev_price", old="old_price") -> Column:
    price, old = _c(price), _c(old)
    return F.coalesce(drop_abs(price, prev) < 0, F.lit(False)) | F.coalesce(old > price, F.lit(False))
