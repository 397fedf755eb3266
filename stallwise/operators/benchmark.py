"""Segment-median price benchmark and what is measured against it."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stallwise import vocab
from stallwise.functions import prices
from stallwise.operators.filters import deal_rules, pool_rules
from stallwise.operators.skew import group_quantiles
from stallwise.sources.sinks import stored

SEGMENT = ("district", "rooms_n", "housing_stock")


def segment_median(df: DataFrame, keys: Sequence[str] = SEGMENT, value="ppm",
                   pool: Column | None = None, approx=False, store=True) -> DataFrame:
    """Median and pool size of every segment of the pool.

    Exact by default and balanced for hot segments; ``approx`` trades that for one pass. ``store``
    suits a pool that comes out of a join; turn it off for a stored table.
    """
    if pool is not None:
        df = df.where(pool)
    if approx:
        return df.groupBy(*keys).agg(F.percentile_approx(value, 0.5, 100000).alias("med_ppm"),
                                     F.count(value).alias("pool_n"))
    return group_quantiles(df, keys, value, {"med_ppm": 0.5}, count_as="pool_n", store=store)


def with_benchmark(df: DataFrame, bench: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Attach the segment benchmark; a NULL in the segment never matches.

    Pass a benchmark read from a table (``sources.sinks.stored``): its size is then known when the
    join is planned, and listings are not shuffled by segment just to meet one row per segment.
    Larger benchmarks are joined by shuffle, where adaptive execution splits skewed segments.
    """
    joined = df.join(bench, list(keys), "left")
    return joined.withColumns({
        "discount": prices.discount(),
        "vs_med": prices.vs_median(),
        "suspect": prices.suspect(),
    })


def active_pool(profile="apartments") -> Column:
    return (F.col("profile") == profile) & F.col("gone_at").isNull()


def deals(df: DataFrame, *, min_area=vocab.MIN_AREA, pool_min=vocab.POOL_MIN,
          discount=vocab.DISCOUNT_RANGE, allow_terms=False, price_floor=vocab.PRICE_FLOOR,
          ppm_range=vocab.PPM_DEAL_RANGE, city: str | None = vocab.CITY,
          profile="apartments", bench: DataFrame | None = None) -> DataFrame:
    """Active listings priced well below a reliable median of their segment.

    ``bench`` takes a benchmark that is already stored; otherwise it is built from ``df``.
    """
    active = df.where(active_pool(profile))
    if bench is None:
        bench = stored(segment_median(active, pool=pool_rules(min_area, price_floor, ppm_range, city)), "benchmark")
    gate = deal_rules(min_area, price_floor, ppm_range, city)
    if not allow_terms:
        gate = gate & (F.coalesce(F.col("terms_flag").cast("int"), F.lit(0)) == 0)
    # the gate runs before the join, so only candidates meet the benchmark
    priced = with_benchmark(active.where(gate), bench.where(F.col("pool_n") >= pool_min))
    return priced.where(F.col("discount").between(*[float(x) for x in discount]))
