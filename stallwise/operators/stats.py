"""Market statistics: grouped measures, histograms, facets, summaries."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stallwise import vocab
from stallwise.functions import prices
from stallwise.operators.skew import top_per_key


def rows() -> Column:
    return F.count(F.lit(1))


def filled(column: str) -> Column:
    """Present and, for text, non-empty."""
    return F.col(column).isNotNull() & (F.col(column).cast("string") != "")


def by_district(df: DataFrame, key="district", having=3) -> DataFrame:
    return (df.where(filled(key)).groupBy(key)
            .agg(rows().alias("n"), F.round(F.avg("ppm")).alias("avg_ppm"),
                 F.round(F.min("price")).alias("min_price"), F.round(F.avg("price")).alias("avg_price"),
                 F.round(F.max("price")).alias("max_price"))
            .where(F.col("n") >= having))


def by_group(df: DataFrame, key, having=1, name: str | None = None) -> DataFrame:
    """Count, average price, average price per m² and average area of every group."""
    c = F.col(key) if isinstance(key, str) else key
    name = name or key
    return (df.withColumn(name, c).where(filled(name)).groupBy(name)
            .agg(rows().alias("n"), F.round(F.avg("price")).alias("avg_price"),
                 F.round(F.avg("ppm")).alias("avg_ppm"), F.round(F.avg("area"), 1).alias("avg_area"))
            .where(F.col("n") >= having))


def latest_periods(df: DataFrame, stamp: str, fmt: str, k: int, name: str) -> DataFrame:
    """Counts of the latest ``k`` months or days that occur, in ascending order."""
    counts = (df.where(F.col(stamp).isNotNull())
              .groupBy(F.date_format(stamp, fmt).alias(name)).agg(rows().alias("n")))
    return counts.orderBy(F.col(name).desc()).limit(k).orderBy(name)


def posted_by_month(df: DataFrame, months=24) -> DataFrame:
    return latest_periods(df, "posted", "yyyy-MM", months, "month")


def changes_by_day(history: DataFrame, days=60, ts="ts") -> DataFrame:
    return latest_periods(history, ts, "yyyy-MM-dd", days, "day")


def changes_by_day_of_profile(history: DataFrame, ads: DataFrame, days=60, ts="ts") -> DataFrame:
    """The latest ``days`` days with history points of every profile."""
    counts = (history.join(ads.select("id", "profile"), "id")
              .groupBy("profile", F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(rows().alias("n")))
    return top_per_key(counts, ["profile"], [F.col("day").desc()], days).drop("__rn")


def histogram(df: DataFrame, column="price", width=10000) -> DataFrame:
    """Fixed-width buckets of positive values, labelled by their lower edge in thousands."""
    thousands = F.lit(width // 1000) if width % 1000 == 0 else F.lit(width / 1000)
    edge = (F.floor(F.col(column) / width) * thousands).alias("bucket_k")
    return df.where(F.col(column) > 0).groupBy(edge).agg(rows().alias("n"))


def steps(df: DataFrame, column="price", edges=vocab.PRICE_STEPS) -> DataFrame:
    """Named price steps with their counts; ``lowest`` gives their order."""
    label = prices.price_step(column, edges)
    return (df.where(F.col(column) > 0).groupBy(label.alias("label"))
            .agg(rows().alias("n"), F.min(column).alias("lowest")).orderBy("lowest"))


def profile_summary(df: DataFrame, baselines: DataFrame, as_of: Column, deal_counts: DataFrame,
                    recent_days=7) -> DataFrame:
    """Active, fresh, reduced, recently posted and deal counts of every profile, in one pass."""
    active = df.where(F.col("gone_at").isNull()).join(baselines, "profile", "left")
    fresh = F.col("baseline").isNull() | (F.col("first_seen") > F.col("baseline"))
    recent = F.col("posted") > as_of - F.expr(f"INTERVAL {recent_days} DAYS")
    counts = active.groupBy("profile").agg(
        rows().alias("active"), F.count_if(fresh).alias("fresh"),
        F.count_if(prices.is_price_down()).alias("down"), F.count_if(recent).alias("recent7"))
    return (counts.join(deal_counts, "profile", "left")
            .withColumn("deals", F.coalesce("deals", F.lit(0).cast("bigint"))))


def table_counters(ads: DataFrame, details: DataFrame, history: DataFrame) -> DataFrame:
    """Active listings per profile and the sizes of the other tables, as (name, n) rows."""
    active = (ads.where(F.col("gone_at").isNull()).groupBy(F.col("profile").alias("name"))
              .agg(rows().alias("n")))

    def total(df, name):
        return df.agg(rows().alias("n")).select(F.lit(name).alias("name"), "n")
    return (active.unionByName(total(details, "_details")).unionByName(total(history, "_history"))
            .unionByName(total(ads.where(F.col("gone_at").isNotNull()), "_gone")))


def _facets(df: DataFrame, columns: Mapping, keys: Sequence[str]) -> DataFrame:
    """One (facet, value) row per non-empty value of every listing, from a single pass."""
    pairs = F.array(*[F.struct(F.lit(name).alias("facet"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("value"))
                      for name, c in columns.items()])
    return df.select(*keys, F.inline(pairs)).where(F.col("value") != "")


def facet_values(df: DataFrame, columns: Mapping, keys: Sequence[str] = ("profile",)) -> DataFrame:
    return _facets(df, columns, keys).distinct()


def facet_topk(df: DataFrame, columns: Mapping, k: Mapping[str, int], min_n: Mapping[str, int],
               keys: Sequence[str] = ("profile",)) -> DataFrame:
    """The most frequent values of every facet per profile; ties by value.

    ``k`` and ``min_n`` are given per facet. Restrict a facet to active listings by passing a
    column that is NULL for the others.
    """
    def of(limits):
        return F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("facet")]
    counts = (_facets(df, columns, keys).groupBy(*keys, "facet", "value").agg(rows().alias("n"))
              .where(F.col("n") >= of(min_n)))
    top = top_per_key(counts, [*keys, "facet"], [F.col("n").desc(), F.col("value")], max(k.values()))
    return top.where(F.col("__rn") <= of(k)).withColumnRenamed("__rn", "place")


def segment_ranking(df: DataFrame, key="district") -> DataFrame:
    return (df.where(filled(key)).groupBy(key).agg(rows().alias("n"))
            .orderBy(F.col("n").desc(), key))


def category_tally(df: DataFrame, label: str, keep) -> DataFrame:
    """Rows kept by a category filter and rows dropped per label; kept + dropped = all rows."""
    kept = F.col(label).eqNullSafe(F.lit(keep))
    return (df.groupBy(F.when(kept, "kept").otherwise("dropped").alias("outcome"),
                       F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"))
            .agg(rows().alias("n")).orderBy(F.col("n").desc(), "label"))
