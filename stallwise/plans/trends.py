"""Monthly trend cube: cells, gap filling, series choice, smoothing and change measures."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stallwise import vocab
from stallwise.operators.skew import group_quantiles
from stallwise.sources.sinks import stored

MONTH = "yyyy-MM"


def _months_back(as_of: Column, n: int) -> Column:
    return F.add_months(F.trunc(as_of, "month"), -n)


def cells(df: DataFrame, group: Column, as_of: Column, months=24, posted="posted",
          sane=vocab.PPM_SANE) -> DataFrame:
    """One row per (month, series): counts, averages and exact quantiles.

    The horizon is a plain range on the posting time, so it reaches the scan as a pushed filter.
    """
    first = _months_back(as_of, int(months) - 1).cast("timestamp_ntz")
    after = _months_back(as_of, -1).cast("timestamp_ntz")
    base = df.where((F.col(posted) >= first) & (F.col(posted) < after) & (F.col("price") > 0)).select(
        F.date_format(posted, MONTH).alias("month"),
        F.coalesce(group, F.lit(vocab.UNSPECIFIED)).alias("series"),
        F.col("price").cast("double").alias("price"),
        F.when(F.col("ppm").between(*sane), F.col("ppm")).alias("ppm"),
        F.when(F.col("area") != 0, F.col("area")).alias("area"))
    # read three times below, while the listing view behind it is usually a join
    base = stored(base, "trend-rows")
    sizes = base.groupBy("month", "series").agg(
        F.count(F.lit(1)).alias("n"), F.count("ppm").alias("n_ppm"),
        F.avg("ppm").alias("avg_ppm"), F.avg("price").alias("avg_price"))
    measures = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                         for m in ("price", "ppm", "area")])
    melted = base.select("month", "series", F.inline(measures))
    q = group_quantiles(melted, ["month", "series", "metric"], "value",
                        {"p25": 0.25, "p50": 0.5, "p75": 0.75})

    def of(metric, column, name):
        return F.max(F.when(F.col("metric") == metric, F.col(column))).alias(name)
    wide = q.groupBy("month", "series").agg(
        of("ppm", "p50", "med_ppm"), of("ppm", "p25", "p25_ppm"), of("ppm", "p75", "p75_ppm"),
        of("price", "p50", "med_price"), of("area", "p50", "med_area"))
    return sizes.join(wide, ["month", "series"], "left")


def fill(cube: DataFrame) -> DataFrame:
    """Every series on every month from the first to the last observed one; gaps have n = 0.

    The span covers all series, including ones a later cut hides.
    """
    def edge(f):
        return f(F.to_date("month", MONTH))
    span = cube.agg(F.sequence(edge(F.min), edge(F.max), F.expr("interval 1 month")).alias("span"))
    spine = (cube.select("series").distinct().withColumn("span", span.scalar())
             .select("series", F.explode("span").alias("month"))
             .withColumn("month", F.date_format("month", MONTH)))
    return (spine.join(cube, ["series", "month"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))))


def top_series(cube: DataFrame, k=vocab.MAX_SERIES, order: Sequence[str] | None = None) -> DataFrame:
    """The shown series with their place and size, and what stays hidden.

    Names of a fixed order come first in that order, the rest by size; the cut follows the ordering.
    """
    totals = cube.groupBy("series").agg(F.sum("n").alias("total"))
    fixed = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("series")) if order else F.lit(0)
    ranked = totals.withColumn("__fixed", F.when(fixed > 0, fixed).otherwise(F.lit(1 << 30)))
    shown = ranked.orderBy("__fixed", F.col("total").desc(), "series").limit(k)
    whole = totals.agg(F.struct(F.count(F.lit(1)).alias("series"), F.sum("total").alias("total")).alias("w"))
    # at most k rows from here on
    w = Window.orderBy("__fixed", F.col("total").desc(), "series")
    everything = Window.partitionBy(F.lit(1))
    return (shown.withColumns({
        "place": F.row_number().over(w), "__w": whole.scalar(),
        "__k": F.count(F.lit(1)).over(everything), "__t": F.sum("total").over(everything)})
        .select("series", "place", "total", (F.col("__w.series") - F.col("__k")).alias("hidden"),
                (F.col("__w.total") - F.col("__t")).alias("hidden_n")))


def trend_cube(df: DataFrame, group: Column, as_of: Column, months=24, k=vocab.MAX_SERIES,
               order: Sequence[str] | None = None) -> DataFrame:
    """The shown series, gap filled: what a trend request returns."""
    cube = stored(cells(df, group, as_of, months), "cube")
    shown = top_series(cube, k, order)
    return fill(cube).join(shown, "series")


def point(metric: str, min_n: int) -> Column:
    """The metric where enough listings support it (counts are never suppressed)."""
    return F.col("n") if metric == "n" else F.when(F.col("n") >= min_n, F.col(metric))


def suppress(cube: DataFrame, metric: str, min_n: int, name="value") -> DataFrame:
    return cube.withColumn(name, point(metric, min_n))


def _by_month():
    return Window.partitionBy("series").orderBy("month")


def smooth(cube: DataFrame, k: int, value="value", name="smoothed") -> DataFrame:
    """Centred moving average that skips gaps and leaves gaps as gaps."""
    if k < 2:
        return cube.withColumn(name, F.col(value))
    half = k // 2
    mean = F.avg(value).over(_by_month().rowsBetween(-half, half))
    return cube.withColumn(name, F.when(F.col(value).isNotNull(), mean))


def mom(cube: DataFrame, metric: str, min_n: int, name="mom_pct") -> DataFrame:
    """Change against the previous calendar month when both are supported."""
    now = F.when(F.col("n") >= min_n, F.col(metric))
    before = F.lag(now).over(_by_month())
    return cube.withColumn(name, F.when((now != 0) & (before != 0), (now - before) * 100.0 / before))


def kpis(cube: DataFrame, metric: str, min_n: int) -> DataFrame:
    """Last supported value and its change over 3 and 12 months and the whole span, with the slope."""
    def change(base):
        return F.try_divide((F.col("value") - base) * 100.0, base)
    w = _by_month()
    rows = cube.withColumn("value", point(metric, min_n)).withColumns({
        "__i": F.row_number().over(w) - 1, "__b3": F.lag("value", 3).over(w), "__b12": F.lag("value", 12).over(w)})
    last = F.max_by(F.struct("month", "n", "value", change(F.col("__b3")).alias("d3"),
                             change(F.col("__b12")).alias("d12")),
                    F.when(F.col("value").isNotNull(), F.col("__i")))
    first = F.min_by("value", F.when(F.col("value").isNotNull(), F.col("__i")))
    got = rows.groupBy("series").agg(last.alias("l"), first.alias("f"), _slope("value").alias("slope_pct"))
    span = F.try_divide((F.col("l.value") - F.col("f")) * 100.0, F.col("f"))
    return got.where(F.col("l.value").isNotNull()).select(
        "series", F.col("l.month").alias("month"), F.col("l.n").alias("n"), F.col("l.value").alias("value"),
        F.col("l.d3").alias("d3"), F.col("l.d12").alias("d12"), span.alias("span"), "slope_pct")


def _slope(value: str) -> Column:
    v = F.col(value).cast("double")
    return F.when(F.count(v) >= 3, F.try_divide(
        F.regr_slope(v, F.when(v.isNotNull(), F.col("__i").cast("double"))), F.avg(v)) * 100.0)


def slope(cube: DataFrame, metric: str, min_n: int) -> DataFrame:
    """Least-squares change per month in percent of the mean; NULL below three points."""
    rows = cube.withColumn("value", point(metric, min_n)).withColumn("__i", F.row_number().over(_by_month()) - 1)
    return rows.groupBy("series").agg(F.count("value").alias("points"), _slope("value").alias("slope_pct"))


def pivot(cube: DataFrame, metric: str, min_n: int, series: Sequence[str]) -> DataFrame:
    """Months as rows, the named series as columns, with the count over all series."""
    rows = cube.withColumn("value", point(metric, min_n))
    return rows.groupBy("month").agg(
        *[F.max(F.when(F.col("series") == s, F.col("value"))).alias(s) for s in series],
        F.sum("n").alias("total"))


def monthly_report(df: DataFrame, as_of: Column, months=12, min_n=5) -> DataFrame:
    """Supported months of the whole market, active and gone listings together."""
    cube = fill(stored(cells(df, F.lit(vocab.ALL_LISTINGS), as_of, months), "cube"))
    return (cube.where((F.col("n") >= min_n) & (F.col("med_ppm") != 0))
            .select("month", "med_ppm", "med_price", "n"))
