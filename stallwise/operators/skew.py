"""Group operators that stay balanced when one group holds much of the data.

Ranks and quantiles inside a group are found by a histogram, not by collecting the group:
values are counted per (group, bucket) with map-side partial aggregation, the small histogram
is accumulated, and only the buckets that hold a wanted rank are looked at value by value.
A bucket spans about 1/8192 of an e-fold, so even a huge group is spread over thousands of them.

The wanted buckets (a few rows per group) are written to the work folder before the second pass.
Spark then plans that join with their true size: a broadcast below
``spark.sql.autoBroadcastJoinThreshold``, so that the data is only scanned and filtered, and a
shuffled join on (group, bucket) above it.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from stallwise.sources.sinks import stored

BUCKETS_PER_E_FOLD = 8192.0


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how="inner") -> DataFrame:
    """Equi join in which NULL keys match each other; the keys appear once."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def value_bucket(v: Column) -> Column:
    """A non-decreasing map from values to buckets of constant relative width; NaN comes last, as it sorts."""
    return (F.when(F.isnan(v), F.lit(2**63 - 1))
            .otherwise(F.floor(F.signum(v) * F.log1p(F.abs(v)) * F.lit(BUCKETS_PER_E_FOLD))))


def _group(keys: Sequence[str]):
    return Window.partitionBy(*(keys or [F.lit(1)]))


def _before(window, order: str):
    return window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _histogram(src: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = src.groupBy(*keys, "__b").agg(F.sum("__w").alias("__c"))
    w = _group(keys)
    return counts.select(
        *keys, "__b", "__c",
        F.coalesce(F.sum("__c").over(_before(w, "__b")), F.lit(0)).alias("__before"),
        F.sum("__c").over(w).alias("__n"))


def pick_ranks(df: DataFrame, keys: Sequence[str], value, picks: Mapping[str, Callable[[Column], Column]],
               *, weight=None, count_as: str = "n", store=False) -> DataFrame:
    """Exact values at given 0-based ranks of every group.

    ``picks`` maps an output column to a function from the group size to the wanted rank.
    ``weight`` counts a row several times. NULL and NaN values are not part of a group.
    The values are read twice; ``store`` writes the slim (group, value) rows first, which pays
    when they come out of a join rather than a scan.
    """
    keys = list(keys)
    v = _col(value).cast("double")
    w = (F.lit(1) if weight is None else _col(weight)).cast("bigint")
    src = (df.select(*keys, v.alias("__v"), w.alias("__w"))
           .where(F.col("__v").isNotNull() & ~F.isnan("__v")))
    if store:
        src = stored(src, "values")
    src = src.withColumn("__b", value_bucket(F.col("__v")))
    hist = _histogram(src, keys)
    names = list(picks)
    inside = []
    for name in names:
        rank = picks[name](F.col("__n")).cast("bigint")
        offset = rank - F.col("__before")
        inside.append(F.when((offset >= 0) & (offset < F.col("__c")), offset).alias(f"__k_{name}"))
    targets = (hist.select(*keys, "__b", "__n", *inside)
               .where(F.coalesce(*[F.col(f"__k_{n}") for n in names]).isNotNull()))
    targets = stored(targets, "ranks")
    wanted = null_safe_join(src, targets, keys + ["__b"])
    runs = (wanted.groupBy(*keys, "__b", "__n", *[f"__k_{n}" for n in names], "__v")
            .agg(F.sum("__w").alias("__c")))
    upto = F.coalesce(F.sum("__c").over(_before(_group(keys + ["__b"]), "__v")), F.lit(0))
    placed = runs.withColumn("__before", upto)
    found = [F.max(F.when((F.col(f"__k_{n}") >= F.col("__before"))
                          & (F.col(f"__k_{n}") < F.col("__before") + F.col("__c")), F.col("__v"))).alias(n)
             for n in names]
    out = placed.groupBy(*keys).agg(F.max("__n").alias(count_as), *found)
    return out if keys else out.where(F.col(count_as).isNotNull())


def group_quantiles(df: DataFrame, keys: Sequence[str], value, probs: Mapping[str, float],
                    *, weight=None, count_as: str = "n", extremes=False, store=False) -> DataFrame:
    """Exact interpolated quantiles of every group: value at q*(n-1), linear between neighbours."""
    picks: dict[str, Callable[[Column], Column]] = {}
    for name, q in probs.items():
        def low(n, q=q):
            return F.floor(F.lit(float(q)) * (n - 1))

        def high(n, q=q):
            return F.ceil(F.lit(float(q)) * (n - 1))
        picks[f"{name}__lo"], picks[f"{name}__hi"] = low, high
    if extremes:
        picks["min"], picks["max"] = (lambda n: n * 0), (lambda n: n - 1)
    got = pick_ranks(df, keys, value, picks, weight=weight, count_as=count_as, store=store)
    cols = []
    for name, q in probs.items():
        lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        pos = F.lit(float(q)) * (F.col(count_as) - 1)
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    extra = ["min", "max"] if extremes else []
    return got.select(*keys, count_as, *extra, *cols)


def _tie_cut(df: DataFrame, name: str) -> Column:
    """A non-decreasing map from a tie column to coarser pieces: by bucket for numbers, by beginning for text."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return value_bucket(F.col(name).cast("double"))
    if isinstance(kind, T.StringType):
        return F.substring(name, 1, 6)
    return F.col(name)


def group_rank(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str],
               *, rank_as="rn", count_as="cnt") -> DataFrame:
    """Every row with its 1-based rank and group size, without ordering a whole group in one task.

    Rows are ordered only among rows of the same group, value and piece of the first tie column, which may
    have any orderable type. What lies below comes from counts: of lower buckets in the group, and of
    lower values and pieces in the bucket. NULL values rank first, NaN last, as Spark sorts them.
    """
    keys = list(keys)
    at = keys + ["__b"]
    unit = at + ["__v", "__t"]
    src = df.withColumn("__v", F.col(value).cast("double")).withColumn("__b", value_bucket(F.col("__v")))
    src = src.withColumn("__t", _tie_cut(df, ties[0]))
    cuts = src.groupBy(*unit).agg(F.count(F.lit(1)).alias("__w"))
    lower = _group(at).orderBy("__v", "__t").rowsBetween(Window.unboundedPreceding, -1)
    inner = cuts.withColumn("__inner", F.coalesce(F.sum("__w").over(lower), F.lit(0))).drop("__w")
    places = null_safe_join(inner, _histogram(cuts, keys), at)
    local = F.row_number().over(_group(unit).orderBy(value, *ties))
    return null_safe_join(src, places, unit).select(
        *df.columns, (F.col("__before") + F.col("__inner") + local).cast("bigint").alias(rank_as), F.col("__n").alias(count_as))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of every key; rows are cut to one per key before the shuffle."""
    return top_per_key(df, keys, order, 1).drop("__rn")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """At most ``k`` rows of every key with their position ``__rn``.

    A row_number filter with a constant bound is pushed below the shuffle by Spark
    (WindowGroupLimit), so a hot key sends only ``k`` rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
