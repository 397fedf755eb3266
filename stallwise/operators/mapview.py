"""Map layers: points, cells, colour breaks and the listings behind a cell."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions.geo import point_key
from stallwise.operators.skew import null_safe_join, pick_ranks, top_per_key
from stallwise.sources.sinks import stored

SHARES = (0.2, 0.4, 0.6, 0.8)


def located(df: DataFrame) -> DataFrame:
    return df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def map_points(df: DataFrame, limit=12000) -> DataFrame:
    """The first ``limit`` points in id-text order with the total and whether more exist.

    A map draws a bounded number of points; the caller sets it.
    """
    points = located(df)
    limit = max(1, int(limit))
    total = points.agg(F.count(F.lit(1)).alias("total"))
    page = points.orderBy(F.col("id").cast("string")).limit(limit)
    return page.withColumn("total", total.scalar()).withColumn("capped", F.col("total") > limit)


def cell(df: DataFrame, digits=5) -> DataFrame:
    return located(df).withColumn("cell", point_key("lat", "lon", digits))


def map_cells(df: DataFrame, value="value", favorite="favorite", digits=5) -> DataFrame:
    """Size, upper median of the value and favourite mark of every cell."""
    cells = cell(df, digits)
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(favorite).alias("fav"))
    medians = pick_ranks(cells, ["cell"], value, {"med": lambda n: F.floor(n / 2)}, count_as="n_value")
    return sizes.join(medians.select("cell", "med"), "cell", "left")


def layer_value(df: DataFrame, deals_tab: bool) -> DataFrame:
    """The value a layer is coloured by: discount on the deals tab, else unit price, else price."""
    def present(c):
        return F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(c)
    known = df.agg(F.struct(present("discount"), present("ppm")).alias("known"))
    marked = df.withColumn("__known", known.scalar())
    by_discount = F.lit(bool(deals_tab)) & F.col("__known.discount")
    value = (F.when(by_discount, F.col("discount")).when(F.col("__known.ppm"), F.col("ppm"))
             .otherwise(F.col("price")))
    return marked.withColumns({"value": value, "inverted": by_discount}).drop("__known")


def quintile_breaks(df: DataFrame, value="value") -> DataFrame:
    """One row with the four colour breaks: value at rank min(n-1, floor(n*share))."""
    picks = {f"b{i}": (lambda n, s=s: F.least(n - 1, F.floor(n * F.lit(s)))) for i, s in enumerate(SHARES, 1)}
    return pick_ranks(df, [], value, picks)


def colour_bucket(value, breaks=("b1", "b2", "b3", "b4"), inverted: Column | bool = False) -> Column:
    """0-4 by how many breaks the value reaches, mirrored for inverted layers; NULL without a value."""
    value = F.col(value) if isinstance(value, str) else value
    inverted = F.lit(inverted) if isinstance(inverted, bool) else inverted
    reached = sum((F.when(value >= F.col(b), 1).otherwise(0) for b in breaks), F.lit(0))
    return F.when(value.isNotNull(), F.when(inverted, 4 - reached).otherwise(reached))


def coloured_cells(df: DataFrame, deals_tab=False) -> DataFrame:
    slim = df.select("id", "lat", "lon", "price", "ppm", "discount", "favorite")
    layer = layer_value(stored(slim, "map-layer"), deals_tab)
    breaks = quintile_breaks(layer).select(F.struct("b1", "b2", "b3", "b4").alias("breaks"))
    inverted = layer.agg(F.coalesce(F.bool_or("inverted"), F.lit(False)).alias("inverted"))
    # both sides of the comparison are scalars of the whole layer, not joins
    return (map_cells(layer).withColumns({"breaks": breaks.scalar(), "inverted": inverted.scalar()})
            .withColumn("colour", colour_bucket(
                "med", tuple(f"breaks.b{i}" for i in range(1, 5)), inverted=F.col("inverted"))))


def cell_listings(df: DataFrame, k=25, digits=5) -> DataFrame:
    """The first ``k`` listings of every cell (the popup) and how many remain."""
    cells = cell(df, digits)
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    top = top_per_key(cells, ["cell"], [F.col("id").cast("string")], k)
    return (null_safe_join(top, sizes, ["cell"])
            .withColumn("remaining", F.greatest(F.col("n") - k, F.lit(0)))
            .withColumnRenamed("__rn", "place"))


def point_rollup(df: DataFrame, done: DataFrame, new_build: Column, refresh_before: Column | None = None) -> DataFrame:
    """Survey points of listings: distinct addresses, all-new mark and whether to survey again."""
    points = df.withColumn("point", point_key("lat", "lon")).withColumn("__new", F.coalesce(new_build, F.lit(False)))
    addresses = points.groupBy("point", F.coalesce("street", F.lit("")).alias("street"),
                               F.coalesce("house", F.lit("")).alias("house")).agg(
        F.count(F.lit(1)).alias("__n"), F.bool_and("__new").alias("__new"))
    rolled = addresses.groupBy("point").agg(
        F.sum("__n").alias("listings"), F.count(F.lit(1)).alias("addresses"), F.bool_and("__new").alias("all_new"))
    joined = rolled.join(done.select("point", "fetched_at"), "point", "left")
    todo = F.col("fetched_at").isNull()
    if refresh_before is not None:
        todo = todo | (F.col("fetched_at") < refresh_before)
    return joined.withColumn("todo", todo)
