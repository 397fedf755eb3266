"""Listing tables derived from the test tables: Spark views and the same views as SQL text."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise import vocab
from stallwise.functions.labels import as_ntz
from stallwise.operators.benchmark import active_pool, segment_median, with_benchmark
from stallwise.operators.filters import pool_rules
from stallwise.operators.joins import listing_view
from stallwise.operators.skew import first_per_key
from stallwise.sources.sinks import stored

AS_OF_TEXT = "2001-11-30 00:00:00"
AUTHORS = {"private": "N", "business": "A", "developer": "R"}
POOL = dict(min_area=1, price_floor=15000.0, ppm_range=(300.0, 12000.0), city=None)


def as_of():
    return as_ntz(AS_OF_TEXT)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ads(spark, sf) -> DataFrame:
    cust = F.col("o_custkey")
    changed = cust % 4 == 0
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(cust % 3 == 0, "apartments").when(cust % 3 == 1, "garages").otherwise("commercial").alias("profile"),
        F.col("o_orderpriority").alias("subcategory"),
        F.concat_ws(" ", "o_orderpriority", cust.cast("string")).alias("title"),
        price.alias("price"), F.lit("EUR").alias("currency"),
        F.when(cust % 7 == 0, price * 1.05).alias("old_price"),
        (F.lit(46.93) + (cust * 37 % 1000) * F.lit(0.00018)).alias("lat"),
        (F.lit(28.50) + (cust * 91 % 1000) * F.lit(0.00066)).alias("lon"),
        F.col("o_orderdate").alias("first_seen"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 60 days")).alias("gone_at"),
        F.when(changed, price * (F.lit(0.8) + (cust % 5) * F.lit(0.1))).alias("prev_price"),
        F.when(changed, F.col("o_orderdate") + F.expr("interval 30 days")).alias("price_changed_at"))


SQL_ADS = """ads AS (
  SELECT o_orderkey AS id,
    CASE o_custkey % 3 WHEN 0 THEN 'apartments' WHEN 1 THEN 'garages' ELSE 'commercial' END AS profile,
    o_orderpriority AS subcategory, o_orderpriority || ' ' || o_custkey AS title,
    o_totalprice AS price, 'EUR' AS currency,
    CASE WHEN o_custkey % 7 = 0 THEN o_totalprice * 1.05::double END AS old_price,
    46.93::double + (o_custkey * 37 % 1000) * 0.00018::double AS lat,
    28.50::double + (o_custkey * 91 % 1000) * 0.00066::double AS lon,
    o_orderdate AS first_seen,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 60 DAY END AS gone_at,
    CASE WHEN o_custkey % 4 = 0 THEN o_totalprice * (0.8::double + (o_custkey % 5) * 0.1::double) END AS prev_price,
    CASE WHEN o_custkey % 4 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS price_changed_at
  FROM orders)"""

PICK = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")


def details(spark, sf) -> DataFrame:
    """One details row per listing: the first line of its order."""
    lines = first_per_key(
        table(spark, sf, "lineitem").select("l_orderkey", *PICK, "l_linestatus", "l_returnflag"),
        ["l_orderkey"], [*PICK, "l_linestatus", "l_returnflag"])
    part, nation = table(spark, sf, "part"), table(spark, sf, "nation")
    joined = (lines.join(part, lines.l_partkey == part.p_partkey)
              .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
              .join(nation, F.col("s_nationkey") == nation.n_nationkey))
    size = F.col("p_size")
    f = vocab.FEATURE_NAMES
    a = vocab.AMENITIES
    features = F.create_map(
        F.lit(f["condition"]), F.col("p_type"), F.lit(f["building"]), F.col("p_brand"),
        F.lit(f["premise"]), F.col("p_type"),
        F.lit(a["lift"][0]), F.when(size > 25, "True").otherwise("False"),
        F.lit(a["parking"][0]), F.when(size > 40, F.col("p_brand")),
        F.lit(a["baths2"][0]), F.col("l_linenumber").cast("string"),
        F.lit(a["balcony"][0]), F.when(size > 10, F.col("p_type")).when(size > 5, "Нет"))
    return joined.select(
        F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("area"),
        F.col("l_linenumber").alias("floor"),
        F.when(F.col("l_partkey") % 11 != 0, 7).alias("floors_total"),
        F.when(size % 13 != 0, size % 6).alias("rooms_n"), F.col("n_name").alias("district"),
        F.col("l_linestatus").alias("housing_stock"),
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_returnflag")).alias("author_type"),
        (F.col("l_suppkey") % 3 == 0).alias("owner_is_business"), F.col("p_brand").alias("developer"),
        F.col("l_shipdate").alias("posted"), F.col("l_shipdate").alias("fetched_at"),
        F.when(size % 2 == 0, F.col("l_extendedprice") / F.col("l_quantity")).alias("price_per_m2"),
        F.col("l_partkey").alias("views_total"), (F.col("l_orderkey") % 10 == 0).alias("terms_flag"),
        (F.col("l_suppkey") % 4).alias("photos_count"), F.col("p_name").alias("street"),
        size.cast("string").alias("house"), features.alias("features"))


def sql_steps(column, steps):
    """Label of the first step whose upper edge exceeds the column, from (edge, label) pairs."""
    *inner, (_, last) = steps
    return "CASE " + " ".join(f"WHEN {column} < {edge} THEN '{label}'" for edge, label in inner) + f" ELSE '{last}' END"


SQL_FLOOR = (f"CASE (floor = 1) WHEN true THEN '{vocab.FLOOR_FIRST}' WHEN false THEN "
             f"if(coalesce(floor >= floors_total, false), '{vocab.FLOOR_LAST}', '{vocab.FLOOR_MIDDLE}') END")


SQL_DET = """det AS (
  SELECT l_orderkey AS id, l_quantity AS area, l_linenumber AS floor,
    CASE WHEN l_partkey % 11 <> 0 THEN 7 END AS floors_total,
    CASE WHEN p_size % 13 <> 0 THEN p_size % 6 END AS rooms_n, n_name AS district,
    l_linestatus AS housing_stock,
    CASE WHEN l_suppkey % 5 <> 0 THEN l_returnflag END AS author_type,
    (l_suppkey % 3 = 0)::int AS owner_is_business, p_brand AS developer,
    l_shipdate AS posted, l_shipdate AS fetched_at,
    CASE WHEN p_size % 2 = 0 THEN l_extendedprice / l_quantity END AS price_per_m2,
    l_partkey AS views_total, (l_orderkey % 10 = 0)::int AS terms_flag, l_suppkey % 4 AS photos_count,
    p_name AS street, p_size::varchar AS house,
    p_type AS f_condition, p_brand AS f_building,
    CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END AS f_lift,
    CASE WHEN p_size > 40 THEN p_brand END AS f_parking,
    l_linenumber::varchar AS f_baths,
    CASE WHEN p_size > 10 THEN p_type WHEN p_size > 5 THEN 'Нет' END AS f_balcony
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
          l_extendedprice, l_shipdate, l_quantity, l_linestatus, l_returnflag) AS pick FROM lineitem) l
  JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey
  WHERE pick = 1)"""


def flags(spark, sf) -> DataFrame:
    """User marks: urgent orders are favourites, pending low-priority ones are hidden."""
    o = table(spark, sf, "orders")
    fav, hid = F.col("o_orderpriority") == "1-URGENT", (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    return o.where(fav | hid).select(
        F.col("o_orderkey").alias("id"), fav.cast("int").alias("favorite"), hid.cast("int").alias("hidden"),
        F.when(fav, F.col("o_orderpriority")).otherwise("").alias("note"))


SQL_FLAGS = """flags AS (
  SELECT o_orderkey AS id, (o_orderpriority = '1-URGENT')::int AS favorite,
    (o_orderpriority = '5-LOW' AND o_orderstatus = 'P')::int AS hidden,
    CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority ELSE '' END AS note
  FROM orders WHERE o_orderpriority = '1-URGENT' OR (o_orderpriority = '5-LOW' AND o_orderstatus = 'P'))"""


def listings(spark, sf, with_flags=True) -> DataFrame:
    return listing_view(ads(spark, sf), details(spark, sf), flags(spark, sf) if with_flags else None)


_PPM = "coalesce(price_per_m2, CASE WHEN area > 0 THEN price / area END)"

SQL_LISTINGS = f"""listings AS (
  SELECT a.*, d.* EXCLUDE (id, terms_flag), coalesce(d.terms_flag, 0) AS terms_flag,
    coalesce(f.favorite, 0) AS favorite, coalesce(f.hidden, 0) AS hidden, coalesce(f.note, '') AS note,
    {_PPM} AS ppm, price - prev_price AS drop_abs,
    CASE WHEN prev_price > 0 THEN (price - prev_price) * 100 / prev_price END AS drop_pct
  FROM ads a LEFT JOIN det d ON d.id = a.id LEFT JOIN flags f ON f.id = a.id)"""


MEASURES = ("profile", "gone_at", "price", "area", "ppm", "district", "rooms_n", "housing_stock", "terms_flag")


def slim(spark, sf, *columns) -> DataFrame:
    """The listing view cut to what the benchmark and the caller need, stored.

    Benchmark queries read the view at least twice and it is a join of two large tables, so it is
    joined once and read back.
    """
    wanted = dict.fromkeys(["id", *MEASURES, *columns])
    return stored(listings(spark, sf).select(*wanted), "view")


def bench(view: DataFrame) -> DataFrame:
    """Benchmark of the active apartments of a stored view."""
    return stored(segment_median(view.where(active_pool()), pool=pool_rules(**POOL), store=False), "benchmark")


def priced(spark, sf, *columns) -> DataFrame:
    """The listing view with its benchmark columns."""
    view = slim(spark, sf, *columns)
    return with_benchmark(view, bench(view))


SQL_POOL = """pool AS (
  SELECT * FROM listings WHERE profile = 'apartments' AND gone_at IS NULL AND area >= 1 AND area <= 400
    AND price >= 15000 AND ppm BETWEEN 300 AND 12000 AND rooms_n IS NOT NULL AND housing_stock <> '')"""
SQL_BENCH = """bench AS (
  SELECT district, rooms_n, housing_stock, quantile_cont(ppm, 0.5) AS med_ppm, count(*) AS pool_n
  FROM pool GROUP BY ALL)"""
SQL_PRICED = """priced AS (
  SELECT l.*, b.med_ppm, b.pool_n, (b.med_ppm - ppm) * 100 / b.med_ppm AS discount,
    CASE WHEN b.pool_n >= 8 THEN (ppm - b.med_ppm) * 100 / b.med_ppm END AS vs_med,
    CASE WHEN b.pool_n >= 8 AND terms_flag = 0 AND ppm < b.med_ppm * 0.55::double THEN 1 ELSE 0 END AS suspect
  FROM listings l LEFT JOIN bench b ON b.district = l.district AND b.rooms_n = l.rooms_n
    AND b.housing_stock = l.housing_stock)"""

SQL_BASE = """base AS (
  SELECT profile, min(date_trunc('month', first_seen) + INTERVAL 1 MONTH) AS baseline FROM ads GROUP BY profile)"""


def runs(spark, sf) -> DataFrame:
    """Monthly collection runs per profile, finished at the end of the month."""
    month = F.date_trunc("month", F.col("first_seen")).cast("timestamp_ntz")
    return (ads(spark, sf).select("profile", (month + F.expr("interval 1 month")).alias("finished")).distinct())


def with_(*ctes: str, recursive=False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


W_ADS = with_(SQL_ADS)
W_LIST = with_(SQL_ADS, SQL_DET, SQL_FLAGS, SQL_LISTINGS)
W_BENCH = with_(SQL_ADS, SQL_DET, SQL_FLAGS, SQL_LISTINGS, SQL_POOL, SQL_BENCH)
W_PRICED = with_(SQL_ADS, SQL_DET, SQL_FLAGS, SQL_LISTINGS, SQL_POOL, SQL_BENCH, SQL_PRICED)
