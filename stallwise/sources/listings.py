"""Raw listing payloads: schemas, readers and flattening."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.functions import payload

# polymorphic values stay JSON text and are read by functions.payload
LISTING = """id string, title string, price struct<id:int,value:string>, oldPrice struct<id:int,value:string>,
  street struct<id:int,value:string>, mapPoint struct<id:int,value:struct<lat:double,lon:double>>,
  subCategory struct<id:int,title:struct<translated:string>>"""

_TITLE = "title:struct<translated:string>"
CARD = f"""id string, state string, title string, isExpired boolean, posted string, reseted string, expire string,
  subCategory struct<id:int,{_TITLE},parent:struct<id:int,{_TITLE},parent:struct<id:int,{_TITLE}>>>,
  owner struct<id:string,login:string,avatar:string,createdDate:string,
    business:struct<id:string,plan:string,marketplace:string,hasDelivery:boolean>,
    verification:struct<isVerified:boolean,date:string>,isDeleted:boolean>,
  groups array<struct<title:string,controls:array<struct<type:string,title:string,
    feature:struct<id:int,type:string,value:string>>>>>,
  views struct<total:int,today:int,sinceRepublish:int>"""


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of listing payloads, one per line, with a fixed schema (no inference pass)."""
    return spark.read.schema(LISTING).json(path)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CARD).json(path)


def flatten_listings(raw: DataFrame, url_prefix="") -> DataFrame:
    """Nested payloads to flat export rows."""
    def blank(c):
        return F.coalesce(F.col(c), F.lit(""))
    price, old = F.col("price.value"), F.col("oldPrice.value")
    return raw.select(
        blank("id").alias("id"), blank("title").alias("title"),
        payload.money_text(price).alias("price"), payload.money_unit(price).alias("currency"),
        payload.money_text(old).alias("old_price"), payload.money_unit(old).alias("old_currency"),
        blank("street.value").alias("street"), blank("subCategory.title.translated").alias("subcategory"),
        F.col("mapPoint.value.lat").alias("lat"), F.col("mapPoint.value.lon").alias("lon"),
        F.concat(F.lit(url_prefix), blank("id")).alias("url"))


def snapshot_rows(raw: DataFrame, profile: str, run) -> DataFrame:
    """Nested payloads to snapshot rows with numeric prices, as the change tracking takes them."""
    price, old = F.col("price.value"), F.col("oldPrice.value")
    return raw.select(
        F.lit(profile).alias("profile"), "id", F.lit(run).alias("run"),
        F.col("subCategory.id").alias("subcategory_id"),
        F.coalesce("subCategory.title.translated", F.lit("")).alias("subcategory"),
        F.coalesce("title", F.lit("")).alias("title"),
        payload.money_amount(price).alias("price"), payload.money_unit(price).alias("currency"),
        payload.money_amount(old).alias("old_price"), payload.money_unit(old).alias("old_currency"),
        F.coalesce("street.value", F.lit("")).alias("street"),
        F.col("mapPoint.value.lat").alias("lat"), F.col("mapPoint.value.lon").alias("lon"))
