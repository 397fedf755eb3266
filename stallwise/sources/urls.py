"""Filter requests written as URL query strings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallwise import vocab


def url_params(df: DataFrame, url: str) -> DataFrame:
    """One row per query parameter in order, percent-decoded."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")

    def decoded(c: Column) -> Column:
        return F.coalesce(F.try_url_decode(c), c)
    exploded = df.select("*", F.posexplode(pairs).alias("param", "__p"))
    cut = F.locate("=", F.col("__p"))
    key = F.when(cut > 0, F.substr("__p", F.lit(1), cut - 1)).otherwise(F.col("__p"))
    value = F.when(cut > 0, F.substr("__p", cut + 1)).otherwise(F.lit(""))
    return exploded.withColumns({"key": decoded(key), "value": decoded(value)}).drop("__p")


def _number(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("bigint")


def request_heads(params: DataFrame, id: str) -> DataFrame:
    """Category and sub-category of every request, with their defaults."""
    def last(*names):
        return F.max_by("value", F.when(F.col("key").isin(*names), F.col("param")))
    return params.groupBy(id).agg(
        F.coalesce(_number(last("cat", "category", "categoryId")), F.lit(vocab.DEFAULT_CATEGORY)).alias("category"),
        _number(last("spec")).alias("spec"))


def filter_rows(params: DataFrame, id: str) -> DataFrame:
    """Filter features of every request: option lists, or ranges with bounds and unit.

    Lists are bounded by the length of one URL.
    """
    is_option = F.col("key").rlike(vocab.URL_OPTION)
    is_range = F.col("key").rlike(vocab.URL_RANGE)
    kind = F.regexp_extract("key", vocab.URL_RANGE, 1)
    tagged = params.where(is_option | is_range).select(
        id, "param", "value", F.when(is_option, "option").otherwise(kind).alias("kind"),
        F.when(is_option, "options").otherwise("range").alias("form"),
        _number(F.when(is_option, F.regexp_extract("key", vocab.URL_OPTION, 1)).otherwise(F.regexp_extract("key", vocab.URL_RANGE, 2))).alias("filter_id"),
        _number(F.when(is_option, F.regexp_extract("key", vocab.URL_OPTION, 2)).otherwise(F.regexp_extract("key", vocab.URL_RANGE, 3))).alias("feature_id"))

    def last(name):
        return F.max_by("value", F.when(F.col("kind") == name, F.col("param")))
    options = F.collect_list(F.when(F.col("kind") == "option", F.struct("param", _number(F.col("value")).alias("v"))))
    got = tagged.groupBy(id, "filter_id", "feature_id", "form").agg(
        F.transform(F.array_sort(options), lambda o: o["v"]).alias("option_ids"),
        last("from").alias("min"), last("to").alias("max"), F.upper(last("unit")).alias("__u"))
    return got.withColumn("unit", F.concat(F.lit(vocab.UNIT_PREFIX), F.col("__u"))).drop("__u")


def filter_specs(df: DataFrame, id: str, url: str) -> tuple[DataFrame, DataFrame]:
    """(heads, filters) of a column of request URLs."""
    params = url_params(df.select(id, url), url)
    return df.select(id).join(request_heads(params, id), id, "left").fillna(
        vocab.DEFAULT_CATEGORY, ["category"]), filter_rows(params, id)
