"""Registry of named queries, their SQL twins and the common output form."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame, digits=4) -> DataFrame:
    """Output form shared with the SQL twins: bigint, rounded double or text only."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = c.cast("double") if digits is None else F.round(c.cast("double"), digits)
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, digits=4):
    """Register a query under its name together with the SQL that must give the same rows.

    ``digits`` is the number of decimals both sides print. Quotients such as price / 16 end
    exactly on a half at four decimals, where engines round differently; those print eight. None prints doubles as they are.
    """
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: present(fn(spark, sf_dir), digits)
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap
