"""Sorted pages and small top lists."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SORT_COLUMNS = {
    "posted": "posted", "first_seen": "first_seen", "price": "price", "ppm": "ppm", "area": "area",
    "drop_abs": "drop_abs", "drop_pct": "drop_pct", "views": "views_total",
    "changed": "price_changed_at", "discount": "discount",
}


def sort_page(df: DataFrame, key="posted", direction="desc", limit=100, offset=0, id="id") -> DataFrame:
    """One page in sort order: NULLs last both ways, then id descending as text."""
    c = F.col(SORT_COLUMNS.get(key, "posted"))
    order = c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last()
    page = df.orderBy(order, F.col(id).cast("string").desc())
    if offset > 0:
        page = page.offset(int(offset))
    return page.limit(max(1, int(limit)))


def page_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def latest_runs(runs: DataFrame, k=12) -> DataFrame:
    return runs.orderBy(F.col("run").desc(), F.col("profile").desc()).limit(k)
