"""Keyed updates of stored tables, expressed as joins between the base and a delta."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from stallwise.operators.skew import first_per_key


def keyed_upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str] = ("id",),
                 order: Sequence | None = None) -> DataFrame:
    """Insert or replace whole rows by key; ``order`` puts the row to keep of the delta first."""
    if order:
        delta = first_per_key(delta, keys, order)
    return base.join(delta.select(*keys), list(keys), "left_anti").unionByName(delta.select(*base.columns))


def partial_upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str] = ("id",),
                   defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Update only the fields the delta provides; new keys get defaults for the rest."""
    defaults = defaults or {}
    keys = list(keys)
    fields = [c for c in base.columns if c not in keys]
    given = [c for c in fields if c in delta.columns]
    new = delta.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in given])
    joined = base.join(new, keys, "full")
    out = []
    for c in fields:
        options = ([F.col(f"__new_{c}")] if c in given else []) + [F.col(c)]
        if c in defaults:
            options.append(F.lit(defaults[c]))
        out.append(F.coalesce(*options).alias(c))
    return joined.select(*keys, *out)


def replace_children(base: DataFrame, delta: DataFrame, parent: Sequence[str],
                     refreshed: DataFrame | None = None) -> DataFrame:
    """Swap all child rows of every refreshed parent; ``refreshed`` may list parents without children."""
    parents = (delta if refreshed is None else refreshed).select(*parent).distinct()
    return base.join(parents, list(parent), "left_anti").unionByName(delta.select(*base.columns))
