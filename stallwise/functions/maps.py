"""Maps built from label and value arrays."""
from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F


def bind(expression: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of an expression that is computed once, wherever it stands: inside a lambda nothing else shares it."""
    return F.transform(F.array(expression), use)[0]


def lookup(entries: Mapping[str, str], size: int = 4096) -> Callable[[Column], Column]:
    """A function from a text column to the entry of that name, or NULL.

    Map values of Spark are found by scanning the keys. Here the entries are dealt to an array of short lists by
    the checksum of their names, so a name meets the few entries that share its place.
    """
    places: list[list[dict[str, str]]] = [[] for _ in range(size)]
    for name, value in entries.items():
        places[zlib.crc32(name.encode()) % size].append({"n": name, "v": value})
    table = F.from_json(F.lit(json.dumps(places)), "array<array<struct<n:string,v:string>>>")

    def find(name: Column) -> Column:
        place = F.get(table, (F.crc32(name) % size).cast("int"))
        return F.get(F.filter(place, lambda e: e["n"] == name), F.lit(0))["v"]
    return find


def with_last_wins(df: DataFrame, name: str, pairs: Column) -> DataFrame:
    """Add a map of an array of (label, value) structs; of equal labels the last one counts.

    Earlier duplicates are removed before the map is built, so the result does not depend on
    session settings; only labels that stand more than once are looked for. What a lambda reads becomes a column
    first, used twice: an expression inside a lambda would be computed again for every element.
    """
    staged = df.withColumn("__pairs", pairs)
    staged = staged.withColumn("__labels", F.reverse("__pairs.label"))
    staged = staged.withColumn("__sorted", F.sort_array("__labels"))
    staged = staged.withColumn("__again", F.filter("__sorted", lambda l, i: l == F.get("__sorted", i + 1)))
    labels, again = F.col("__labels"), F.col("__again")

    def last(p, i):
        return ~F.array_contains(again, p["label"]) | (F.array_position(labels, p["label"]) == F.size(labels) - i)
    kept = (F.when(F.size(again) == 0, F.filter("__pairs", lambda p: p["label"].isNotNull()))
            .otherwise(F.filter("__pairs", lambda p, i: p["label"].isNotNull() & last(p, i))))
    staged = staged.withColumn("__kept", kept)
    return (staged.withColumn(name, F.map_from_arrays("__kept.label", "__kept.value"))
            .drop("__pairs", "__labels", "__sorted", "__again", "__kept"))


def as_text(m: Column, sep="|") -> Column:
    """The entries of a string map in key order as "key=value" text."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), sep)
