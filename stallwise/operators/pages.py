"""Register pages: labelled fields inside marked HTML segments."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from stallwise import vocab
from stallwise.functions import address, maps, text


def html_segments(df: DataFrame, html: str, mark: str) -> DataFrame:
    """One row per marked segment: its number, the code captured by the mark, and its HTML.

    Text before the first mark belongs to no segment; pages without a mark give no rows.
    """
    # the outer form: from an inner one Spark derives a filter that splits every page again, several times over
    staged = df.withColumns({"__codes": F.regexp_extract_all(F.col(html), F.lit(mark), F.lit(1)), "__bodies": F.split(F.col(html), mark)})
    bodies = F.slice("__bodies", F.lit(2), F.greatest(F.size("__bodies") - 1, F.lit(0)))
    zipped = F.arrays_zip(F.col("__codes").alias("code"), bodies.alias("body"))
    return (staged.select(*df.columns, zipped.alias("__z")).select(*df.columns, F.posexplode_outer("__z").alias("segment", "__s"))
            .where(F.col("segment").isNotNull())
            .select(*df.columns, "segment", F.col("__s.code").alias("code"), F.col("__s.body").alias("body")))


def first_segment(df: DataFrame, html: str, mark: str) -> DataFrame:
    """The first marked segment of every page as ``html_segments`` gives it, without its number; later ones are not cut out."""
    staged = df.withColumn("__bodies", F.split(F.col(html), mark, 3)).where(F.size("__bodies") > 1)
    return staged.withColumns({"code": F.regexp_extract(html, mark, 1), "body": F.get("__bodies", F.lit(1))}).drop("__bodies")


def html_fields(df: DataFrame, body: str, field: str, known: Mapping[str, str]) -> DataFrame:
    """Labelled fields of a segment: known labels (by folded prefix) as columns, the rest as a map.

    The first field of a known column counts; repeats and unknown labels go to ``extras``.
    """
    def column(folded):
        key = F.lit(None).cast("string")
        for prefix, name in reversed(known.items()):
            key = F.when(folded.startswith(prefix), name).otherwise(key)
        return key
    # one column per step, so that nothing is computed once per output or per field; labels and values are cleaned together
    step = df.withColumns({"__labels": F.regexp_extract_all(F.col(body), F.lit(field), F.lit(1)),
                           "__values": F.regexp_extract_all(F.col(body), F.lit(field), F.lit(2))})
    step = text.html_clean_all(step.withColumn("__texts", F.concat("__labels", "__values")), "__clean", "__texts")
    size = F.size("__labels")
    step = step.withColumns({"__labels": F.slice("__clean", F.lit(1), size), "__values": F.slice("__clean", size + 1, size)})
    step = text.plain_all(step, "__plain", "__labels").withColumn("__keys", F.transform("__plain", column))

    def first(column):
        return F.get("__values", (F.nullif(F.array_position("__keys", F.lit(column)), F.lit(0)) - 1).cast("int"))
    pairs = F.arrays_zip(F.col("__labels").alias("label"), F.col("__values").alias("value"), F.col("__keys").alias("key"))
    spare = F.filter(pairs, lambda p, i: p["key"].isNull() | (F.array_position("__keys", p["key"]) != i + 1))
    named = step.withColumns({**{c: first(c) for c in dict.fromkeys(known.values())}, "__spare": spare})
    named = named.drop("__labels", "__values", "__texts", "__clean", "__plain", "__keys")
    return maps.with_last_wins(named, "extras", F.col("__spare")).drop("__spare")


def parse_buildings(pages: DataFrame, html="html", geometry="geometry") -> DataFrame:
    """Buildings of register pages: the first segment of every page."""
    updated = F.nullif(F.regexp_extract(html, vocab.REGISTER_UPDATED, 1), F.lit(""))
    first = first_segment(pages, html, vocab.REGISTER_MARK).withColumn("updated", updated)
    got = html_fields(first, "body", vocab.REGISTER_FIELD, vocab.BUILDING_LABELS)
    street, house = address.split_address("address")
    return got.select(
        "code", "address", street.alias("street"), house.alias("house"), "classifier",
        text.digits_only("year_built").alias("year_built"), text.digits_only("floors").alias("floors"), "condition",
        "walls", "gas", "water", "sewer", "electrified", text.digits_only("value_lei").alias("value_lei"), "updated",
        F.when(F.size("extras") > 0, F.col("extras")).alias("props"), geometry)


def parse_units(pages: DataFrame, html="html") -> DataFrame:
    """Units of register pages: the later segments, tied to the building of the first mark."""
    building = F.regexp_extract(html, vocab.REGISTER_MARK, 1)
    rest = html_segments(pages.withColumn("building", building), html, vocab.REGISTER_MARK).where(F.col("segment") > 0)
    got = html_fields(rest, "body", vocab.REGISTER_FIELD, vocab.UNIT_LABELS)
    answer = F.create_map(*[F.lit(x) for pair in vocab.YES_NO.items() for x in pair])
    return got.select(
        "code", "building", "address", address.apartment("address").alias("apt"),
        F.trim(F.replace("area", F.lit(","), F.lit("."))).try_cast("double").alias("area"), "kind",
        text.digits_only("floor").alias("floor"), "wc", "bath", answer[text.plain("last_floor")].alias("last_floor"),
        text.digits_only("value_lei").alias("value_lei"))
