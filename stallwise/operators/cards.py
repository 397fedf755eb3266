"""Entity-attribute-value cards: from nested groups of controls to flat, typed rows."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stallwise import vocab
from stallwise.functions import maps, payload, text


def eav_pivot(df: DataFrame, entity: Sequence[str], attr: str, value: str, position, attrs: Mapping) -> DataFrame:
    """One row per entity with one column per wanted attribute; the last value of an attribute wins.

    A fixed attribute list makes this a partially aggregated max_by per column, with no collecting.
    """
    position = F.col(position) if isinstance(position, str) else position
    return df.groupBy(*entity).agg(*[
        F.max_by(value, F.when(F.col(attr) == F.lit(a), position)).alias(name) for a, name in attrs.items()])


def attribute_map(df: DataFrame, entity: Sequence[str], label: str, value: str, position,
                  renames: Mapping[str, str] = vocab.DISTRICT_RENAMES, renamed_label=vocab.DISTRICT_FEATURE) -> DataFrame:
    """Label to text map of every entity: empty labels dropped, last value wins, renames applied.

    Values are reduced to one per label before they are collected, so a map is bounded by the
    attribute vocabulary.
    """
    position = F.col(position) if isinstance(position, str) else position
    last = (df.where(F.coalesce(F.col(label), F.lit("")) != "").groupBy(*entity, F.col(label).alias("__l"))
            .agg(F.max_by(value, position).alias("__v")))
    fixed = F.when(F.col("__l") == renamed_label, text.renamed(F.col("__v"), renames)).otherwise(F.col("__v"))
    return last.groupBy(*entity).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("__l"), fixed.alias("__v")))).alias("features"))


def card_items(cards: DataFrame, id="id", groups="groups") -> DataFrame:
    """Every control of every group with its position, raw value and readable text."""
    grouped = cards.select(id, F.posexplode(groups).alias("__g", "__group"))
    items = grouped.select(id, "__g", F.col("__group.title").alias("group"),
                           F.posexplode("__group.controls").alias("__c", "__control"))
    value = F.col("__control.feature.value")
    return items.select(
        id, F.struct("__g", "__c").alias("position"), "group",
        F.coalesce("__control.title", F.lit("")).alias("title"), F.col("__control.feature.id").alias("feature_id"),
        F.col("__control.feature.type").alias("type"), value.alias("value"), payload.feature_text(value).alias("text"))


def owner_columns(owner: str = "owner") -> dict[str, Column]:
    """Flat owner columns with the derived marks."""
    o = F.col(owner)
    business = F.coalesce(o["business"]["id"].cast("string"), F.lit(""))
    return {
        "owner_login": F.coalesce(o["login"], F.lit("")),
        "owner_id": F.coalesce(o["id"].cast("string"), F.lit("")),
        "owner_registered": F.coalesce(o["createdDate"], F.lit("")),
        "owner_is_business": ~business.isin("", "0"),
        "owner_verified": F.coalesce(o["verification"]["isVerified"], F.lit(False)),
        "owner_deleted": F.coalesce(o["isDeleted"], F.lit(False)),
    }


def _with_controls(cards: DataFrame, groups="groups") -> DataFrame:
    """Cards with the numbers, titles, values and texts of all their controls in order, as arrays of equal length."""
    flat = cards.withColumn("__controls", F.flatten(F.col(f"{groups}.controls")))

    def each(path, kind):
        return F.coalesce(F.col(f"__controls.{path}"), F.array().cast(f"array<{kind}>"))
    items = flat.withColumns({"__ids": each("feature.id", "int"), "__titles": each("title", "string"), "__values": each("feature.value", "string")})
    return payload.feature_texts(items, "__texts", "__values").drop("__controls")


#: Features whose keys become columns of their own.
_KEYED = ("price", "old_price", "area", "map", "body", "contacts")


def parse_cards(cards: DataFrame, media_base="", media_size="900x900") -> DataFrame:
    """Raw cards (schema ``sources.listings.CARD``) to one text row per card with its attribute map.

    A card carries all its controls, so everything happens inside the row: nothing is exploded or
    shuffled, and a value with several columns is parsed once for all of them. Spark compiles all but lambdas, so
    those are kept to what needs them. Attribute tables that span rows go through ``eav_pivot`` and ``attribute_map``.
    """
    items = _with_controls(cards)
    entries = F.arrays_zip(F.col("__titles").alias("label"), F.col("__texts").alias("value"))
    joined = maps.with_last_wins(items, "features", F.filter(entries, lambda e: e["label"] != ""))
    place = F.col("features")[vocab.DISTRICT_FEATURE]
    joined = joined.withColumn("features", F.when(place.isin(*vocab.DISTRICT_RENAMES), text.renamed_in_map("features")).otherwise(F.col("features")))
    # the last control of each wanted number, found from the end
    joined = joined.withColumn("__numbers", F.reverse("__ids"))
    joined = joined.withColumns({
        f"n_{name}": F.size("__ids") - F.nullif(F.array_position("__numbers", F.lit(fid)), F.lit(0)).cast("int")
        for fid, name in vocab.FEATURE_IDS.items()})
    joined = joined.withColumns({f"f_{name}": F.get("__values", F.col(f"n_{name}")) for name in vocab.FEATURE_IDS.values()})
    joined = joined.withColumns({f"r_{name}": payload.parsed_object(f"f_{name}") for name in _KEYED})

    def read(name):
        return payload.read_parts(f"f_{name}", f"r_{name}")

    def raw(name):
        return F.col(f"f_{name}")

    def shown(name):
        return F.coalesce(F.get("__texts", F.col(f"n_{name}")), F.lit(""))

    def part(name, key, kind="string"):
        return payload.key_of(read(name), key, kind)
    photos = F.coalesce(F.from_json(raw("photos"), "array<string>"), F.array().cast("array<string>"))
    phones = F.coalesce(part("contacts", "phone_numbers", "array<string>"), F.array().cast("array<string>"))
    sub = F.col("subCategory")
    base = (
        F.col("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("state", F.lit("")).alias("state"),
        F.col("isExpired").alias("is_expired"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("posted", "reseted", "expire")],
        F.col("views.total").alias("views_total"), F.col("views.today").alias("views_today"),
        F.col("views.sinceRepublish").alias("views_since_republish"),
        text.breadcrumb(sub["parent"]["parent"]["title"]["translated"], sub["parent"]["title"]["translated"],
                        sub["title"]["translated"]).alias("category"),
        F.coalesce(sub["title"]["translated"], F.lit("")).alias("subcategory"), sub["id"].alias("subcategory_id"),
        *[c.alias(n) for n, c in owner_columns().items()],
        F.coalesce(F.col("owner.business.plan"), F.lit("")).alias("owner_business_plan"))
    plain = [n for n in ("offer_type", "author_type", "rooms", "floor", "floors_total", "housing_stock", "living_room",
                         "developer", "region", "city", "street", "house")]
    return joined.select(
        *base, *[shown(n).alias(n) for n in plain], text.renamed(shown("district")).alias("district"),
        payload.amount_of(read("price")).alias("price"), payload.unit_label(payload.unit_of(read("price"))).alias("currency"),
        part("price", "bargain").alias("bargain"),
        payload.amount_of(read("old_price")).alias("old_price"),
        payload.unit_label(payload.unit_of(read("old_price"))).alias("old_currency"),
        F.nullif(payload.amount_text_of(read("area")), F.lit("")).alias("area"),
        payload.unit_label(payload.unit_of(read("area"))).alias("area_unit"),
        raw("price_per_m2").alias("price_per_m2"),
        part("map", "lat").try_cast("double").alias("lat"), part("map", "lon").try_cast("double").alias("lon"),
        F.coalesce(part("body", "translated"), F.when(F.substring(F.ltrim(raw("body")), 1, 1) != "{", raw("body")),
                   F.lit("")).alias("description"),
        phones.alias("phones"), text.media_urls(photos, media_base, media_size).alias("photos"),
        "features")


def typed_details(cards: DataFrame, fetched_at: Column) -> DataFrame:
    """Text cards to the typed details table."""
    return cards.select(
        "id", fetched_at.alias("fetched_at"), "state", "posted", "reseted", "expire", "views_total", "views_today",
        "offer_type", "author_type", "rooms", text.rooms_number("rooms").alias("rooms_n"),
        text.first_number("area").alias("area"), "area_unit", text.first_int("floor").alias("floor"),
        text.first_int("floors_total").alias("floors_total"), "housing_stock", "living_room", "developer",
        text.first_number("price_per_m2").alias("price_per_m2"), "region", "city", "district", "street", "house",
        "owner_login", "owner_id", "owner_registered", "owner_is_business", "owner_verified",
        F.array_join("phones", ", ").alias("phones"), "photos", F.size("photos").alias("photos_count"), "description",
        "features", text.contains_any(F.concat_ws(" ", "description", "title")).alias("terms_flag"))


def export_rows(cards: DataFrame, url_prefix="") -> DataFrame:
    """Cards as flat export rows: joined lists, areas with their unit, booleans as True and False."""
    area = F.when(F.col("area").isNotNull(), F.trim(F.concat_ws(" ", "area", "area_unit"))).otherwise("")
    out = cards.withColumns({
        "url": F.concat(F.lit(url_prefix), F.col("id").cast("string")), "area": area,
        "bargain": F.initcap("bargain"), "is_expired": F.initcap(F.col("is_expired").cast("string")),
        "photos_count": F.size("photos"), "phones": F.array_join("phones", ", "),
        "photos": F.array_join("photos", " ")})
    return out.select(*vocab.CARD_EXPORT)
