"""Queries over payloads, cards, free text, HTML and URLs."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.registry import query
from stallwise import vocab
from stallwise.functions import maps, payload, text
from stallwise.operators import cards, filters, pages, privacy
from stallwise.session import work_dir
from stallwise.sources import listings, sinks, urls

DATA_PHONES = r"\+1 \(\d{3}\) 555-\d{4}"
A = b.W_ADS


# ---- payloads ----------------------------------------------------------------------------

def raw_listings(spark, sf):
    """Listing payloads as JSON text, parsed back with the payload schema."""
    ads = b.ads(spark, sf)
    old = F.when(F.col("old_price").isNotNull(), F.struct(F.lit(1640).alias("id"), F.struct(
        F.col("old_price").alias("value"), F.lit("UNIT_USD").alias("measurement")).alias("value")))
    nested = ads.select(F.to_json(F.struct(
        F.col("id").cast("string").alias("id"), "title",
        F.struct(F.lit(2).alias("id"), F.struct(F.col("price").alias("value"), F.lit("UNIT_EUR").alias("unit")).alias("value")).alias("price"),
        old.alias("oldPrice"), F.struct(F.lit(10).alias("id"), F.col("profile").alias("value")).alias("street"),
        F.struct(F.lit(3).alias("id"), F.struct("lat", "lon").alias("value")).alias("mapPoint"),
        F.struct(F.lit(1404).alias("id"), F.struct(F.col("subcategory").alias("translated")).alias("title")).alias("subCategory"),
    )).alias("json"))
    return nested.select(F.from_json("json", listings.LISTING).alias("r")).select("r.*")


_FLAT = """SELECT id::varchar AS id, title, price::varchar AS price, 'EUR' AS currency, coalesce(old_price::varchar, '') AS old_price,
  CASE WHEN old_price IS NOT NULL THEN 'USD' ELSE '' END AS old_currency, profile AS street, subcategory, round(lat, 4) AS lat,
  round(lon, 4) AS lon, 'https://listings.example/' || id AS url FROM ads"""


@query("flatten_listing", A + _FLAT)
def _(spark, sf):
    return listings.flatten_listings(raw_listings(spark, sf), "https://listings.example/").select(*vocab.LISTING_EXPORT)


@query("snapshot_rows", A + """SELECT 'apartments' AS profile, id::varchar AS id, 'r1' AS run, 1404 AS subcategory_id, subcategory, title, round(price, 4) AS price,
  'EUR' AS currency, round(old_price, 4) AS old_price, CASE WHEN old_price IS NOT NULL THEN 'USD' ELSE '' END AS old_currency,
  profile AS street, round(lat, 4) AS lat, round(lon, 4) AS lon FROM ads""")
def _(spark, sf):
    return listings.snapshot_rows(raw_listings(spark, sf), "apartments", "r1")


def money_values(spark, sf):
    """Money values of every shape: bare numbers, objects with either unit key, quoted text, other objects."""
    kind = F.col("event_type")
    value = (F.when(kind == "click", F.col("value").cast("string"))
             .when(kind == "view", F.to_json(F.struct("value", F.lit("UNIT_EUR").alias("unit"))))
             .when(kind == "purchase", F.to_json(F.struct("value", F.lit("UNIT_USD").alias("measurement"), F.lit(True).alias("bargain"))))
             .when(kind == "signup", F.to_json(F.struct(F.col("value").cast("string").alias("value"))))
             .otherwise(F.col("props")))
    return b.table(spark, sf, "events").select("event_id", value.alias("value"))


@query("money_parse", """SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN round(value, 4) END AS amount,
  CASE event_type WHEN 'view' THEN 'EUR' WHEN 'purchase' THEN 'USD' ELSE '' END AS unit FROM events""")
def _(spark, sf):
    return money_values(spark, sf).select("event_id", payload.money_amount("value").alias("amount"), payload.money_unit("value").alias("unit"))


@query("feature_text", """SELECT event_id, CASE event_type WHEN 'click' THEN value::varchar WHEN 'view' THEN value::varchar || ' EUR'
  WHEN 'purchase' THEN value::varchar || ' USD (торг)' WHEN 'signup' THEN value::varchar ELSE props END AS text FROM events""")
def _(spark, sf):
    shaped = money_values(spark, sf).select("event_id", payload.feature_text("value").alias("text"))
    # objects without a known key print as they are
    return shaped


@query("feature_text_shapes", """SELECT p_partkey, p_name AS translated, p_size || 'a, ' || p_size || 'b' AS phones, p_size || ', ' || p_partkey AS point,
  p_name || ', ' || p_brand AS listed, '' AS empty FROM part""")
def _(spark, sf):
    part = b.table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    phones = F.to_json(F.struct(F.array(F.concat(size, F.lit("a")), F.concat(size, F.lit("b"))).alias("phone_numbers")))
    point = F.to_json(F.struct(F.col("p_size").alias("lat"), F.col("p_partkey").alias("lon")))
    return part.select(
        "p_partkey", payload.feature_text(F.to_json(F.struct(F.col("p_name").alias("translated")))).alias("translated"),
        payload.feature_text(phones).alias("phones"), payload.feature_text(point).alias("point"),
        payload.feature_text(F.to_json(F.array("p_name", "p_brand"))).alias("listed"),
        payload.feature_text(F.when(F.col("p_size") > 25, "{}").otherwise("[]")).alias("empty"))


_UNIT_CODES = {"click": "UNIT_METER_SQUARE", "view": "UNIT_LEI", "purchase": "UNIT_GBP", "signup": "m3"}


@query("unit_normalise", """SELECT event_id, CASE event_type WHEN 'click' THEN 'm²' WHEN 'view' THEN 'MDL' WHEN 'purchase' THEN 'GBP' WHEN 'signup' THEN 'm3' ELSE '' END AS unit FROM events""")
def _(spark, sf):
    code = F.create_map(*[F.lit(x) for p in _UNIT_CODES.items() for x in p])[F.col("event_type")]
    return b.table(spark, sf, "events").select("event_id", payload.unit_label(code).alias("unit"))


# ---- cards -------------------------------------------------------------------------------

def raw_cards(spark, sf):
    """Cards in the payload schema, built from listings and details."""
    d = b.ads(spark, sf).join(b.details(spark, sf), "id")

    def control(fid, title, value):
        return F.struct(F.lit("text").alias("type"), F.lit(title).alias("title"), F.struct(
            F.lit(fid).alias("id"), F.lit("T").alias("type"), value.cast("string").alias("value")).alias("feature"))

    def translated(c):
        return F.to_json(F.struct(c.cast("string").alias("translated")))
    rooms = F.when(F.col("rooms_n") == 0, "Студия").when(F.col("rooms_n").isNotNull(), F.concat(F.col("rooms_n").cast("string"), F.lit(" rooms")))
    photos = F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest("photos_count", F.lit(1))),
                         lambda i: F.concat(F.col("id").cast("string"), F.lit("-"), i.cast("string"), F.lit(".jpg")))
    main = F.array(
        control(1, "Offer", translated(F.lit("Sell"))), control(241, "Rooms", translated(rooms)),
        control(244, "Area", F.to_json(F.struct(F.col("area").alias("value"), F.lit("UNIT_METER_SQUARE").alias("unit")))),
        control(248, "Floor", translated(F.lit("ignored earlier value"))), control(248, "Floor", translated(F.col("floor"))),
        control(249, "Floors", translated(F.col("floors_total"))), control(852, "Stock", translated(F.col("housing_stock"))),
        control(1658, "Developer", translated(F.col("developer"))), control(795, "Author", translated(F.col("author_type"))),
        control(1385, "Unit price", F.col("price_per_m2")))
    rest = F.array(
        control(2, "Price", F.to_json(F.struct(F.col("price").alias("value"), F.lit("UNIT_EUR").alias("unit"), F.lit(False).alias("bargain")))),
        control(9, vocab.DISTRICT_FEATURE, translated(F.when(F.col("district") == "NATION_3", "Окраина").otherwise(F.col("district")))),
        control(10, "Street", translated(F.col("street"))), control(11, "House", translated(F.col("house"))),
        control(13, "", F.to_json(F.struct(F.concat(F.col("title"), F.when(F.col("terms_flag"), " avans").otherwise("")).alias("translated")))),
        control(3, "Map", F.to_json(F.struct("lat", "lon"))), control(7, "Region", translated(F.concat(F.lit("r "), "district"))),
        control(8, "City", translated(F.concat(F.lit("c "), "district"))), control(2199, "Living", translated(F.col("street"))),
        control(1640, "Old price", F.when(F.col("old_price").isNotNull(), F.to_json(F.struct(F.col("old_price").alias("value"), F.lit("UNIT_USD").alias("unit"))))),
        control(14, "Photos", F.when(F.col("photos_count") > 0, F.to_json(photos)).otherwise("[]")),
        control(16, "Contacts", F.to_json(F.struct(F.array(F.concat(F.lit("tel "), F.col("id").cast("string")), F.lit("tel 2")).alias("phone_numbers")))))
    sub = F.from_json(F.to_json(F.struct(F.lit(1404).alias("id"), F.struct(F.col("subcategory").alias("translated")).alias("title"), F.struct(
        F.lit(1).alias("id"), F.struct(F.lit("Homes").alias("translated")).alias("title")).alias("parent"))),
        "struct<id:int,title:struct<translated:string>,parent:struct<id:int,title:struct<translated:string>,parent:struct<id:int,title:struct<translated:string>>>>")
    return d.select(
        F.col("id").cast("string").alias("id"), F.lit("open").alias("state"), "title", F.lit(False).alias("isExpired"),
        F.date_format("posted", "yyyy-MM-dd HH:mm:ss").alias("posted"), F.date_format("first_seen", "yyyy-MM-dd").alias("reseted"),
        F.date_format("gone_at", "yyyy-MM-dd").alias("expire"), sub.alias("subCategory"), owner_struct(F.col("views_total"), F.col("owner_is_business")).alias("owner"),
        F.array(F.struct(F.lit("Main").alias("title"), main.alias("controls")), F.struct(F.lit("More").alias("title"), rest.alias("controls"))).alias("groups"),
        F.struct(F.col("views_total").cast("int").alias("total"), (F.col("views_total") % 7).cast("int").alias("today"), (F.col("views_total") % 5).cast("int").alias("sinceRepublish")).alias("views"))


def owner_struct(key, business):
    return F.struct(
        key.cast("string").alias("id"), F.concat(F.lit("user"), key.cast("string")).alias("login"), F.lit("").alias("avatar"),
        F.lit("2020-01-01").alias("createdDate"), F.struct(F.when(business, "b1").alias("id"), F.lit("pro").alias("plan")).alias("business"),
        F.struct((key % 2 == 0).alias("isVerified")).alias("verification"), F.lit(None).cast("boolean").alias("isDeleted"))


@query("owner_flags", """SELECT c_custkey, 'user' || c_custkey AS owner_login, c_custkey::varchar AS owner_id, (c_mktsegment = 'MACHINERY')::bigint AS owner_is_business,
  (c_custkey % 2 = 0)::bigint AS owner_verified, 0 AS owner_deleted FROM customer""")
def _(spark, sf):
    owners = b.table(spark, sf, "customer").withColumn("owner", owner_struct(F.col("c_custkey"), F.col("c_mktsegment") == "MACHINERY"))
    flat = cards.owner_columns()
    return owners.select("c_custkey", *[flat[n].alias(n) for n in ("owner_login", "owner_id", "owner_is_business", "owner_verified", "owner_deleted")])


_DET = b.with_(b.SQL_ADS, b.SQL_DET)


_ROOMS = "CASE WHEN rooms_n = 0 THEN 'Студия' WHEN rooms_n IS NULL THEN '' ELSE rooms_n || ' rooms' END"
_DISTRICT = "CASE WHEN district = 'NATION_3' THEN 'Пригород' ELSE district END"
_PHOTOS = "list_transform(range(1, photos_count + 1), lambda i: 'https://media.example/900x900/' || id || '-' || i || '.jpg')"
#: The columns that typed details and export rows share.
_CARD_SQL = f"""id::varchar AS id, 'open' AS state, strftime(posted, '%Y-%m-%d %H:%M:%S') AS posted, strftime(first_seen, '%Y-%m-%d') AS reseted,
    coalesce(strftime(gone_at, '%Y-%m-%d'), '') AS expire, views_total, views_total % 7 AS views_today, 'Sell' AS offer_type, coalesce(author_type, '') AS author_type, {_ROOMS} AS rooms,
    housing_stock, street AS living_room, developer, 'r ' || district AS region, 'c ' || district AS city, {_DISTRICT} AS district, street, house,
    'user' || views_total AS owner_login, views_total::varchar AS owner_id, '2020-01-01' AS owner_registered, owner_is_business::bigint AS owner_is_business,
    (views_total % 2 = 0)::bigint AS owner_verified, 'tel ' || id || ', tel 2' AS phones, photos_count,
    title || CASE WHEN terms_flag = 1 THEN ' avans' ELSE '' END AS description"""


@query("typed_details", _DET + f"""SELECT {_CARD_SQL}, '{b.AS_OF_TEXT}' AS fetched_at, rooms_n::bigint AS rooms_n, round(area, 8) AS area, 'm²' AS area_unit,
    floor::bigint AS floor, floors_total::bigint AS floors_total, round(price_per_m2, 8) AS price_per_m2, array_to_string({_PHOTOS}, ' ') AS photos,
    17 + 3 AS features, terms_flag::bigint AS terms_flag
  FROM ads JOIN det USING (id)""", digits=8)
def _(spark, sf):
    """All 36 columns; photos joined, of the attributes their number."""
    typed = cards.typed_details(cards.parse_cards(raw_cards(spark, sf), "https://media.example"), b.as_of())
    return typed.withColumns({"photos": F.array_join("photos", " "), "features": F.size("features")})


@query("csv_row_projection", _DET + f"""SELECT {_CARD_SQL}, 'https://listings.example/' || id AS url, title, 'False' AS is_expired, views_total % 5 AS views_since_republish,
    'Homes / ' || subcategory AS category, subcategory, 1404 AS subcategory_id, round(price, 8) AS price, 'EUR' AS currency, 'False' AS bargain,
    round(price_per_m2, 8) AS price_per_m2, round(old_price, 8) AS old_price, CASE WHEN old_price IS NOT NULL THEN 'USD' ELSE '' END AS old_currency,
    area::varchar || ' m²' AS area, floor::varchar AS floor, coalesce(floors_total::varchar, '') AS floors_total, round(lat, 8) AS lat, round(lon, 8) AS lon,
    'pro' AS owner_business_plan, array_to_string({_PHOTOS}, ' ') AS photos
  FROM ads JOIN det USING (id)""", digits=8)
def _(spark, sf):
    """All 46 columns of an export row."""
    parsed = cards.parse_cards(raw_cards(spark, sf), "https://media.example")
    return cards.export_rows(parsed, "https://listings.example/").withColumn("price_per_m2", F.col("price_per_m2").cast("double"))


_SWITCHES = [k for k, (_, test, _) in vocab.AMENITIES.items() if test == "true"]


@query("card_amenities", _DET + " UNION ALL ".join(
    [f"SELECT '{k}' AS amenity, id::varchar AS id FROM ads JOIN det USING (id) WHERE id % {i + 2} = 0" for i, k in enumerate(_SWITCHES)]
    + ["SELECT 'baths2', id::varchar FROM ads JOIN det USING (id) WHERE id % 5 IN (2, 3)",
       "SELECT 'parking', id::varchar FROM ads JOIN det USING (id)", "SELECT 'balcony', id::varchar FROM ads JOIN det USING (id) WHERE id % 7 <> 0"]))
def _(spark, sf):
    """From raw cards over their parsed features to every amenity."""
    def control(fid, title, value):
        return F.struct(F.lit("text").alias("type"), F.lit(title).alias("title"), F.struct(
            F.lit(fid).alias("id"), F.lit("T").alias("type"), value.cast("string").alias("value")).alias("feature"))
    number = F.col("id").cast("bigint")
    switches = [control(2000 + i, vocab.AMENITIES[k][0], number % (i + 2) == 0) for i, k in enumerate(_SWITCHES)]
    texts = {"baths2": (number % 5).cast("string"), "parking": F.lit("yes"), "balcony": F.when(number % 7 == 0, "Нет").otherwise("1")}
    texts = [control(3000 + i, vocab.AMENITIES[k][0], F.to_json(F.struct(v.alias("translated")))) for i, (k, v) in enumerate(texts.items())]
    group = F.struct(F.lit("Amenities").alias("title"), F.array(*switches, *texts).alias("controls"))
    raw = raw_cards(spark, sf).withColumn("groups", F.concat("groups", F.array(group)))
    parsed = cards.parse_cards(raw, "https://media.example")
    hits = F.array_compact(F.array(*[F.when(filters.amenity(k), k) for k in vocab.AMENITIES]))
    return parsed.select(F.explode(hits).alias("amenity"), "id")


ROLES = {"system": "system_text", "user": "user_text", "assistant": "assistant_text"}


@query("eav_pivot", "SELECT conv_id, " + ", ".join(f"md5(arg_max(text, turn) FILTER (role = '{r}')) AS {c}" for r, c in ROLES.items()) + " FROM conversations GROUP BY conv_id")
def _(spark, sf):
    wide = cards.eav_pivot(b.table(spark, sf, "conversations"), ["conv_id"], "role", "text", "turn", ROLES)
    return wide.select("conv_id", *[F.md5(c).alias(c) for c in ROLES.values()])


@query("attribute_map", """SELECT conv_id, string_agg(role || '=' || v, '|' ORDER BY role) AS features FROM (
    SELECT conv_id, role, CASE WHEN role = 'user' AND arg_max(length(text), turn) = 100 THEN 'hundred' ELSE arg_max(length(text), turn)::varchar END AS v
    FROM conversations WHERE role <> '' GROUP BY conv_id, role) GROUP BY conv_id""")
def _(spark, sf):
    turns = b.table(spark, sf, "conversations").withColumn("size", F.length("text").cast("string"))
    mapped = cards.attribute_map(turns, ["conv_id"], "role", "size", "turn", {"100": "hundred"}, "user")
    return mapped.select("conv_id", maps.as_text(F.col("features")).alias("features"))


@query("canonical_values", """SELECT n_nationkey::bigint AS n_nationkey, CASE n_name WHEN 'NATION_3' THEN 'NATION_THREE' ELSE n_name END AS name,
  'Сектор=' || CASE n_name WHEN 'NATION_3' THEN 'NATION_THREE' ELSE n_name END || '|x=' || n_name AS features FROM nation""")
def _(spark, sf):
    renames = {"NATION_3": "NATION_THREE"}
    features = F.create_map(F.lit("x"), F.col("n_name"), F.lit(vocab.DISTRICT_FEATURE), F.col("n_name"))
    return b.table(spark, sf, "nation").select(
        "n_nationkey", text.renamed("n_name", renames).alias("name"),
        # keys sort by code point: Latin before Cyrillic
        F.concat(F.lit("Сектор="), text.renamed_in_map(features, renames=renames)[vocab.DISTRICT_FEATURE], F.lit("|x="), text.renamed_in_map(features, renames=renames)["x"]).alias("features"))


# ---- free text ---------------------------------------------------------------------------

@query("number_extract", r"""SELECT 'doc' AS src, doc_id AS id, try_cast(nullif(regexp_extract(text, '-?\d+'), '') AS bigint) AS i,
    try_cast(replace(nullif(regexp_extract(text, '-?\d+(?:[.,]\d+)?'), ''), ',', '.') AS double) AS x FROM documents
  UNION ALL SELECT 'url', page_id, try_cast(nullif(regexp_extract(url, '-?\d+'), '') AS bigint),
    try_cast(replace(nullif(regexp_extract(url, '-?\d+(?:[.,]\d+)?'), ''), ',', '.') AS double) FROM pages""", digits=None)
def _(spark, sf):
    docs = b.table(spark, sf, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    both = docs.unionByName(b.table(spark, sf, "pages").select(F.lit("url").alias("src"), F.col("page_id").alias("id"), F.col("url").alias("t")))
    return both.select("src", "id", text.first_int("t").alias("i"), text.first_number("t").alias("x"))


@query("digits_only_int", r"SELECT doc_id, try_cast(nullif(regexp_replace(text, '[^0-9]', '', 'g'), '') AS bigint) AS digits FROM documents")
def _(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.digits_only("text").alias("digits"))


@query("rooms_number", r"""SELECT conv_id, turn, CASE WHEN contains(text, 'tion') THEN 0 ELSE try_cast(nullif(regexp_extract(text, '-?\d+'), '') AS bigint) END AS rooms FROM conversations""")
def _(spark, sf):
    return b.table(spark, sf, "conversations").select("conv_id", "turn", text.rooms_number("text", "tion").alias("rooms"))


_DATA_MARKERS = ("tion the", "+1 (", "éeux le", ". and")


def _any(markers):
    return " OR ".join("contains(lower(text), '{}')".format(m.replace("'", "''")) for m in markers)


@query("terms_flag", f"SELECT doc_id, ({_any(vocab.TERMS_MARKERS)})::bigint AS terms, ({_any(_DATA_MARKERS)})::bigint AS marked FROM documents")
def _(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.contains_any("text").alias("terms"), text.contains_any("text", _DATA_MARKERS).alias("marked"))


@query("mask_phones", rf"SELECT doc_id, md5(regexp_replace(text, '{DATA_PHONES}', '[hidden]', 'g')) AS masked, regexp_matches(text, '{DATA_PHONES}')::bigint AS had FROM documents")
def _(spark, sf):
    return b.table(spark, sf, "documents").select(
        "doc_id", F.md5(text.mask("text", DATA_PHONES, "[hidden]")).alias("masked"), F.col("text").rlike(DATA_PHONES).alias("had"))


@query("mask_phones_local")
def _(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.mask("text").alias("masked"))


@query("strip_private", rf"""SELECT doc_id, NULL::varchar AS phones, NULL::varchar AS owner_login, md5(regexp_replace(text, '{DATA_PHONES}', '[номер скрыт]', 'g')) AS description,
  'lang=' || lang || '|Текст объявления=' || md5(regexp_replace(text, '{DATA_PHONES}', '[номер скрыт]', 'g')) AS features FROM documents""")
def _(spark, sf):
    docs = b.table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("phones"), F.col("source").alias("owner_login"), F.col("text").alias("description"),
        F.create_map(F.lit("Контакты"), F.col("source"), F.lit("Агентство"), F.col("lang"), F.lit("lang"), F.col("lang"),
                     F.lit(vocab.LISTING_TEXT_FEATURE), F.col("text")).alias("features"))
    got = privacy.strip_private(docs, pattern=DATA_PHONES)
    hashed = F.transform_values("features", lambda k, v: F.when(k == vocab.LISTING_TEXT_FEATURE, F.md5(v)).otherwise(v))
    return got.select("doc_id", "phones", "owner_login", F.md5("description").alias("description"), maps.as_text(hashed).alias("features"))


@query("media_urls", _DET + """SELECT id, array_to_string(list_transform(range(1, photos_count + 1), lambda i: 'https://media.example/900x900/' || id || '-' || i), ' ') AS full_size,
  array_to_string(list_transform(range(1, photos_count + 1), lambda i: 'https://media.example/320x240/' || id || '-' || i), ' ') AS thumbs FROM det""")
def _(spark, sf):
    names = F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest("photos_count", F.lit(1))), lambda i: F.concat(F.col("id").cast("string"), F.lit("-"), i.cast("string")))
    names = F.when(F.col("photos_count") > 0, names).otherwise(F.array().cast("array<string>"))
    full = text.media_urls(names, "https://media.example", "900x900")
    return b.details(spark, sf).select("id", F.array_join(full, " ").alias("full_size"),
                                       F.array_join(text.resize_urls(full, "900x900", "320x240"), " ").alias("thumbs"))


@query("breadcrumb_path", """SELECT s_suppkey, concat_ws(' / ', r_name, nullif(CASE WHEN s_acctbal < 0 THEN '' ELSE n_name END, ''), s_name) AS path
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def _(spark, sf):
    joined = (b.table(spark, sf, "supplier").join(b.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
              .join(b.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    middle = F.when(F.col("s_acctbal") < 0, "").otherwise(F.col("n_name"))
    return joined.select("s_suppkey", text.breadcrumb("r_name", middle, "s_name").alias("path"))


# the entities of the test pages; the ampersand, also without its semicolon, comes last
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"),
            ("&eacute;", "é"))
_CLEAN = "regexp_replace({x}, '<[^>]+>', '', 'g')"
for _name, _char in ENTITIES:
    _CLEAN = f"replace({_CLEAN}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"
_CLEAN = f"regexp_replace({_CLEAN}, '&amp;?', '&', 'g')"
_CLEAN = f"trim(regexp_replace({_CLEAN}, '[\\s\\x{{00A0}}]+', ' ', 'g'))".replace("{00A0}", "{{00A0}}")


@query("html_clean", f"SELECT page_id, {_CLEAN.format(x='html')} AS plain FROM pages")
def _(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", text.html_clean("html").alias("plain"))


@query("html_clean_full", f"SELECT page_id, {_CLEAN.format(x='html')} AS plain FROM pages")
def _(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", text.html_clean_full("html").alias("plain"))


_MARK = "<(ul|article|footer)>"
_FIELD = '<li><a href="/([^"]*)">(.*?)</a></li>'
_KNOWN = {"the": "the_word", "la": "la_word", "en": "en_word", "e": "e_word"}


@query("html_sections", f"""WITH seg AS (SELECT page_id, i - 1 AS segment, codes[i] AS code, bodies[i + 1] AS body FROM (
      SELECT page_id, regexp_extract_all(html, '{_MARK}', 1) AS codes, string_split_regex(html, '{_MARK}') AS bodies FROM pages), unnest(range(1, len(codes) + 1)) t(i)),
  fld AS (SELECT page_id, segment, j, {_CLEAN.format(x='labels[j]')} AS label, {_CLEAN.format(x='vals[j]')} AS value FROM (
      SELECT page_id, segment, regexp_extract_all(body, '{_FIELD}', 1) AS labels, regexp_extract_all(body, '{_FIELD}', 2) AS vals FROM seg), unnest(range(1, len(labels) + 1)) t(j)),
  k AS (SELECT *, lower(strip_accents(label)) AS f, CASE WHEN starts_with(f, 'the') THEN 'the_word' WHEN starts_with(f, 'la') THEN 'la_word' WHEN starts_with(f, 'en') THEN 'en_word' WHEN starts_with(f, 'e') THEN 'e_word' END AS key FROM fld),
  r AS (SELECT *, key IS NULL OR row_number() OVER (PARTITION BY page_id, segment, key ORDER BY j) > 1 AS spare FROM k),
  e AS (SELECT page_id, segment, string_agg(label || '=' || value, '|' ORDER BY label) AS extras FROM (
      SELECT page_id, segment, label, arg_max(value, j) AS value FROM r WHERE spare GROUP BY ALL) GROUP BY ALL),
  w AS (SELECT page_id, segment, {', '.join(f"max(value) FILTER (key = '{c}' AND NOT spare) AS {c}" for c in _KNOWN.values())} FROM r GROUP BY ALL)
  SELECT page_id, segment, code, the_word, la_word, en_word, e_word, coalesce(extras, '') AS extras FROM seg LEFT JOIN w USING (page_id, segment) LEFT JOIN e USING (page_id, segment)""")
def _(spark, sf):
    segs = pages.html_segments(b.table(spark, sf, "pages").select("page_id", "html"), "html", _MARK)
    got = pages.html_fields(segs, "body", _FIELD, _KNOWN)
    return got.select("page_id", "segment", "code", *_KNOWN.values(), maps.as_text(F.col("extras")).alias("extras"))


@query("fold_diacritics", "SELECT doc_id, md5(trim(lower(strip_accents(text)))) AS folded FROM documents")
def _(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.md5(text.plain("text")).alias("folded"))


@query("fold_diacritics_full", "SELECT doc_id, trim(lower(strip_accents(text))) AS folded FROM documents")
def _(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.plain_full("text").alias("folded"))


@query("id_from_text", r"SELECT doc_id, nullif(regexp_extract(text, '(\d{6,})', 1), '') AS found FROM documents")
def _(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.id_from_text("text").alias("found"))


@query("row_validation", r"""WITH m AS (SELECT doc_id, trim(CASE WHEN lang = 'fr' THEN 'f' ELSE source END) AS name, trim(source || CASE WHEN lang = 'de' THEN ' at ' ELSE '@' END || lang || '.example') AS email, trim(text) AS body FROM documents)
  SELECT doc_id, CASE WHEN length(left(name, 100)) < 2 THEN 'name too short' WHEN NOT regexp_matches(left(email, 200), '(?i)^[^@\s]{1,64}@[a-z0-9.-]{1,180}\.[a-z]{2,24}$') THEN 'bad e-mail'
    WHEN length(left(body, 5000)) < 10 THEN 'body too short' END AS reason, length(left(body, 5000)) AS body_chars FROM m""")
def _(spark, sf):
    m = b.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "fr", "f").otherwise(F.col("source")).alias("name"),
        F.concat("source", F.when(F.col("lang") == "de", " at ").otherwise("@"), "lang", F.lit(".example")).alias("email"), F.col("text").alias("body"))
    fields = text.message_fields("name", "email", "body")
    return m.select("doc_id", text.first_problem("name", "email", "body").alias("reason"), F.length(fields["body"]).alias("body_chars"))


# ---- URLs and sinks ----------------------------------------------------------------------

@query("url_params", r"""WITH q AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '') AS ps FROM pages)
  SELECT page_id, i - 1 AS param, string_split(ps[i], '=')[1] AS key, coalesce(string_split(ps[i], '=')[2], '') AS value FROM q, unnest(range(1, len(ps) + 1)) t(i)""")
def _(spark, sf):
    return urls.url_params(b.table(spark, sf, "pages").select("page_id", "url"), "url").select("page_id", "param", "key", "value")


def request_urls(spark, sf):
    """Filter requests written from the attributes of parts."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    return b.table(spark, sf, "part").select("p_partkey", F.concat(
        F.lit("https://listings.example/map?o_16_"), size, F.lit("="), key, F.lit("&o_32_7=129&o_16_"), size, F.lit("=776&from_9441_2="),
        F.floor("p_retailprice").cast("string"), F.lit("&to_9441_2=9"), key, F.lit("&unit_9441_2=eur"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("&spec=14"), size)).otherwise(""),
        F.when(F.col("p_type") == "PROMO", "&cat=27&from_5_6=1%2C5").otherwise(""), F.lit("#top")).alias("url"))


@query("url_filter_spec", """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 27 ELSE 270 END AS category, CASE WHEN p_size > 25 THEN ('14' || p_size)::bigint END AS spec,
    filter_id, feature_id, options, min, max, unit FROM (
    SELECT *, 16 AS filter_id, p_size::bigint AS feature_id, p_partkey || ',776' AS options, NULL AS min, NULL AS max, NULL AS unit FROM part
    UNION ALL SELECT *, 32, 7, '129', NULL, NULL, NULL FROM part
    UNION ALL SELECT *, 9441, 2, '', floor(p_retailprice)::bigint::varchar, '9' || p_partkey, 'UNIT_EUR' FROM part
    UNION ALL SELECT *, 5, 6, '', '1,5', NULL, NULL FROM part WHERE p_type = 'PROMO')""")
def _(spark, sf):
    heads, rows = urls.filter_specs(request_urls(spark, sf), "p_partkey", "url")
    return heads.join(rows, "p_partkey").select(
        "p_partkey", "category", "spec", "filter_id", "feature_id",
        F.array_join(F.transform("option_ids", lambda x: x.cast("string")), ",").alias("options"), "min", "max", "unit")


@query("write_csv", A + _FLAT)
def _(spark, sf):
    path = work_dir(spark, "csv")
    flat = listings.flatten_listings(raw_listings(spark, sf), "https://listings.example/")
    sinks.write_csv(flat, path, vocab.LISTING_EXPORT)
    text_type = {c: "string" for c in vocab.LISTING_EXPORT} | {"lat": "double", "lon": "double"}
    back = spark.read.option("header", True).option("escape", '"').schema(", ".join(f"{c} {t}" for c, t in text_type.items())).csv(path)
    return back.fillna("")


@query("write_json", A + _FLAT)
def _(spark, sf):
    path = work_dir(spark, "json")
    sinks.write_json(raw_listings(spark, sf), path)
    return listings.flatten_listings(listings.read_listings(spark, path), "https://listings.example/")
