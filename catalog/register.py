"""Queries linking listings to register units and buildings."""
from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.registry import query
from stallwise import vocab
from stallwise.functions import address, geo, maps
from stallwise.operators import linkage, pages
from stallwise.operators.skew import first_per_key
from stallwise.sources.sinks import stored

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def side(spark, sf, status):
    lines = b.table(spark, sf, "lineitem").where(F.col("l_linestatus") == status).select(
        *KEY, "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")
    return first_per_key(lines, KEY, ["l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"])


def sql_side(name, status):
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(KEY)}
    ORDER BY l_quantity, l_extendedprice, l_shipdate, l_returnflag) AS pick FROM lineitem WHERE l_linestatus = '{status}') WHERE pick = 1)"""



def line_id():
    return F.concat_ws("-", *KEY)


_SQL_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def wanted(spark, sf):
    """Listings to match; stored, as matching reads them twice."""
    return stored(side(spark, sf, "O").select(
        line_id().alias("id"), F.col("l_partkey").alias("building"), F.col("l_linenumber").alias("floor"),
        F.col("l_quantity").alias("area"), "l_returnflag"), "wanted")


def units(spark, sf):
    return side(spark, sf, "F").select(
        line_id().alias("code"), F.col("l_partkey").alias("building"), F.col("l_linenumber").alias("floor"),
        F.col("l_quantity").alias("area"), F.round("l_extendedprice").cast("bigint").alias("value"))


_LADDER = f"""{sql_side('o', 'O')}, {sql_side('f', 'F')},
  a AS (SELECT {_SQL_ID} AS id, l_partkey AS building, l_linenumber AS floor, l_quantity AS area, l_returnflag FROM o),
  u AS (SELECT {_SQL_ID} AS code, l_partkey AS building, l_linenumber AS floor, l_quantity AS unit_area, round(l_extendedprice)::bigint AS value FROM f),
  p AS (SELECT a.id, a.building, a.floor, a.area, u.code, u.unit_area, u.value,
      CASE WHEN unit_area BETWEEN area * 0.95::double AND area * 1.05::double THEN 0.05 ELSE 0.1 END AS tier
    FROM a JOIN u ON u.building = a.building AND u.floor = a.floor AND u.value > 0
      AND u.unit_area BETWEEN a.area * (1 - 0.1::double) AND a.area * (1 + 0.1::double)),
  best AS (SELECT id, min(tier) AS tolerance FROM p GROUP BY id),
  m AS (SELECT p.id, any_value(building) AS building, any_value(floor) AS floor, any_value(area) AS area, any_value(tolerance)::double AS tolerance, count(*) AS n, min(value) AS value_min,
      round_even(quantile_cont(value, 0.5), 0)::bigint AS value_med, max(value) AS value_max
    FROM p JOIN best ON best.id = p.id AND p.tier = best.tolerance GROUP BY p.id)"""
LADDER = b.with_(_LADDER)


@query("tolerance_ladder_join", LADDER + "SELECT id, building, floor::bigint AS floor, area, tolerance, n, value_min, value_med, value_max FROM m")
def _(spark, sf):
    return linkage.match_listings(wanted(spark, sf), units(spark, sf)).drop("l_returnflag")


@query("unit_lookup", LADDER + """SELECT DISTINCT m.building, m.floor::bigint AS floor, m.area, m.tolerance, code, unit_area, value, p_brand AS classifier, p_name AS street
  FROM m JOIN p ON p.id = m.id AND p.tier <= m.tolerance JOIN part ON p_partkey = m.building""")
def _(spark, sf):
    buildings = b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("building"), F.col("p_brand").alias("classifier"), F.col("p_name").alias("street"))
    u = units(spark, sf)
    return linkage.unit_lookup(linkage.tolerance_match(wanted(spark, sf), u), u, buildings).select(
        "building", "floor", "area", "tolerance", "code", "unit_area", "value", "classifier", "street")


@query("match_coverage", LADDER + """SELECT l_returnflag, count(*) AS total, count(tolerance) AS found,
    count(*) FILTER (tolerance = 0.05) AS within_5, count(*) FILTER (tolerance = 0.1) AS within_10
  FROM a LEFT JOIN m ON m.id = a.id GROUP BY l_returnflag""")
def _(spark, sf):
    ads = wanted(spark, sf)
    return linkage.match_coverage(ads, linkage.match_listings(ads, units(spark, sf)), ["l_returnflag"])


@query("rematch_merge", LADDER + """SELECT id, building, 0 AS n FROM a WHERE l_returnflag <> 'R'
  UNION ALL SELECT m.id, m.building, n FROM m JOIN a ON a.id = m.id WHERE l_returnflag = 'R'""")
def _(spark, sf):
    ads = wanted(spark, sf)
    stored = ads.select("id", "building", F.lit(0).cast("bigint").alias("n"))
    touched = ads.where(F.col("l_returnflag") == "R")
    return linkage.rematch_merge(stored, touched, linkage.match_listings(touched, units(spark, sf)))


# ---- addresses ---------------------------------------------------------------------------

_PARTS = """list_filter(list_transform(string_split(address, ','), lambda x: trim(x)), lambda x: x <> '')"""
_SPLIT = f"""SELECT *, CASE WHEN len(parts) >= 2 AND regexp_full_match(parts[-1], '\\d[\\w/-]*') THEN parts[-2]
      WHEN regexp_matches(parts[-1], '^(.*?)\\s+(\\d[\\w/-]*)$') THEN regexp_extract(parts[-1], '^(.*?)\\s+(\\d[\\w/-]*)$', 1) ELSE parts[-1] END AS street,
    CASE WHEN len(parts) >= 2 AND regexp_full_match(parts[-1], '\\d[\\w/-]*') THEN parts[-1]
      WHEN regexp_matches(parts[-1], '^(.*?)\\s+(\\d[\\w/-]*)$') THEN regexp_extract(parts[-1], '^(.*?)\\s+(\\d[\\w/-]*)$', 2) ELSE '' END AS house
  FROM (SELECT *, {_PARTS} AS parts FROM {{src}})"""


@query("split_address", b.with_("""src AS (SELECT s_suppkey AS id, concat_ws(', ', n_name, 'sect. ' || s_name || ' bd. ' || n_name || ' ' || s_nationkey) AS address
      FROM supplier JOIN nation ON n_nationkey = s_nationkey
    UNION ALL SELECT p_partkey, concat_ws(', ', p_type, 'str. ' || p_name, p_size || 'a/b') FROM part
    UNION ALL SELECT p_partkey, p_name FROM part)""") + f"""SELECT id, address, regexp_replace(street, '^sect\\.?\\s+\\S+\\s+', '') AS street, house FROM ({_SPLIT.format(src='src')})""")
def _(spark, sf):
    part = b.table(spark, sf, "part")
    near = b.table(spark, sf, "supplier").join(b.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    first = near.select(F.col("s_suppkey").alias("id"), F.concat_ws(", ", "n_name", F.concat(
        F.lit("sect. "), F.col("s_name"), F.lit(" bd. "), F.col("n_name"), F.lit(" "), F.col("s_nationkey").cast("string"))).alias("address"))
    second = part.select("p_partkey", F.concat_ws(", ", "p_type", F.concat(F.lit("str. "), F.col("p_name")),
                                                  F.concat(F.col("p_size").cast("string"), F.lit("a/b"))))
    third = part.select("p_partkey", "p_name")
    return linkage.address_parts(first.union(second).union(third), "address")


@query("norm_house", """SELECT p_partkey, translate(lower(regexp_replace(p_size || ' В ' || chr(1040 + p_size % 8), '\\s+', '', 'g')), 'абвгдеж', 'abvgdej') AS house FROM part""")
def _(spark, sf):
    letters = F.array(*[F.lit(chr(1040 + i)) for i in range(8)])
    letter = F.get(letters, F.col("p_size") % 8)
    return b.table(spark, sf, "part").select(
        "p_partkey", address.norm_house(F.concat(F.col("p_size").cast("string"), F.lit(" В "), letter)).alias("house"))


def _nested_replace(expr, pairs):
    for old, new in pairs:
        expr = f"replace({expr}, '{old}', '{new}')"
    return expr


def sql_street_key(expr):
    """The sound key for Latin words; repeats collapse over a character list."""
    words = ", ".join(f"'{w}'" for w in vocab.STREET_WORDS)
    marked = _nested_replace("strip_accents(translate(w, 'șşțţ', 'SSCC'))", vocab.LATIN_SOUNDS)
    bare = f"regexp_replace({marked}, '[{vocab.VOWELS}]', '', 'g')"
    collapse = "array_to_string(list_filter(string_split({x}, ''), lambda c, i: i = 1 OR c <> string_split({x}, '')[i - 1]), '')"
    sounds = f"list_transform(list_filter(string_split_regex(trim(translate(lower({expr}), '.,', '  ')), '\\s+'), lambda w: w NOT IN ({words})), lambda w: {bare})"
    return f"array_to_string(list_transform({sounds}, lambda y: {collapse.format(x='y')}), '')"


@query("street_skeleton", "SELECT p_partkey, " + sql_street_key("'str. ' || p_name || ' ' || p_type || ', ' || p_brand") + " AS skeleton FROM part")
def _(spark, sf):
    text = F.concat(F.lit("str. "), F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(", "), F.col("p_brand"))
    return b.table(spark, sf, "part").select("p_partkey", address.street_key(text).alias("skeleton"))


_SIM = """CASE WHEN ka = '' OR kb = '' THEN 0 WHEN contains(ka, kb) OR contains(kb, ka) THEN 1
  ELSE 1 - levenshtein(ka, kb)::double / greatest(length(ka), length(kb)) END"""


def street_names(spark, sf):
    part = b.table(spark, sf, "part")
    pairs = part.select(F.col("p_name").alias("street"), F.concat_ws(" ", "p_type", "p_name").alias("b_street"))
    return pairs.unionByName(part.select(F.col("p_name").alias("street"), F.concat_ws(" ", "p_name", "p_brand").alias("b_street"))).unionByName(
        part.select(F.concat_ws(" ", "p_type", "p_brand").alias("street"), F.col("p_name").alias("b_street"))).distinct()


@query("street_similarity", "WITH s AS (SELECT p_name AS street, p_type || ' ' || p_name AS b_street FROM part UNION SELECT p_name, p_name || ' ' || p_brand FROM part UNION SELECT p_type || ' ' || p_brand, p_name FROM part), k AS (SELECT *, "
       + sql_street_key("street") + " AS ka, " + sql_street_key("b_street") + f" AS kb FROM s) SELECT street, b_street, round({_SIM}, 4) AS score FROM k")
def _(spark, sf):
    return linkage.score_streets(street_names(spark, sf)).select("street", "b_street", "score")


#: The longest run of x that y holds, the earliest in x, and its first place in y; both sides of it are searched next.
_BLOCKS = """w AS (SELECT ka, kb, ka AS x, kb AS y FROM kp
    UNION ALL SELECT ka, kb, s.x, s.y FROM (
      SELECT ka, kb, unnest([{{'x': x[:i - 1], 'y': y[:j - 1]}}, {{'x': x[i + l:], 'y': y[j + l:]}}]) AS s FROM (SELECT *, position(x[i:i + l - 1] IN y) AS j FROM (
        SELECT ka, kb, x, y, m.l AS l, -m.i AS i FROM (SELECT *, {best} AS m FROM w WHERE x <> '' AND y <> ''))) WHERE l > 0)),
  blocks AS (SELECT ka, kb, sum(coalesce({best}.l, 0)) AS hit FROM w GROUP BY ALL),
  ratio AS (SELECT ka, kb, CASE WHEN ka = '' OR kb = '' THEN 0 WHEN contains(ka, kb) OR contains(kb, ka) THEN 1 ELSE 2.0::double * hit / (length(ka) + length(kb)) END AS score FROM blocks)""".format(
    best="""list_max(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(list_filter(range(1, length(x) - i + 2), lambda l: contains(y, x[i:i + l - 1])),
          lambda l: {'l': l, 'i': -i}))))""")


@query("street_similarity_ratio", b.with_("s AS (SELECT p_name AS street, p_type || ' ' || p_name AS b_street FROM part UNION SELECT p_name, p_name || ' ' || p_brand FROM part UNION SELECT p_type || ' ' || p_brand, p_name FROM part)",
        f"k AS (SELECT *, {sql_street_key('street')} AS ka, {sql_street_key('b_street')} AS kb FROM s)", "kp AS (SELECT DISTINCT ka, kb FROM k)", _BLOCKS, recursive=True)
       + "SELECT street, b_street, round(score, 8) AS score FROM k JOIN ratio USING (ka, kb)", digits=8)
def _(spark, sf):
    return linkage.score_streets(street_names(spark, sf), address.ratio_similarity).select("street", "b_street", "score")


def listings_to_match(spark, sf):
    """Active apartments with an address, and a register of buildings a few metres away, their streets spelled in three ways."""
    view = b.listings(spark, sf, False).where(F.col("house") != "").select(
        "id", "profile", "gone_at", "lat", "lon", "street", "house", "floor", "area", "housing_stock", "subcategory", F.col("views_total").alias("code"))
    view = stored(view, "addresses")
    listings = view.where((F.col("profile") == "apartments") & F.col("gone_at").isNull()).withColumn("all_new", F.col("housing_stock") == "O")
    spelled = (F.when(F.col("code") % 3 == 0, F.concat(F.lit("str. "), F.col("street")))
               .when(F.col("code") % 3 == 1, F.concat_ws(" ", "street", "subcategory")).otherwise(F.col("street")))
    return listings, view.withColumns({"street": spelled, "lat": F.col("lat") + (F.col("code") % 3) * F.lit(0.0001),
                                       "lon": F.col("lon") + (F.col("code") % 5 - 2) * F.lit(0.0001)})


#: Addresses at points (pt), places around them (pl), both in Mercator metres, and the place each address takes (best).
_MATCHED = b.W_LIST.rstrip("\n") + f""", ls AS (SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, street, lower(house) AS house_key, area, floor, housing_stock = 'O' AS fresh
      FROM listings WHERE profile = 'apartments' AND gone_at IS NULL AND house <> ''),
  pn AS (SELECT lat, lon, bool_and(fresh) AS all_new FROM ls GROUP BY ALL),
  pt AS (SELECT DISTINCT lat, lon, street, house_key, all_new FROM ls JOIN pn USING (lat, lon)),
  pl AS (SELECT round(lat + (views_total % 3) * 0.0001::double, 6) AS plat, round(lon + (views_total % 5 - 2) * 0.0001::double, 6) AS plon,
      CASE views_total % 3 WHEN 0 THEN 'str. ' || street WHEN 1 THEN street || ' ' || subcategory ELSE street END AS b_street,
      lower(house) AS b_house, min(views_total) AS code FROM listings WHERE house <> '' GROUP BY ALL),
  names AS (SELECT street AS nm FROM pt UNION SELECT b_street FROM pl), keyed AS (SELECT nm, {sql_street_key("nm")} AS k FROM names),
  pr AS (SELECT pt.*, pl.*, radians(plon - lon) * 6378137 * cos(radians(lat)) AS e,
      6378137 * (ln(tan(pi() / 4 + radians(plat) / 2)) - ln(tan(pi() / 4 + radians(lat) / 2))) * cos(radians(lat)) AS n
    FROM pt JOIN pl ON house_key = b_house AND pl.plon BETWEEN pt.lon - 0.0005 AND pt.lon + 0.0005 AND pl.plat BETWEEN pt.lat - 0.0005 AND pt.lat + 0.0005),
  near AS (SELECT *, CASE WHEN sqrt(e * e + n * n) <= 0 THEN 0 WHEN sqrt(e * e + n * n) <= 12 THEN 12 ELSE 25 END AS ring FROM pr WHERE sqrt(e * e + n * n) <= 25),
  sided AS (SELECT near.*, CASE WHEN ring = 0 THEN 0 ELSE (round(atan2(n, e) * 8 / (2 * pi()))::int + 8) % 8 END AS direction, a.k AS ka, c.k AS kb
    FROM near JOIN keyed a ON a.nm = street JOIN keyed c ON c.nm = b_street WHERE NOT all_new OR ring <= 12),
  {{good}},
  met AS (SELECT *, min(ring * 8 + direction) OVER (PARTITION BY lat, lon) AS stop FROM good),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon, street, house_key ORDER BY score DESC, ring, direction, code, b_street) AS rn
    FROM met WHERE ring * 8 + direction <= stop) WHERE rn = 1)"""
_MATCHED_BY_EDITS = _MATCHED.replace("{good}", f"good AS (SELECT * FROM (SELECT *, {_SIM} AS score FROM sided) WHERE score >= 0.6)")
_MATCHED_BY_BLOCKS = _MATCHED.replace("{good}", f"kp AS (SELECT DISTINCT ka, kb FROM sided), {_BLOCKS}, good AS (SELECT sided.*, score FROM sided JOIN ratio USING (ka, kb) WHERE score >= 0.6)").replace("WITH ", "WITH RECURSIVE ", 1)


@query("best_match_building", _MATCHED_BY_EDITS + "SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, street, house_key, b_street, code, round(score, 6) AS score FROM best", digits=6)
def _(spark, sf):
    return linkage.match_points(*listings_to_match(spark, sf))


@query("best_match_building_ratio", _MATCHED_BY_BLOCKS + "SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, street, house_key, b_street, code, round(score, 6) AS score FROM best", digits=6)
def _(spark, sf):
    return linkage.match_points(*listings_to_match(spark, sf), score=partial(address.ratio_similarity, at_least=vocab.STREET_SCORE_MIN))


@query("rematch", _MATCHED_BY_EDITS + f""", {sql_side('f', 'F')},
  u AS (SELECT l_partkey AS building, l_linenumber AS floor, l_quantity AS unit_area, round(l_extendedprice)::bigint AS value FROM f),
  placed AS (SELECT ls.id, code AS building, ls.floor, ls.area FROM ls JOIN best USING (lat, lon, street, house_key)),
  p AS (SELECT x.id, x.building, u.value, CASE WHEN unit_area BETWEEN area * 0.95::double AND area * 1.05::double THEN 0.05 ELSE 0.1 END AS tier
    FROM placed x JOIN u ON u.building = x.building AND u.floor = x.floor AND u.value > 0 AND unit_area BETWEEN area * (1 - 0.1::double) AND area * (1 + 0.1::double)),
  t AS (SELECT id, min(tier) AS tolerance FROM p GROUP BY id),
  fresh AS (SELECT p.id, any_value(building) AS building, any_value(tolerance)::double AS tolerance, count(*) AS n, min(value) AS value_min,
    round_even(quantile_cont(value, 0.5), 0)::bigint AS value_med, max(value) AS value_max FROM p JOIN t ON t.id = p.id AND p.tier = t.tolerance GROUP BY p.id)
  SELECT id, building, tolerance, n, value_min, value_med, value_max FROM fresh
  UNION ALL SELECT id, views_total, 0.05::double, 1, 0, 0, 0 FROM listings WHERE profile = 'apartments' AND gone_at IS NOT NULL""")
def _(spark, sf):
    """All active apartments matched anew from coordinates to units; gone ones keep the match they had."""
    view, (listings, places) = b.listings(spark, sf, False), listings_to_match(spark, sf)
    old = view.where(F.col("profile") == "apartments").select(
        "id", F.col("views_total").alias("building"), F.lit(0.05).alias("tolerance"), F.lit(1).cast("bigint").alias("n"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("value_min", "value_med", "value_max")])
    fresh = linkage.rematch(listings, places, units(spark, sf))
    touched = view.where((F.col("profile") == "apartments") & F.col("gone_at").isNull())
    return linkage.rematch_merge(old, touched, fresh)


def points_and_places(spark, sf):
    view = b.listings(spark, sf, False).where(F.col("house") != "")
    view = view.where((F.col("profile") == "apartments") | F.col("gone_at").isNotNull())  # others are neither
    view = stored(view.select("profile", "gone_at", "lat", "lon", "street", "house", "floor"), "addresses")
    points = view.where((F.col("profile") == "apartments") & F.col("gone_at").isNull())
    places = view.where(F.col("gone_at").isNotNull()).withColumn("lat", F.col("lat") + (F.col("floor") % 3) * F.lit(0.0001))
    return points, places


_SURVEY = b.W_LIST.rstrip("\n") + f""", pt AS (SELECT DISTINCT round(lat, 6) AS lat, round(lon, 6) AS lon, street, lower(house) AS house
      FROM listings WHERE profile = 'apartments' AND gone_at IS NULL AND house <> ''),
  pl AS (SELECT DISTINCT round(lat + (floor % 3) * 0.0001::double, 6) AS plat, round(lon, 6) AS plon, street AS b_street, lower(house) AS b_house FROM listings WHERE gone_at IS NOT NULL AND house <> ''),
  names AS (SELECT street AS nm FROM pt UNION SELECT b_street FROM pl), keyed AS (SELECT nm, {sql_street_key("nm")} AS k FROM names),
  pr AS (SELECT pt.*, pl.*, sqrt(pow(radians(plon - lon) * cos(radians(lat)), 2) + pow(radians(plat - lat), 2)) * 6378137 AS d
    FROM pt JOIN pl ON pl.plon BETWEEN pt.lon - 0.0005 AND pt.lon + 0.0005 AND pl.plat BETWEEN pt.lat - 0.0005 AND pt.lat + 0.0005),
  near AS (SELECT *, CASE WHEN d <= 0 THEN 0 WHEN d <= 12 THEN 12 ELSE 25 END AS ring FROM pr WHERE d <= 25),
  cnt AS (SELECT lat, lon, count(DISTINCT (plat, plon)) AS places FROM near GROUP BY ALL),
  sc AS (SELECT n.*, a.k AS ka, c.k AS kb FROM near n JOIN keyed a ON a.nm = n.street JOIN keyed c ON c.nm = n.b_street WHERE house = b_house),
  fnd AS (SELECT lat, lon, min(ring) AS ring FROM (SELECT *, {_SIM} AS score FROM sc) WHERE score >= 0.6 GROUP BY ALL)
  SELECT lat, lon, coalesce(places, 0) AS places, ring::double AS ring, CASE WHEN ring IS NOT NULL THEN 'found' WHEN places IS NOT NULL THEN 'nomatch' ELSE 'empty' END AS status
  FROM (SELECT DISTINCT lat, lon FROM pt) LEFT JOIN cnt USING (lat, lon) LEFT JOIN fnd USING (lat, lon)"""


@query("probe_candidates", _SURVEY, digits=6)
def _(spark, sf):
    return linkage.probe_candidates(*points_and_places(spark, sf)).select("lat", "lon", "places", "ring", "status")


@query("survey_coverage", "SELECT status, ring, count(*) AS points, sum(places)::bigint AS places FROM (" + _SURVEY + ") GROUP BY ALL", digits=6)
def _(spark, sf):
    return linkage.survey_coverage(linkage.probe_candidates(*points_and_places(spark, sf)))


@query("web_mercator", b.W_ADS + """SELECT id, round(radians(lon) * 6378137, 4) AS x, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) AS y FROM ads""")
def _(spark, sf):
    return b.ads(spark, sf).select("id", geo.mercator_x("lon").alias("x"), geo.mercator_y("lat").alias("y"))


@query("probe_points", b.with_(b.SQL_ADS, "pt AS (SELECT lat, lon, bool_and(o) AS all_new FROM (SELECT lat, lon, profile = 'garages' AS o FROM ads) GROUP BY ALL)",
        "k AS (SELECT 0 AS probe, 0.0 AS r, 0 AS i UNION ALL SELECT 1 + s, CASE WHEN s < 8 THEN 12.0 ELSE 25.0 END, s % 8 FROM range(16) t(s))") + """
  SELECT round(lat, 4) AS lat, round(lon, 4) AS lon, probe::bigint AS probe,
    round(radians(lon) * 6378137 + r / cos(radians(lat)) * cos(2 * pi() * i / 8), 4) AS x,
    round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)) + r / cos(radians(lat)) * sin(2 * pi() * i / 8), 4) AS y
  FROM pt, k WHERE probe <= CASE WHEN all_new THEN 8 ELSE 16 END""")
def _(spark, sf):
    points = b.ads(spark, sf).groupBy("lat", "lon").agg(F.bool_and(F.col("profile") == "garages").alias("all_new"))
    return linkage.probe_points(points, F.col("all_new")).select("lat", "lon", "probe", "x", "y")


# ---- register pages ----------------------------------------------------------------------

def register_pages(spark, sf):
    """A page per part as the register prints it: the building, then a segment for each of its lines."""
    text = lambda c: F.col(c).cast("string")
    field = lambda label, *value: F.concat(F.lit(f"<li>{label}: <strong>"), *value, F.lit("</strong></li>"))
    part = b.table(spark, sf, "part")
    lines = b.table(spark, sf, "lineitem").groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(
        F.max("l_quantity").alias("area"), F.max("l_extendedprice").cast("bigint").alias("lei")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    last = F.when(F.col("l_linenumber") == 7, "Da").when(F.col("l_linenumber") == 6, "?").otherwise("Nu")
    unit = F.concat(
        F.lit("<summary>U <strong> 01."), text("l_partkey"), F.lit("."), text("l_orderkey"), F.lit("."), text("l_linenumber"), F.lit("</strong></summary>"),
        field("Adresa", F.lit("str. "), F.col("p_name"), F.lit(" "), text("p_size"), F.lit(" ap. "), (F.col("l_orderkey") % 100).cast("string")),
        field("Suprafața ", F.replace(text("area"), F.lit("."), F.lit(","))), field("Tipul", F.lit("<b>"), F.col("p_type"), F.lit("</b>")),
        field("Etajul", text("l_linenumber")), field("Veceu", F.lit("da")), field("Baie", F.lit("nu")), field("Ultimul etaj", last),
        field("Valoarea estimată", (F.col("lei") / 1000).cast("int").cast("string"), F.lit(" "), F.lpad((F.col("lei") % 1000).cast("string"), 3, "0"), F.lit(" lei")))
    units = (lines.select("l_partkey", F.struct("l_orderkey", "l_linenumber", unit.alias("html")).alias("u")).groupBy("l_partkey")
             .agg(F.array_join(F.sort_array(F.collect_list("u"))["html"], "").alias("units")))  # a page is a text of one building
    head = F.concat(
        F.lit("<div><summary class='x'>Cod <strong> 01."), text("p_partkey"), F.lit(" </strong></summary><ul>"),
        field("Adresa", F.lit("mun. Oraș, sect. Centru str. "), F.col("p_name"), F.lit(", "), text("p_size"), F.lit("/A")),
        field("Clasificator", F.col("p_type")), field("Anul construcției", (F.col("p_size") + 1950).cast("string")),
        field("Numărul de etaje ", (F.col("p_size") % 10).cast("string"), F.lit(" etaje")), field("Starea", F.lit("bun&abreve;")),
        field("Materialul pereților", F.col("p_brand")), field("Apă", F.lit("da")), field("Apa caldă", F.lit("nu")), field("Gaz", F.lit("da")),
        field("Canalizare", F.lit("da")), field("Complet electrificat", F.lit("da")), field("Alt câmp", F.col("p_brand"), F.lit(" &amp; altele")),
        field("Valoarea estimată", F.lit("1 "), F.lpad(text("p_size"), 3, "0"), F.lit(" 000 lei")), F.lit("</ul>"))
    day = F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")
    html = F.concat(head, F.coalesce("units", F.lit("")), F.lit("Data actualizării: "), day, F.lit(".06.2024</div>"))
    return part.join(units, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        html.alias("html"), F.concat(F.lit('{"id": '), text("p_partkey"), F.lit("}")).alias("geometry"))


@query("register_buildings", """SELECT '01.' || p_partkey AS code, 'mun. Oraș, sect. Centru str. ' || p_name || ', ' || p_size || '/A' AS address, 'str. ' || p_name AS street, p_size || '/A' AS house,
    p_type AS classifier, p_size + 1950 AS year_built, p_size % 10 AS floors, 'bună' AS condition, p_brand AS walls, 'da' AS gas, 'da' AS water, 'da' AS sewer, 'da' AS electrified,
    (1000 + p_size) * 1000 AS value_lei, lpad((p_size % 28 + 1)::varchar, 2, '0') || '.06.2024' AS updated, 'Alt câmp=' || p_brand || ' & altele|Apa caldă=nu' AS props,
    '{"id": ' || p_partkey || '}' AS geometry FROM part""")
def _(spark, sf):
    found = pages.parse_buildings(register_pages(spark, sf))
    return found.withColumn("props", maps.as_text(F.col("props")))


@query("register_units", """SELECT '01.' || l_partkey || '.' || l_orderkey || '.' || l_linenumber AS code, '01.' || l_partkey AS building,
    'str. ' || p_name || ' ' || p_size || ' ap. ' || l_orderkey % 100 AS address, (l_orderkey % 100)::varchar AS apt, round(max(l_quantity), 4) AS area, p_type AS kind,
    l_linenumber::bigint AS floor, 'da' AS wc, 'nu' AS bath, CASE l_linenumber WHEN 7 THEN 1 WHEN 6 THEN NULL ELSE 0 END::bigint AS last_floor, trunc(max(l_extendedprice))::bigint AS value_lei
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey, l_orderkey, l_linenumber, p_name, p_size, p_type""")
def _(spark, sf):
    return pages.parse_units(register_pages(spark, sf))
