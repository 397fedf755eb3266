"""Queries over listings: projections, filters, joins, pages and deals."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.registry import query
from stallwise import vocab
from stallwise.functions import labels, prices
from stallwise.functions.geo import within_bbox
from stallwise.operators import benchmark, filters, joins, mapview, paging
from stallwise.operators.skew import group_rank
from stallwise.sources.sinks import stored

L, P, A = b.W_LIST, b.W_PRICED, b.W_ADS
APT = "profile = 'apartments' AND gone_at IS NULL"
AS_OF = f"TIMESTAMP '{b.AS_OF_TEXT}'"


# ---- projections -------------------------------------------------------------------------

@query("unit_price", L + "SELECT id, round(ppm, 8) AS ppm FROM listings", digits=8)
def _(spark, sf):
    return b.listings(spark, sf, False).select("id", "ppm")


@query("price_drop", A + """SELECT id, round(price - prev_price, 4) AS drop_abs,
  round(CASE WHEN prev_price > 0 THEN (price - prev_price) * 100 / prev_price END, 4) AS drop_pct FROM ads""")
def _(spark, sf):
    return b.ads(spark, sf).select("id", prices.drop_abs().alias("drop_abs"), prices.drop_pct().alias("drop_pct"))


@query("effective_drop", A + """, e AS (SELECT id,
    coalesce(price - prev_price, CASE WHEN old_price <> 0 AND old_price > price THEN price - old_price END) AS d,
    coalesce(prev_price, old_price) AS base FROM ads)
  SELECT id, round(d, 4) AS drop_abs, round(CASE WHEN d <> 0 AND base <> 0 THEN d / base * 100 END, 4) AS drop_pct FROM e""")
def _(spark, sf):
    return b.ads(spark, sf).select("id", prices.effective_drop_abs().alias("drop_abs"),
                                   prices.effective_drop_pct().alias("drop_pct"))


@query("discount_vs_median", P + "SELECT id, round(med_ppm, 8) AS med_ppm, round(discount, 8) AS discount FROM priced", digits=8)
def _(spark, sf):
    return b.priced(spark, sf).select("id", "med_ppm", "discount")


@query("vs_median", P + "SELECT id, pool_n, round(vs_med, 4) AS vs_med FROM priced")
def _(spark, sf):
    return b.priced(spark, sf).select("id", "pool_n", "vs_med")


@query("suspect_flag", P + "SELECT id, suspect::bigint AS suspect FROM priced")
def _(spark, sf):
    return b.priced(spark, sf).select("id", "suspect")


@query("listing_age_days", L + f"""SELECT id, age::bigint AS age, CASE WHEN age IS NULL THEN NULL WHEN age = 0 THEN 'today'
    WHEN age <= 3 THEN 'new' ELSE 'older' END AS bucket
  FROM (SELECT id, date_diff('day', posted::date, DATE '2001-10-01') AS age FROM listings)""")
def _(spark, sf):
    age = labels.age_days("posted", labels.as_ntz("2001-10-01 00:00:00"))
    return b.listings(spark, sf, False).select("id", age.alias("age"), labels.age_bucket(age).alias("bucket"))


@query("is_new", b.with_(b.SQL_ADS, b.SQL_BASE) + """SELECT id, profile, (first_seen > baseline)::bigint AS is_new
  FROM ads LEFT JOIN base USING (profile)""")
def _(spark, sf):
    base = joins.baselines(b.runs(spark, sf))
    return (b.ads(spark, sf).join(base, "profile", "left")
            .select("id", "profile", labels.is_new(F.col("first_seen"), F.col("baseline")).alias("is_new")))


VIEW = ("id", "profile", "title", "price", "currency", "old_price", "prev_price", "price_changed_at", "first_seen",
        "gone_at", "lat", "lon", "posted", "views_total", "rooms_n", "area", "floor", "floors_total",
        "housing_stock", "district", "street", "house", "developer", "author_type", "owner_is_business",
        "photos_count", "terms_flag", "ppm", "drop_abs", "drop_pct", "favorite", "hidden", "note")
_STAMPS = {"price_changed_at", "first_seen", "gone_at", "posted"}
_REALS = {"price", "old_price", "prev_price", "lat", "lon", "area", "ppm", "drop_abs", "drop_pct"}
_INTS = {"rooms_n", "floor", "floors_total", "owner_is_business", "terms_flag", "favorite", "hidden"}


def sql_columns(names):
    out = []
    for n in names:
        if n in _STAMPS:
            out.append(f"strftime({n}, '%Y-%m-%d %H:%M:%S') AS {n}")
        elif n in _REALS:
            out.append(f"round({n}, 4) AS {n}")
        elif n in _INTS:
            out.append(f"{n}::bigint AS {n}")
        else:
            out.append(n)
    return ", ".join(out)


@query("display_tags", b.with_(b.SQL_ADS, b.SQL_DET, b.SQL_FLAGS, b.SQL_LISTINGS, b.SQL_BASE) + f"""
  SELECT id, concat_ws('|', CASE WHEN first_seen > baseline THEN 'new in base' END,
    CASE WHEN age = 0 THEN 'posted today' WHEN age <= 3 THEN 'posted ' || age || ' days ago' END,
    CASE WHEN terms_flag = 1 THEN 'terms' END, CASE WHEN owner_is_business = 1 THEN 'agency' END,
    nullif(housing_stock, ''), nullif(developer, '')) AS tags
  FROM (SELECT *, date_diff('day', posted::date, {AS_OF}::date) AS age FROM listings) LEFT JOIN base USING (profile)""")
def _(spark, sf):
    base = joins.baselines(b.runs(spark, sf))
    tags = labels.display_tags(
        is_new=labels.is_new(F.col("first_seen"), F.col("baseline")), age=labels.age_days("posted", b.as_of()),
        terms=F.col("terms_flag"), business=F.col("owner_is_business"), stock=F.col("housing_stock"),
        developer=F.col("developer"))
    return (b.listings(spark, sf, False).join(base, "profile", "left")
            .select("id", F.array_join(tags, "|").alias("tags")))


@query("map_projection", L + """, p AS (SELECT *, count(*) OVER () AS total FROM listings WHERE lat IS NOT NULL AND lon IS NOT NULL)
  SELECT id, round(lat, 8) AS lat, round(lon, 8) AS lon, round(price, 8) AS price, rooms_n::bigint AS rooms_n, district,
    CASE WHEN photos_count > 0 THEN 'img' || id || '-1' END AS photo, round(ppm, 8) AS ppm,
    round(drop_pct, 8) AS drop_pct, favorite::bigint AS favorite, total, (total > 12000)::bigint AS capped
  FROM p ORDER BY id::varchar LIMIT 12000""", digits=8)
def _(spark, sf):
    df = b.listings(spark, sf)
    photos = F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest("photos_count", F.lit(1))),
                         lambda i: F.concat(F.lit("img"), F.col("id").cast("string"), F.lit("-"), i.cast("string")))
    df = df.withColumn("photos", F.when(F.col("photos_count") > 0, photos))
    points = mapview.map_points(df)
    return points.select("id", "lat", "lon", "price", "rooms_n", "district", F.get("photos", F.lit(0)).alias("photo"),
                         "ppm", "drop_pct", "favorite", "total", "capped")


# ---- filters -----------------------------------------------------------------------------

def _filter(name, predicate, where, source="listings", prelude=L):
    @query(name, prelude + f"SELECT id, round(price, 4) AS price FROM {source} WHERE {where}")
    def _(spark, sf):
        df = b.priced(spark, sf) if source == "priced" else b.listings(spark, sf)
        return df.where(predicate()).select("id", "price")


@query("filter_lifecycle", A + """SELECT state, id FROM (
    SELECT 'active' AS state, id, profile FROM ads WHERE gone_at IS NULL
    UNION ALL SELECT 'gone', id, profile FROM ads WHERE gone_at IS NOT NULL
    UNION ALL SELECT 'both', id, profile FROM ads) WHERE profile = 'apartments'""")
def _(spark, sf):
    df = b.ads(spark, sf).where(F.col("profile") == "apartments")
    states = F.array_compact(F.array(F.when(filters.lifecycle(None), "active"), F.when(filters.lifecycle("1"), "gone"),
                                     F.when(filters.lifecycle("both"), "both")))
    return df.select(F.explode(states).alias("state"), "id")


_filter("filter_new_posted", lambda: filters.posted_within(90, b.as_of()), f"posted > {AS_OF} - INTERVAL 90 DAY")
_filter("filter_price_down", prices.is_price_down,
        "coalesce(drop_abs < 0, false) OR coalesce(old_price > price, false)")


@query("filter_new_base", b.with_(b.SQL_ADS, b.SQL_BASE) + """SELECT id, round(price, 4) AS price FROM ads
  LEFT JOIN base USING (profile) WHERE baseline IS NULL OR first_seen > baseline""")
def _(spark, sf):
    df = filters.after_baseline(b.ads(spark, sf), joins.baselines(b.runs(spark, sf)))
    return df.select("id", "price")


@query("filter_ids", b.with_(b.SQL_ADS, b.SQL_FLAGS) + """SELECT id, round(price, 4) AS price FROM ads
  WHERE id IN (SELECT id FROM flags WHERE favorite = 1)""")
def _(spark, sf):
    favourites = b.flags(spark, sf).where(F.col("favorite") == 1).select("id")
    return filters.in_ids(b.ads(spark, sf), favourites).select("id", "price")


@query("filter_hidden", L + "SELECT id, hidden::bigint AS hidden, CASE WHEN hidden = 1 THEN 'hidden' ELSE 'shown' END AS tab FROM listings")
def _(spark, sf):
    df = b.listings(spark, sf)
    shown = filters.apply_filters(df, {"gone": "both"}, as_of=b.as_of()).withColumn("tab", F.lit("shown"))
    hidden = filters.apply_filters(df, {"gone": "both", "tab": "hidden"}, as_of=b.as_of()).withColumn("tab", F.lit("hidden"))
    return shown.unionByName(hidden).select("id", "hidden", "tab")


_BOUNDS = dict(price_min=50000, price_max=400000, ppm_min=500, ppm_max=30000, area_min=5, area_max=45, floor_min=1,
               floor_max=6, floors_min=5, floors_max=9, views_min=10, photos_min=1)
_filter("filter_ranges", lambda: filters.conjunction(filters.ranges(_BOUNDS)),
        """price >= 50000 AND price <= 400000 AND ppm >= 500 AND ppm <= 30000 AND area >= 5 AND area <= 45
           AND floor >= 1 AND floor <= 6 AND floors_total >= 5 AND floors_total <= 9 AND views_total >= 10
           AND photos_count >= 1""")
_filter("filter_rooms", lambda: filters.rooms([2, 5]), "rooms_n >= 5 OR rooms_n IN (2)")
_filter("filter_in_sets", lambda: F.col("district").isin("NATION_1", "NATION_7", "NATION_12")
        & F.col("housing_stock").isin("O") & F.col("developer").isin("Brand#1", "Brand#2", "Brand#3", "Brand#17"),
        """district IN ('NATION_1', 'NATION_7', 'NATION_12') AND housing_stock IN ('O')
           AND developer IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#17')""")


@query("filter_author", L + """SELECT kind, id FROM (
    SELECT 'private' AS kind, id FROM listings WHERE author_type = 'N' OR (coalesce(author_type, '') = '' AND coalesce(owner_is_business, 0) = 0)
    UNION ALL SELECT 'business', id FROM listings WHERE author_type = 'A' OR (coalesce(author_type, '') = '' AND coalesce(owner_is_business, 0) = 1)
    UNION ALL SELECT 'developer', id FROM listings WHERE author_type = 'R')""")
def _(spark, sf):
    kinds = F.array_compact(F.array(*[F.when(filters.author(k, b.AUTHORS), k) for k in ("private", "business", "developer")]))
    return b.listings(spark, sf, False).select(F.explode(kinds).alias("kind"), "id")


_FN = vocab.FEATURE_NAMES
_filter("filter_feature_map", lambda: filters.feature_in(_FN["condition"], ["ECONOMY", "SMALL", "PROMO"])
        & filters.feature_in(_FN["building"], ["Brand#4", "Brand#11", "Brand#17", "Brand#20"]),
        "f_condition IN ('ECONOMY', 'SMALL', 'PROMO') AND f_building IN ('Brand#4', 'Brand#11', 'Brand#17', 'Brand#20')")


@query("filter_amenities", L + """SELECT amenity, id FROM (
    SELECT 'lift' AS amenity, id FROM listings WHERE f_lift = 'True'
    UNION ALL SELECT 'parking', id FROM listings WHERE f_parking IS NOT NULL
    UNION ALL SELECT 'baths2', id FROM listings WHERE f_baths IN ('2', '3', '4 и более')
    UNION ALL SELECT 'balcony', id FROM listings WHERE f_balcony NOT IN ('Нет', ''))""")
def _(spark, sf):
    # every amenity of the vocabulary is tested; the ones without data select nothing
    hits = F.array_compact(F.array(*[F.when(filters.amenity(k), k) for k in vocab.AMENITIES]))
    return b.listings(spark, sf, False).select(F.explode(hits).alias("amenity"), "id")


_filter("filter_floor_rules", lambda: filters.not_first_floor() & filters.not_last_floor(),
        "floor > 1 AND (floors_total IS NULL OR floor < floors_total)")
_filter("filter_has_photo", filters.has_photo, "coalesce(photos_count, 0) > 0")
_filter("filter_hide_suspect", lambda: F.coalesce("suspect", F.lit(0)) == 0, "coalesce(suspect, 0) = 0", "priced", P)


@query("filter_text_search", """SELECT 'documents' AS src, doc_id AS id FROM documents WHERE text ILIKE '%tion%' OR doc_id::varchar ILIKE '%tion%'
  UNION ALL SELECT 'part', p_partkey FROM part WHERE p_name ILIKE '%tion%' OR p_type ILIKE '%ion%'
     OR p_name ILIKE '%ion%' OR p_partkey::varchar ILIKE '%ion%'""")
def _(spark, sf):
    docs = b.table(spark, sf, "documents").where(filters.text_search("tion", ["text", "doc_id"]))
    parts = b.table(spark, sf, "part").where(filters.text_search("ION", ["p_name", "p_type", "p_partkey"]))
    return docs.select(F.lit("documents").alias("src"), F.col("doc_id").alias("id")).unionByName(
        parts.select(F.lit("part").alias("src"), F.col("p_partkey").alias("id")))


_GATE = (f"floor > 1 AND floor < floors_total AND area BETWEEN {b.POOL['min_area']} AND {vocab.AREA_MAX} AND rooms_n IS NOT NULL "
         f"AND housing_stock <> '' AND area / greatest(rooms_n, 1) <= {vocab.AREA_PER_ROOM_MAX} AND price >= {vocab.PRICE_FLOOR} "
         f"AND ppm BETWEEN {vocab.PPM_DEAL_RANGE[0]} AND {vocab.PPM_DEAL_RANGE[1]}")
_filter("filter_deal_rules", lambda: filters.deal_rules(**b.POOL), _GATE)
_filter("bbox_filter", lambda: within_bbox("lat", "lon", (46.95, 28.6, 47.05, 29.0)),
        "lat BETWEEN 46.95 AND 47.05 AND lon BETWEEN 28.6 AND 29.0")


@query("filter_combined", P + f"""SELECT id, round(price, 8) AS price, round(ppm, 8) AS ppm FROM priced
  WHERE {APT} AND coalesce(hidden, 0) = 0 AND price >= 50000 AND area <= 45 AND (rooms_n >= 5 OR rooms_n IN (1, 2))
    AND (author_type = 'A' OR (coalesce(author_type, '') = '' AND coalesce(owner_is_business, 0) = 1))
    AND f_lift = 'True' AND floor > 1 AND coalesce(photos_count, 0) > 0 AND coalesce(suspect, 0) = 0
    AND (title ILIKE '%low%' OR street ILIKE '%low%' OR id::varchar ILIKE '%low%')""", digits=8)
def _(spark, sf):
    spec = {"profile": "apartments", "price_min": 50000, "area_max": 45, "rooms": [1, 2, 5], "author": "business",
            "amen": ["lift"], "not_first": True, "has_photo": True, "hide_suspect": True, "q": "low"}
    view = b.priced(spark, sf, "hidden", "author_type", "owner_is_business", "features", "floor", "photos_count",
                    "title", "street")
    df = filters.apply_filters(view, spec, as_of=b.as_of(), authors=b.AUTHORS)
    return df.select("id", "price", "ppm")


# ---- joins -------------------------------------------------------------------------------

@query("inner_details", b.with_(b.SQL_ADS, b.SQL_DET) + "SELECT id, round(price, 4) AS price, round(area, 4) AS area, district FROM ads JOIN det USING (id)")
def _(spark, sf):
    return joins.with_details(b.ads(spark, sf), b.details(spark, sf)).select("id", "price", "area", "district")


@query("left_details", L + "SELECT id, round(area, 4) AS area, district, favorite::bigint AS favorite, hidden::bigint AS hidden, note FROM listings")
def _(spark, sf):
    return b.listings(spark, sf).select("id", "area", "district", "favorite", "hidden", "note")


@query("left_benchmark", P + "SELECT id, district, rooms_n::bigint AS rooms_n, housing_stock, round(med_ppm, 8) AS med_ppm, pool_n FROM priced", digits=8)
def _(spark, sf):
    return b.priced(spark, sf).select("id", "district", "rooms_n", "housing_stock", "med_ppm", "pool_n")


@query("anti_missing_details", b.with_(b.SQL_ADS, b.SQL_DET) + "SELECT id, profile FROM ads WHERE gone_at IS NULL AND id NOT IN (SELECT id FROM det)")
def _(spark, sf):
    return joins.missing_details(b.ads(spark, sf), b.details(spark, sf)).select("id", "profile")


@query("refetch_after_change", b.with_(b.SQL_ADS, b.SQL_DET) + """SELECT id, profile FROM ads JOIN det USING (id)
  WHERE gone_at IS NULL AND price_changed_at IS NOT NULL AND price_changed_at > fetched_at""")
def _(spark, sf):
    return joins.changed_since_fetch(b.ads(spark, sf), b.details(spark, sf)).select("id", "profile")


@query("stale_details", b.with_(b.SQL_ADS, b.SQL_DET) + f"""SELECT id, profile FROM ads LEFT JOIN det USING (id)
  WHERE gone_at IS NULL AND (fetched_at IS NULL OR fetched_at < {AS_OF} - INTERVAL 365 DAY)""")
def _(spark, sf):
    return joins.stale_details(b.ads(spark, sf), b.details(spark, sf), 365, b.as_of()).select("id", "profile")


@query("work_selection", b.with_(b.SQL_ADS, b.SQL_DET) + f"""SELECT * FROM (
    (SELECT 'missing' AS mode, id FROM ads WHERE gone_at IS NULL AND id NOT IN (SELECT id FROM det) ORDER BY first_seen DESC, id LIMIT 100)
    UNION ALL (SELECT 'changed', id FROM ads JOIN det USING (id) WHERE gone_at IS NULL AND price_changed_at > fetched_at ORDER BY first_seen DESC, id LIMIT 100)
    UNION ALL (SELECT 'stale', id FROM ads LEFT JOIN det USING (id) WHERE gone_at IS NULL AND (fetched_at IS NULL OR fetched_at < {AS_OF} - INTERVAL 365 DAY) ORDER BY first_seen DESC, id LIMIT 100)
    UNION ALL SELECT 'all', id FROM ads WHERE gone_at IS NULL)""")
def _(spark, sf):
    ads, det = b.ads(spark, sf), b.details(spark, sf)
    parts = [joins.work_selection(ads, det, m, as_of=b.as_of(), days=365, limit=None if m == "all" else 100)
             .select(F.lit(m).alias("mode"), "id") for m in ("missing", "changed", "stale", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# ---- pages, benchmark, deals -------------------------------------------------------------

@query("segment_median", b.W_BENCH + "SELECT district, rooms_n::bigint AS rooms_n, housing_stock, round(med_ppm, 8) AS med_ppm, pool_n FROM bench", digits=8)
def _(spark, sf):
    return b.bench(b.slim(spark, sf))


@query("rank_in_segment", b.W_BENCH + """SELECT id, district, rooms_n::bigint AS rooms_n, housing_stock, round(ppm, 8) AS ppm,
  row_number() OVER (PARTITION BY district, rooms_n, housing_stock ORDER BY ppm, id) AS rn,
  count(*) OVER (PARTITION BY district, rooms_n, housing_stock) AS cnt FROM pool""", digits=8)
def _(spark, sf):
    view = b.slim(spark, sf)
    pool = view.where(benchmark.active_pool() & filters.pool_rules(**b.POOL))
    keys = list(benchmark.SEGMENT)
    return group_rank(pool.select("id", *keys, "ppm"), keys, "ppm", ["id"]).select("id", *keys, "ppm", "rn", "cnt")


@query("sorted_page", P + """SELECT * FROM (
  (SELECT 'ppm asc' AS page, id, round(ppm, 4) AS v FROM priced ORDER BY ppm IS NULL, ppm ASC, id::varchar DESC LIMIT 100 OFFSET 50)
  UNION ALL (SELECT 'drop_pct desc', id, round(drop_pct, 4) FROM priced ORDER BY drop_pct IS NULL, drop_pct DESC, id::varchar DESC LIMIT 500)
  UNION ALL (SELECT 'area asc', id, round(area, 4) FROM priced ORDER BY area IS NULL, area ASC, id::varchar DESC LIMIT 100)
  UNION ALL (SELECT 'discount desc', id, round(discount, 4) FROM priced ORDER BY discount IS NULL, discount DESC, id::varchar DESC LIMIT 100)
  UNION ALL SELECT 'total', count(*), NULL FROM priced)""")
def _(spark, sf):
    df = stored(b.priced(spark, sf, "drop_pct").select("id", "ppm", "drop_pct", "area", "discount"), "priced")

    def page(key, direction, limit=100, offset=0):
        return paging.sort_page(df, key, direction, limit, offset).select(
            F.lit(f"{key} {direction}").alias("page"), "id", F.col(paging.SORT_COLUMNS[key]).alias("v"))
    total = paging.page_total(df).select(F.lit("total").alias("page"), F.col("total").alias("id"),
                                         F.lit(None).cast("double").alias("v"))
    return (page("ppm", "asc", offset=50).unionByName(page("drop_pct", "desc", 500))
            .unionByName(page("area", "asc")).unionByName(page("discount", "desc")).unionByName(total))


def deals(spark, sf, pool_min):
    view = b.slim(spark, sf, "floor", "floors_total")
    d = benchmark.deals(view, pool_min=pool_min, bench=b.bench(view), **b.POOL)
    return d.select("id", "district", "rooms_n", "housing_stock", "price", "area", "ppm", "med_ppm", "pool_n", "discount")


@query("deals", P + f"""SELECT id, district, rooms_n::bigint AS rooms_n, housing_stock, round(price, 8) AS price, round(area, 8) AS area,
    round(ppm, 8) AS ppm, round(med_ppm, 8) AS med_ppm, pool_n, round(discount, 8) AS discount
  FROM priced WHERE {APT} AND {_GATE} AND pool_n >= 8 AND discount BETWEEN 15 AND 60 AND terms_flag = 0
  ORDER BY discount DESC, id::varchar DESC""", digits=8)
def _(spark, sf):
    return deals(spark, sf, vocab.POOL_MIN).orderBy(F.col("discount").desc(), F.col("id").cast("string").desc())
