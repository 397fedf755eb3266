"""Whole requests: list pages, map layers, trends and listing cards."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.changes import _fold, _snap, folded
from catalog.listings import _GATE
from catalog.register import LADDER, sql_side, units, wanted
from catalog.registry import query
from stallwise import vocab
from stallwise.operators import joins, linkage, snapshots
from stallwise.plans import requests

_BENCH = (b.SQL_ADS, b.SQL_DET, b.SQL_FLAGS, b.SQL_LISTINGS, b.SQL_POOL, b.SQL_BENCH, b.SQL_PRICED)


@query("list_request", b.with_(*_BENCH, b.SQL_BASE, _snap(), _fold(), recursive=True) + f""", f AS (SELECT *, count(*) OVER () AS total FROM priced
    WHERE profile = 'apartments' AND gone_at IS NULL AND {_GATE} AND pool_n >= 8 AND discount >= 15 AND discount <= 60 AND terms_flag = 0 AND hidden = 0),
  h AS (SELECT id, string_agg(run || '=' || printf('%.2f', stored), ',' ORDER BY run) AS series FROM fold WHERE is_point GROUP BY id HAVING count(*) > 1)
  SELECT f.id, round(discount, 8) AS discount, total, (first_seen > baseline)::bigint AS is_new, series FROM f LEFT JOIN base USING (profile) LEFT JOIN h ON h.id = f.id
  ORDER BY discount DESC, f.id::varchar DESC LIMIT 100""", digits=8)
def _(spark, sf):
    view = b.priced(spark, sf, "first_seen", "hidden", "floor", "floors_total")
    spec = {"tab": "deals", "min_area": 1, "city": None}
    page = requests.list_request(view, spec, as_of=b.as_of(), baselines=joins.baselines(b.runs(spark, sf)),
                                 history=snapshots.price_history(folded(spark, sf)))
    series = F.transform("series", lambda p: F.format_string("%s=%.2f", p["ts"].cast("string"), p["price"]))
    return page.select("id", "discount", "total", "is_new", F.array_join(series, ",").alias("series"))


@query("map_request", b.W_PRICED + """, f AS (SELECT *, count(*) OVER () AS total FROM priced WHERE profile = 'garages' AND hidden = 0 AND price >= 100000
    AND (coalesce(drop_abs < 0, false) OR coalesce(old_price > price, false)))
  SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, total, (total > 2000)::bigint AS capped FROM f ORDER BY id::varchar LIMIT 2000""", digits=6)
def _(spark, sf):
    view = b.priced(spark, sf, "lat", "lon", "hidden", "prev_price", "old_price")
    spec = {"profile": "garages", "gone": "both", "tab": "down", "price_min": 100000, "limit": 2000}
    return requests.map_request(view, spec, as_of=b.as_of()).select("id", "lat", "lon", "total", "capped")


@query("trend_request", b.with_(*_BENCH[:4]) + f""", f AS (SELECT *, {b.SQL_FLOOR} AS series,
      strftime(posted, '%Y-%m') AS month FROM listings WHERE profile = 'apartments' AND hidden = 0 AND rooms_n IN (1, 2) AND price > 0
      AND posted >= TIMESTAMP '2000-12-01' AND posted < TIMESTAMP '2001-12-01'),
  c AS (SELECT series, month, count(*) AS n, quantile_cont(price, 0.5) AS med_price FROM f GROUP BY ALL),
  s AS (SELECT DISTINCT series FROM c), m AS (SELECT strftime(unnest(generate_series(min((month || '-01')::timestamp), max((month || '-01')::timestamp), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM c)
  SELECT series, month, list_position({list(vocab.TREND_ORDER['floor'])}, series) AS place, coalesce(n, 0) AS n, round(med_price, 5) AS med_price
  FROM s, m LEFT JOIN c USING (series, month)""".replace("FROM s, m LEFT JOIN c USING (series, month)", "FROM (SELECT * FROM s, m) LEFT JOIN c USING (series, month)"), digits=5)
def _(spark, sf):
    view = b.listings(spark, sf)
    spec = {"gone": "both", "rooms": [1, 2], "group": "floor", "months": 12}
    cube = requests.trend_request(view, spec, as_of=b.as_of(), authors=b.AUTHORS)
    return cube.select("series", "month", "place", "n", "med_price")


@query("listing_360", b.with_(*_BENCH, sql_side("f", "F"), _snap(), _fold(), recursive=True) + """,
  u AS (SELECT l_partkey AS building, l_linenumber AS floor, l_quantity AS unit_area, round(l_extendedprice)::bigint AS value FROM f),
  p AS (SELECT l.id, u.value, CASE WHEN unit_area BETWEEN area * 0.95::double AND area * 1.05::double THEN 0.05 ELSE 0.1 END AS tier
    FROM listings l JOIN u ON u.building = l.views_total AND u.floor = l.floor AND u.value > 0 AND u.unit_area BETWEEN area * (1 - 0.1::double) AND area * (1 + 0.1::double)),
  best AS (SELECT id, min(tier) AS tolerance FROM p GROUP BY id),
  m AS (SELECT p.id, any_value(tolerance)::double AS tolerance, count(*) AS n, min(value) AS value_min, round_even(quantile_cont(value, 0.5), 0)::bigint AS value_med, max(value) AS value_max FROM p JOIN best ON best.id = p.id AND p.tier = best.tolerance GROUP BY p.id),
  h AS (SELECT id, string_agg(run || '=' || printf('%.2f', stored) || ' EUR', ',' ORDER BY run) AS history FROM fold WHERE is_point GROUP BY id)
  SELECT l.id, l.district, round(l.ppm, 8) AS ppm, round(l.med_ppm, 8) AS med_ppm, l.suspect::bigint AS suspect, h.history, m.tolerance, m.n, m.value_min, m.value_med, m.value_max,
    CASE WHEN m.n IS NOT NULL THEN l.views_total END AS building, CASE WHEN m.n IS NOT NULL THEN p_name || ', ' || p_size END AS address, CASE WHEN m.n IS NOT NULL THEN p_type END AS classifier,
    CASE WHEN m.n IS NOT NULL THEN p_size + 1950 END AS year_built, NULL::varchar AS phones, 'call [номер скрыт] now' AS description
  FROM priced l LEFT JOIN h ON h.id = l.id LEFT JOIN m ON m.id = l.id LEFT JOIN part ON p_partkey = l.views_total""", digits=8)
def _(spark, sf):
    view = b.priced(spark, sf, "views_total", "floor")
    view = view.withColumns({"phones": F.concat(F.lit("tel "), F.col("id").cast("string")),
                             "description": F.lit("call +373 (60) 123-456 now")})
    probes = view.select("id", F.col("views_total").alias("building"), "floor", "area")
    matches = linkage.match_listings(probes, units(spark, sf))
    buildings = b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("building"), F.concat_ws(", ", "p_name", "p_size").alias("address"), F.col("p_type").alias("classifier"),
        (F.col("p_size") + 1950).alias("year_built"))
    card = requests.listing_cards(view, snapshots.price_history(folded(spark, sf)), matches, buildings)
    points = F.transform("history", lambda p: F.format_string("%s=%.2f %s", p["run"].cast("string"), p["price"], p["currency"]))
    return card.select("id", "district", "ppm", "med_ppm", "suspect", F.array_join(points, ",").alias("history"), "register.building",
                       "register.tolerance", "register.n", "register.value_min", "register.value_med", "register.value_max",
                       "house.address", "house.classifier", "house.year_built", "phones", "description")


@query("listing_units", LADDER + """SELECT id, row_number() OVER (PARTITION BY id ORDER BY unit_area, code) AS place, code, unit_area, value
  FROM (SELECT m.id, p.code, p.unit_area, p.value FROM m JOIN p ON p.id = m.id AND p.tier <= m.tolerance)""")
def _(spark, sf):
    """Units of every matched listing as its card shows them."""
    listings, u = wanted(spark, sf), units(spark, sf)
    matches = linkage.match_listings(listings, u)
    return requests.listing_units(listings, matches, u).select("id", "place", "code", "unit_area", "value")
