"""Queries over the monthly trend cube."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.registry import query
from stallwise import vocab
from stallwise.functions import labels
from stallwise.plans import trends
from stallwise.sources.sinks import stored

NONE = f"'{vocab.ALL_LISTINGS}'"
ROOMS = (f"CASE WHEN rooms_n = 0 THEN '{vocab.STUDIO}' WHEN rooms_n >= 5 THEN '{vocab.ROOMS_TOP}' "
         f"ELSE rooms_n || '{vocab.ROOMS_SUFFIX}' END")
DISTRICT = "nullif(district, '')"
MIN_N = 2


def sql_cells(group, where="profile = 'apartments' AND gone_at IS NULL", months=24, name="cells"):
    return f"""{name} AS (
  SELECT strftime(posted, '%Y-%m') AS month, coalesce({group}, 'не указано') AS series, count(*) AS n,
    avg(price) AS avg_price, quantile_cont(price, 0.5) AS med_price,
    quantile_cont(ppm, 0.5) FILTER (ppm BETWEEN 100 AND 25000) AS med_ppm,
    quantile_cont(ppm, 0.25) FILTER (ppm BETWEEN 100 AND 25000) AS p25_ppm,
    quantile_cont(ppm, 0.75) FILTER (ppm BETWEEN 100 AND 25000) AS p75_ppm,
    avg(ppm) FILTER (ppm BETWEEN 100 AND 25000) AS avg_ppm,
    count(*) FILTER (ppm BETWEEN 100 AND 25000) AS n_ppm,
    quantile_cont(area, 0.5) FILTER (area <> 0) AS med_area
  FROM listings WHERE {where} AND price > 0 AND posted >= TIMESTAMP '2001-11-01' - INTERVAL {months - 1} MONTH
    AND posted < TIMESTAMP '2001-12-01' GROUP BY 1, 2)"""


FILLED = """filled AS (
  SELECT s.series, strftime(m, '%Y-%m') AS month, coalesce(c.n, 0) AS n, c.* EXCLUDE (series, month, n)
  FROM (SELECT DISTINCT series FROM cells) s,
    (SELECT unnest(generate_series(min((month || '-01')::timestamp), max((month || '-01')::timestamp), INTERVAL 1 MONTH)) AS m FROM cells)
  LEFT JOIN cells c ON c.series = s.series AND c.month = strftime(m, '%Y-%m'))"""
TOPS = """tops AS (
  SELECT *, (SELECT count(*) FROM totals) - count(*) OVER () AS hidden, (SELECT sum(total) FROM totals) - sum(total) OVER () AS hidden_n
  FROM (SELECT *, row_number() OVER (ORDER BY {order} total DESC, series) AS place FROM totals) WHERE place <= 8)"""
TOTALS = "totals AS (SELECT series, sum(n)::bigint AS total FROM cells GROUP BY series)"
VALUES = f"vals AS (SELECT *, CASE WHEN n >= {MIN_N} THEN med_ppm END AS v, row_number() OVER (PARTITION BY series ORDER BY month) - 1 AS i FROM filled)"


def W(*ctes):
    return b.with_(b.SQL_ADS, b.SQL_DET, b.SQL_FLAGS, b.SQL_LISTINGS, *ctes)


BY_DISTRICT = W(sql_cells(DISTRICT), FILLED, VALUES)
BY_ROOMS = W(sql_cells(ROOMS), FILLED, VALUES)


def market(spark, sf, gone=False):
    view = b.listings(spark, sf, False).where(F.col("profile") == "apartments")
    return view if gone else view.where(F.col("gone_at").isNull())


def cells(spark, sf, group, months=24):
    """The cube, stored: the operators on top of it read it several times."""
    cube = trends.cells(market(spark, sf), labels.trend_groups(authors=b.AUTHORS)[group], b.as_of(), months)
    return stored(cube, "cube")


_KEYS = {
    "none": NONE, "rooms": ROOMS, "district": DISTRICT, "housing": "nullif(housing_stock, '')",
    "author": f"coalesce(nullif(author_type, ''), if(owner_is_business = 1, '{b.AUTHORS['business']}', '{b.AUTHORS['private']}'))",
    "area": f"if(area > 0, {b.sql_steps('area', vocab.AREA_BANDS)}, NULL)", "floor": b.SQL_FLOOR,
    "developer": "nullif(developer, '')", "kind": "nullif(f_condition, '')",
}


@query("trend_group_keys", W("keyed AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS grouping, coalesce({e}, '{vocab.UNSPECIFIED}') AS series FROM listings" for k, e in _KEYS.items()) + ")")
    + "SELECT grouping, series, count(*) AS n FROM keyed GROUP BY ALL")
def _(spark, sf):
    pairs = F.array(*[F.struct(F.lit(k).alias("grouping"), F.coalesce(e, F.lit(vocab.UNSPECIFIED)).alias("series"))
                      for k, e in labels.trend_groups(authors=b.AUTHORS).items()])
    return (b.listings(spark, sf, False).select(F.inline(pairs)).groupBy("grouping", "series")
            .agg(F.count(F.lit(1)).alias("n")))


_CELL_COLS = ("avg_price", "med_price", "med_ppm", "p25_ppm", "p75_ppm", "avg_ppm", "med_area")
_ROUNDED = ", ".join(f"round({c}, 5) AS {c}" for c in _CELL_COLS)


@query("trend_cells", W(sql_cells(DISTRICT)) + f"SELECT month, series, n, n_ppm, {_ROUNDED} FROM cells", digits=5)
def _(spark, sf):
    return cells(spark, sf, "district").select("month", "series", "n", "n_ppm", *_CELL_COLS)


@query("trend_gap_fill", BY_DISTRICT + "SELECT series, month, n, round(med_ppm, 5) AS med_ppm FROM filled", digits=5)
def _(spark, sf):
    return trends.fill(cells(spark, sf, "district")).select("series", "month", "n", "med_ppm")


_FIXED = "coalesce(nullif(list_position(['студия', '1-комн.', '2-комн.', '3-комн.', '4-комн.', '5+ комн.'], series), 0), 1000),"


@query("trend_top_series", W(sql_cells(DISTRICT), TOTALS, TOPS.format(order="")) + """
  SELECT 'district' AS grouping, series, place, total, hidden, hidden_n::bigint AS hidden_n FROM tops
  UNION ALL SELECT 'rooms', series, place, total, hidden, hidden_n FROM (""" + b.with_(
    sql_cells(ROOMS), TOTALS, TOPS.format(order=_FIXED)) + " SELECT series, place, total, hidden, hidden_n::bigint AS hidden_n FROM tops)")
def _(spark, sf):
    by_district = trends.top_series(cells(spark, sf, "district")).withColumn("grouping", F.lit("district"))
    by_rooms = trends.top_series(cells(spark, sf, "rooms"), order=vocab.TREND_ORDER["rooms"]).withColumn("grouping", F.lit("rooms"))
    return by_district.unionByName(by_rooms).select("grouping", "series", "place", "total", "hidden", "hidden_n")


@query("trend_cube", W(sql_cells(DISTRICT), FILLED, TOTALS, TOPS.format(order="")) + """
  SELECT series, month, place, total, n, round(med_ppm, 5) AS med_ppm, round(med_price, 5) AS med_price FROM filled JOIN tops USING (series)""", digits=5)
def _(spark, sf):
    cube = trends.trend_cube(market(spark, sf), labels.trend_groups()["district"], b.as_of())
    return cube.select("series", "month", "place", "total", "n", "med_ppm", "med_price")


@query("trend_min_n", BY_DISTRICT + "SELECT series, month, n, round(v, 5) AS value FROM vals", digits=5)
def _(spark, sf):
    cube = trends.suppress(trends.fill(cells(spark, sf, "district")), "med_ppm", MIN_N)
    return cube.select("series", "month", "n", "value")


@query("trend_smooth", BY_DISTRICT + """SELECT series, month, round(v, 5) AS value,
  round(CASE WHEN v IS NOT NULL THEN avg(v) OVER (PARTITION BY series ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END, 5) AS smoothed FROM vals""", digits=5)
def _(spark, sf):
    cube = trends.suppress(trends.fill(cells(spark, sf, "district")), "med_ppm", MIN_N)
    return trends.smooth(cube, 3).select("series", "month", "value", "smoothed")


@query("trend_mom_change", BY_DISTRICT + """SELECT series, month, round(CASE WHEN v <> 0 AND p <> 0 THEN (v - p) * 100 / p END, 5) AS mom_pct
  FROM (SELECT *, lag(v) OVER (PARTITION BY series ORDER BY month) AS p FROM vals)""", digits=5)
def _(spark, sf):
    return trends.mom(trends.fill(cells(spark, sf, "district")), "med_ppm", MIN_N).select("series", "month", "mom_pct")


@query("trend_kpis", BY_DISTRICT + """, l AS (SELECT *, lag(v, 3) OVER w AS p3, lag(v, 12) OVER w AS p12, max(i) FILTER (v IS NOT NULL) OVER (PARTITION BY series) AS last,
    min(i) FILTER (v IS NOT NULL) OVER (PARTITION BY series) AS first FROM vals WINDOW w AS (PARTITION BY series ORDER BY month)),
  f AS (SELECT series, v AS fv FROM l WHERE i = first),
  s AS (SELECT series, round(CASE WHEN count(v) >= 3 THEN regr_slope(v, i) / avg(v) * 100 END, 5) AS slope_pct FROM vals GROUP BY series)
  SELECT l.series, month, n, round(v, 5) AS value, round((v - p3) * 100 / p3, 5) AS d3, round((v - p12) * 100 / p12, 5) AS d12,
    round((v - fv) * 100 / fv, 5) AS span, slope_pct FROM l JOIN f USING (series) JOIN s USING (series) WHERE i = last""", digits=5)
def _(spark, sf):
    return trends.kpis(trends.fill(cells(spark, sf, "district")), "med_ppm", MIN_N)


@query("trend_slope", BY_DISTRICT + """SELECT series, count(v) AS points,
  round(CASE WHEN count(v) >= 3 THEN regr_slope(v, i) / avg(v) * 100 END, 5) AS slope_pct FROM vals GROUP BY series""", digits=5)
def _(spark, sf):
    return trends.slope(trends.fill(cells(spark, sf, "district")), "med_ppm", MIN_N)


_ROOM_SERIES = (*vocab.TREND_ORDER["rooms"], vocab.UNSPECIFIED)


@query("trend_pivot", BY_ROOMS + "SELECT month, " + ", ".join(
    f"round(max(v) FILTER (series = '{s}'), 5) AS \"{s}\"" for s in _ROOM_SERIES)
    + ", sum(n)::bigint AS total FROM vals GROUP BY month", digits=5)
def _(spark, sf):
    return trends.pivot(trends.fill(cells(spark, sf, "rooms")), "med_ppm", MIN_N, _ROOM_SERIES)


@query("monthly_report", W(sql_cells(NONE, "profile = 'apartments'", 12)) + """
  SELECT month, n, round(med_ppm, 5) AS med_ppm, round(med_price, 5) AS med_price FROM cells WHERE n >= 5 AND med_ppm <> 0""", digits=5)
def _(spark, sf):
    return trends.monthly_report(market(spark, sf, gone=True), b.as_of())
