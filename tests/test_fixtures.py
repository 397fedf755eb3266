"""Hand-computed answers for the semantics that are easy to get wrong. All values are invented."""
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stallwise.functions import prices, text
from stallwise.operators import benchmark, cards, filters, linkage, mapview, paging, skew, snapshots
from stallwise.plans import trends


def log(spark, rows):
    return spark.createDataFrame([(i, r, p, c) for i, r, p, c in rows], "id int, run int, price double, currency string")


def changes(spark, rows):
    _, history, _ = snapshots.replay(log(spark, rows))
    return [(r.id, r.run, r.prev_price, r.price) for r in history.where("prev_price is not null").orderBy("id", "run").collect()]


def test_drift_accumulates_against_the_stored_price(spark):
    assert changes(spark, [(1, 1, 100.0, "EUR"), (1, 2, 100.4, "EUR"), (1, 3, 100.8, "EUR")]) == [(1, 3, 100.0, 100.8)]


def test_null_prices_never_change(spark):
    rows = [(1, 1, None, "EUR"), (1, 2, 50.0, "EUR"), (2, 1, 50.0, "EUR"), (2, 2, None, "EUR"), (2, 3, 60.0, "EUR")]
    assert changes(spark, rows) == [(2, 3, 50.0, 60.0)]
    state = {r.id: r.price for r in snapshots.replay(log(spark, rows)).state.collect()}
    assert state == {1: None, 2: 60.0}


def test_currency_change_counts_as_up(spark):
    _, history, audit = snapshots.replay(log(spark, [(1, 1, 100.0, "EUR"), (1, 2, 100.0, "USD")]))
    assert history.where("prev_price = 100").count() == 1
    assert audit.where("run = 2").first().price_up == 1


def test_back_and_forth_is_two_changes(spark):
    rows = [(1, 1, 10.0, "EUR"), (1, 2, 20.0, "EUR"), (1, 3, 20.0, "EUR"), (1, 4, 10.0, "EUR")]
    assert changes(spark, rows) == [(1, 2, 10.0, 20.0), (1, 4, 20.0, 10.0)]


def test_gap_in_presence(spark):
    rows = [(1, 1, 5.0, "E"), (1, 3, 5.0, "E")] + [(2, r, 5.0, "E") for r in (1, 2, 3, 4)]
    state, _, audit = snapshots.replay(log(spark, rows))
    one = state.where("id = 1").first()
    assert (one.first_seen, one.last_seen, one.gone_at) == (1, 3, 4)
    assert {r.run: (r.gone, r.back) for r in audit.collect()} == {1: (0, 0), 2: (1, 0), 3: (0, 1), 4: (1, 0)}


def test_diff_of_one_snapshot(spark):
    known = spark.createDataFrame([(1, 10.0, "E", None), (2, 10.0, "E", None), (3, 10.0, "E", 5), (4, 10.0, "E", 5)],
                                  "id int, price double, currency string, gone_at int")
    now = spark.createDataFrame([(1, 9.0, "E"), (3, 10.2, "E"), (9, 1.0, "E")], "id int, price double, currency string")
    got = {r.id: (r.status, r.back) for r in snapshots.diff(known, now).collect()}
    assert got == {1: ("down", False), 2: ("gone", False), 3: ("unchanged", True), 4: ("absent", False), 9: ("new", False)}


def test_even_median_and_null_segment(spark):
    rows = [("a", 1, "x", float(v)) for v in (10, 20, 30, 40)] + [(None, 1, "x", 7.0)]
    df = spark.createDataFrame(rows, "district string, rooms_n int, housing_stock string, ppm double")
    bench = benchmark.segment_median(df)
    got = {r.district: (r.med_ppm, r.pool_n) for r in bench.collect()}
    assert got == {"a": (25.0, 4), None: (7.0, 1)}
    joined = df.withColumn("terms_flag", F.lit(0))
    null_row = benchmark.with_benchmark(joined, bench).where("district is null").first()
    assert null_row.med_ppm is None and null_row.suspect == 0


def test_pool_edge(spark):
    df = spark.createDataFrame([(7, 50.0, 100.0, 0), (8, 50.0, 100.0, 0), (8, 50.0, 100.0, 1)],
                               "pool_n int, ppm double, med_ppm double, terms_flag int")
    got = df.select(prices.vs_median().alias("v"), prices.suspect().alias("s")).collect()
    assert [(r.v, r.s) for r in got] == [(None, 0), (-50.0, 1), (-50.0, 0)]


def test_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double").withColumn("k", F.lit(1))
    r = skew.group_quantiles(df, ["k"], "v", {"a": .25, "b": .5, "c": .75}).first()
    assert (r.a, r.b, r.c) == (1.75, 2.5, 3.25)


def cube(spark, rows):
    return spark.createDataFrame(rows, "series string, month string, n long, med_ppm double")


def test_month_gap(spark):
    filled = trends.fill(cube(spark, [("a", "2024-11", 3, 1.0), ("a", "2025-02", 2, 2.0)])).orderBy("month").collect()
    assert [(r.month, r.n) for r in filled] == [("2024-11", 3), ("2024-12", 0), ("2025-01", 0), ("2025-02", 2)]


def test_nine_series_keep_eight(spark):
    rows = [(f"s{i}", "2024-01", 100 - i, 1.0) for i in range(9)]
    top = trends.top_series(cube(spark, rows)).orderBy("place").collect()
    assert [r.series for r in top] == [f"s{i}" for i in range(8)]
    assert {(r.hidden, r.hidden_n) for r in top} == {(1, 92)}


def test_fixed_order_comes_first(spark):
    rows = [("zz", "2024-01", 500, 1.0), ("b", "2024-01", 1, 1.0), ("a", "2024-01", 2, 1.0)]
    top = trends.top_series(cube(spark, rows), order=["b", "a"]).orderBy("place").collect()
    assert [r.series for r in top] == ["b", "a", "zz"]


def test_smoothing_keeps_gaps(spark):
    rows = [("a", "2024-01", 9, 1.0), ("a", "2024-02", 9, None), ("a", "2024-03", 9, 3.0)]
    got = trends.smooth(trends.suppress(cube(spark, rows), "med_ppm", 1), 3).orderBy("month").collect()
    assert [r.smoothed for r in got] == [1.0, None, 3.0]


def test_slope_needs_three_points(spark):
    two = cube(spark, [("a", "2024-01", 9, 1.0), ("a", "2024-02", 9, 2.0)])
    assert trends.slope(two, "med_ppm", 1).first().slope_pct is None
    three = cube(spark, [("a", f"2024-0{i}", 9, float(i)) for i in (1, 2, 3)])
    assert trends.slope(three, "med_ppm", 1).first().slope_pct == pytest.approx(50.0)


def test_kpis(spark):
    months = [f"2024-{m:02d}" for m in range(1, 13)] + ["2025-01"]
    rows = [("a", m, 9, 100.0 + 10 * i) for i, m in enumerate(months)] + [("a", "2025-02", 1, 1.0)]
    r = trends.kpis(cube(spark, rows), "med_ppm", 5).first()
    assert (r.month, r.value) == ("2025-01", 220.0)
    assert r.d3 == pytest.approx((220 - 190) / 190 * 100) and r.d12 == pytest.approx(120.0) and r.span == pytest.approx(120.0)


def ladder(spark, units):
    ads = spark.createDataFrame([("a", 1, 2, 100.0)], "id string, building int, floor int, area double")
    got = spark.createDataFrame([(c, 1, 2, float(a), v) for c, a, v in units],
                                "code string, building int, floor int, area double, value long")
    return ads, got


def test_ladder_widens_only_when_empty(spark):
    ads, units = ladder(spark, [("u1", 94, 5), ("u2", 108, 9), ("u3", 103, 0)])
    m = linkage.match_listings(ads, units).first()
    assert (m.tolerance, m.n, m.value_min, m.value_med, m.value_max) == (0.1, 2, 5, 7, 9)
    ads, units = ladder(spark, [("u1", 94, 5), ("u2", 96, 9)])
    m = linkage.match_listings(ads, units).first()
    assert (m.tolerance, m.n) == (0.05, 1)
    listed = linkage.matched_units(linkage.tolerance_match(ads, units), units).collect()
    assert [u.code for u in listed] == ["u2"]


def test_matched_median_rounds_half_to_even(spark):
    m = linkage.match_listings(*ladder(spark, [("u1", 100, 2), ("u2", 101, 3)])).first()
    assert m.value_med == 2


def test_a_point_takes_the_first_of_equal_candidates(spark):
    """Ring before direction before code; the survey stops where any address of the point is found."""
    metre = 1 / 111_319.49
    at = lambda east, north: (47.0 + north * metre, 28.0 + east * metre / math.cos(math.radians(47)))
    listings = spark.createDataFrame([(47.0, 28.0, "Lunga", "5", False), (47.0, 28.0, "Scurta", "9", False), (46.0, 28.0, "Lunga", "5", True)],
                                     "lat double, lon double, street string, house string, all_new boolean")
    spots = [(*at(0, -11), "str. Lunga", "5", 2), (*at(0, 11), "Lunga", "5", 9), (*at(0, 11), "Lunga", "5", 7), (*at(10, 0), "Alta", "5", 1),
             (*at(20, 0), "Scurta", "9", 4), (46.0 + 20 * metre, 28.0, "Lunga", "5", 3)]
    places = spark.createDataFrame(spots, "lat double, lon double, street string, house string, code int")
    got = linkage.match_points(listings, places).collect()
    assert [(r.lat, r.street, r.house_key, r.code, r.score) for r in got] == [(47.0, "Lunga", "5", 7, 1.0)]  # north is met before south; 9 lies beyond the stop


def test_a_stray_point_leaves_the_cells_of_a_city_alone(spark):
    rows = [(47.0 + i * 0.0005, 28.0 + j * 0.0005) for i in range(30) for j in range(30)]
    city = spark.createDataFrame(rows, "lat double, lon double")
    far = city.unionByName(spark.createDataFrame([(89.0, 10.0), (90.0, 0.0), (-89.999, 0.0)], "lat double, lon double"))
    for points in (city, far):
        pairs = linkage.near_places(points, far.withColumn("lat", F.col("lat") + 1e-5))
        assert pairs.where("lat < 48 and lat > 40").count() == 900
        looked = pairs.sparkSession.createDataFrame(rows, "lat double, lon double")
        assert looked.select(linkage._band_of_latitude(F.col("lat")).alias("b")).distinct().count() == 1
    assert linkage.near_places(far.where("lat > 88"), far.where("lat > 88").withColumn("lat", F.col("lat") - 1e-5)).where("lat = 89").count() == 1


def test_upper_median_of_a_cell(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0, float(i), 0) for i in (1, 2, 3, 4)], "id int, lat double, lon double, value double, favorite int")
    assert mapview.map_cells(df).first().med == 3.0


def test_colour_bucket(spark):
    df = spark.createDataFrame([(v, 2.0, 3.0, 4.0, 5.0) for v in (1.0, 2.0, 4.5, 9.0, None)], "value double, b1 double, b2 double, b3 double, b4 double")
    got = df.select(mapview.colour_bucket("value").alias("c"), mapview.colour_bucket("value", inverted=True).alias("i")).collect()
    assert [(r.c, r.i) for r in got] == [(0, 4), (1, 3), (3, 1), (4, 0), (None, None)]


def test_five_rooms_means_five_or_more(spark):
    df = spark.createDataFrame([(1,), (2,), (5,), (7,)], "rooms_n int")
    assert sorted(r.rooms_n for r in df.where(filters.rooms([2, 5])).collect()) == [2, 5, 7]


def test_nulls_last_both_ways_then_id_text(spark):
    df = spark.createDataFrame([(1, None), (9, 2.0), (10, 2.0), (3, 1.0)], "id int, price double")
    assert [r.id for r in paging.sort_page(df, "price", "asc").collect()] == [3, 9, 10, 1]
    assert [r.id for r in paging.sort_page(df, "price", "desc").collect()] == [9, 10, 3, 1]


def test_first_number(spark):
    df = spark.createDataFrame([("1 200",), ("3,5",), ("",), ("abc",)], "t string")
    got = df.select(text.first_int("t").alias("i"), text.first_number("t").alias("x"), text.digits_only("t").alias("d")).collect()
    assert [(r.i, r.x, r.d) for r in got] == [(1, 1.0, 1200), (3, 3.5, 35), (None, None, None), (None, None, None)]


def test_later_attribute_wins(spark):
    df = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "a", "y"), (1, 3, "", "z")], "e int, p int, k string, v string")
    assert cards.eav_pivot(df, ["e"], "k", "v", "p", {"a": "a_col"}).first().a_col == "y"
    assert cards.attribute_map(df, ["e"], "k", "v", "p").first().features == {"a": "y"}


def test_text_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("50% off",), ("50 off",), (None,)], "t string")
    assert [r.t for r in df.where(filters.text_search("0% OFF", ["t"])).collect()] == ["50% off"]


def test_empty_id_list_keeps_nothing(spark):
    df = spark.createDataFrame([(1,)], "id int")
    assert filters.in_ids(df, df.where("id > 5")).count() == 0


def test_limits_of_deals_request_fall_back(spark):
    row = (1, "apartments", None, 20000.0, 40.0, 2, "new", 3, 5, 500.0, 0, 0, 1000.0, 8, 50.0)
    df = spark.createDataFrame([row], """id int, profile string, gone_at timestamp, price double, area double, rooms_n int,
        housing_stock string, floor int, floors_total int, ppm double, terms_flag int, hidden int, med_ppm double, pool_n int, discount double""")
    as_of = F.lit(datetime(2024, 1, 1))
    for spec, n in (({}, 1), ({"pool_min": 0}, 1), ({"pool_min": 9}, 0), ({"discount_min": 0}, 1), ({"discount_max": 40}, 0), ({"min_area": 41}, 0)):
        got = filters.apply_filters(df, {"tab": "deals", "city": None, **spec}, as_of=as_of).count()
        assert got == n, spec


def test_addresses_meet_over_near_spots(spark):
    here = [(47.0, 28.9, "a", "1"), (47.0, 28.9, "b", "2"), (47.0001, 28.9, "a", "1"), (10.0, 10.0, "a", "1"), (None, 28.9, "a", "1"), (47.0, 28.9, None, "")]
    there = [(47.0, 28.9, "a", "1"), (47.0001, 28.9001, "b", "1"), (47.0002, 28.9, "c", "2"), (47.0, 28.9, "d", ""), (47.01, 28.9, "e", "1"), (float("nan"), 28.9, "f", "1")]
    here = spark.createDataFrame(here, "lat double, lon double, street string, house_key string")
    there = spark.createDataFrame(there, "lat double, lon double, b_street string, house_key string")
    spots, pairs = linkage.near_addresses(here, there, (0.0, 12.0, 25.0))
    wanted = linkage.near_places(here, there, (0.0, 12.0, 25.0), ["house_key"])
    rows = lambda df: sorted(map(str, df.select(*sorted(wanted.columns)).collect()))
    assert rows(pairs) == rows(wanted) and pairs.count() == 6
    assert spots.count() == spots.select("lat", "lon", "place_lat", "place_lon").distinct().count()
