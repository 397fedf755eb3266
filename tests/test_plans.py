"""What the physical plans must and must not contain."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog import bindings as b
from stallwise.functions.geo import within_bbox
from stallwise.operators import joins, linkage, skew, snapshots

SF = "/root/testdata/sf0.001"
PYTHON_QUERIES = {"street_similarity_ratio", "html_clean_full", "fold_diacritics_full"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["deals", "listing_360", "tolerance_ladder_join", "best_match_building", "probe_candidates",
                                  "trend_cube", "coloured_cells", "run_audit_by_profile", "typed_details", "url_filter_spec", "html_clean",
                                  "quintile_breaks", "map_projection", "profile_summary"])
def test_large_tables_join_on_keys_and_stay_in_the_jvm(spark, no_broadcast, name):
    text = plan(entry.queries()[name](spark, SF))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert unwanted not in text, (name, unwanted)


def test_python_runs_only_where_named(spark):
    assert all("ArrowEvalPython" in plan(entry.queries()[n](spark, SF)) for n in PYTHON_QUERIES)


def test_filters_and_columns_reach_the_scan(spark):
    df = b.table(spark, SF, "orders").where(F.col("o_totalprice").between(1000, 2000)).select("o_orderkey")
    text = plan(df)
    assert "GreaterThanOrEqual(o_totalprice" in text and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text
    box = spark.read.parquet(f"{SF}/orders.parquet").withColumnsRenamed({"o_totalprice": "lat", "o_custkey": "lon"})
    assert "GreaterThanOrEqual(o_totalprice" in plan(box.where(within_bbox("lat", "lon", (1.0, 2.0, 3.0, 4.0))))


def test_top_rows_are_cut_before_the_shuffle(spark):
    df = b.table(spark, SF, "orders")
    text = plan(skew.top_per_key(df, ["o_custkey"], ["o_totalprice"], 5))
    assert text.count("WindowGroupLimit") == 2


def test_small_stored_tables_are_broadcast(spark):
    log = snapshots_log(spark)
    events = snapshots.presence_events(log, ["id"], snapshots.run_calendar(log))
    assert "BroadcastHashJoin" in plan(events) and "SortMergeJoin" not in plan(events)


def snapshots_log(spark):
    from catalog.changes import snapshot_log
    return snapshot_log(spark, SF)


def test_fold_uses_one_shuffle_per_listing(spark):
    log = spark.createDataFrame([(1, 1, 1.0, "E")], "id int, run int, price double, currency string")
    assert plan(snapshots.fold_prices(log)).count("Exchange hashpartitioning") == 1


def test_band_join_key_contains_the_area_band(spark, no_broadcast):
    ads = spark.createDataFrame([(1, 1, 50.0)], "building int, floor int, area double")
    units = spark.createDataFrame([(1, 1, 50.0, 5)], "building int, floor int, unit_area double, value long")
    text = plan(linkage._near_pairs(ads, units, ["building", "floor"], (0.05, 0.1)))
    assert "hashpartitioning(building" in text and "__band" in text.split("hashpartitioning(building", 1)[1].split(")")[0]


def test_baselines_do_not_shuffle_listings(spark):
    df = b.ads(spark, SF).join(joins.baselines(b.runs(spark, SF)), "profile", "left")
    assert "Exchange hashpartitioning" not in plan(df)
