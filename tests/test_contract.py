"""The registered queries: importable without Spark, complete, and equal to their SQL twins."""
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from catalog.check import compare, duck

SF = "/root/testdata/sf0.001"

SURVEY_KEYS = """flatten_listing money_parse snapshot_dedup category_filter_tally url_filter_spec bbox_filter write_csv
write_json csv_row_projection keyed_upsert partial_upsert replace_children table_counters unit_price price_drop
effective_drop discount_vs_median vs_median suspect_flag listing_age_days is_new listing_projection map_projection
owner_flags typed_details display_tags filter_lifecycle filter_new_posted filter_new_base filter_price_down filter_ids
filter_hidden filter_ranges filter_rooms filter_in_sets filter_author filter_feature_map filter_amenities
filter_floor_rules filter_has_photo filter_hide_suspect filter_text_search filter_deal_rules inner_details left_details
left_benchmark anti_missing_details refetch_after_change stale_details history_count tolerance_ladder_join
best_match_building unit_lookup probe_candidates segment_median stats_by_district stats_by_rooms stats_by_kind
posted_by_month changes_by_day price_histogram price_steps profile_summary facet_distinct facet_topk district_report
segment_ranking point_rollup map_cells quintile_breaks cell_listings match_coverage rank_in_segment trend_group_keys
trend_cells trend_gap_fill trend_top_series trend_min_n trend_smooth trend_mom_change trend_kpis trend_slope trend_pivot
monthly_report snapshot_new snapshot_gone snapshot_reappear price_change_fold price_history change_class lifecycle_state
run_audit change_report cycle_summary work_selection rematch_merge price_series sorted_page deals listing_360
latest_runs market_overview eav_pivot attribute_map feature_text unit_normalise number_extract digits_only_int
rooms_number terms_flag canonical_values mask_phones strip_private media_urls breadcrumb_path html_sections html_clean
fold_diacritics split_address norm_house street_skeleton street_similarity web_mercator probe_points id_from_text
row_validation stream_price_changes stream_daily_changes stream_snapshot_dedup stream_cycle rate_limit""".split()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_registered_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry.__file__.rsplit("/", 1)[0])
    assert done.returncode == 0, done.stderr


def test_every_surveyed_operator_is_registered():
    assert set(SURVEY_KEYS) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(15 <= r["discount"] <= 60 for r in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    ok, message = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, message
