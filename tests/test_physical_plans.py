"""Plan shapes that have to hold at any data size."""

import re

import pytest

from fieldseries.catalog.fixtures import SITE, site_panel, split_panel
from fieldseries.operators import features as feat
from fieldseries.operators import windows as win
from fieldseries.operators.materialize import materialize


def plan_of(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1]


@pytest.fixture(scope="module")
def panel(spark, sf_small):
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    return materialize(site_panel(spark, sf_small))


def test_all_temporal_features_share_one_shuffle_and_sort(panel):
    work, names = feat.variant_features(win.horizon_labels(panel, [2, 3], SITE), "tomek_interaction_temporal_fe", SITE)
    plan = plan_of(feat.finalize_rows(work, names, "target_h2", SITE))
    assert plan.count("Exchange") == 1 and len(re.findall(r"Sort \[", plan)) == 1
    assert "SinglePartition" not in plan


def test_accumulations_and_runs_share_it_too(panel):
    plan = plan_of(feat.accumulation_features(panel, SITE)[0])
    assert plan.count("Exchange") == 1 and len(re.findall(r"Sort \[", plan)) == 1


def test_look_back_of_written_rows_is_one_shuffle(panel):
    names = ["t_min", "t_max", "y1"]
    rows = materialize(feat.finalize_rows(win.horizon_labels(panel, [2], SITE), names, "target_h2", SITE))
    plan = plan_of(win.look_back(rows, names, 7, SITE))
    assert plan.count("Exchange") == 1 and "SinglePartition" not in plan


def test_weather_windows_read_only_their_columns(panel):
    plan = plan_of(win.weather_windows(panel, 7, SITE)[0])
    assert plan.count("Exchange") == 1
    read = re.search(r"ReadSchema: struct<([^>\n]*)", plan).group(1)
    assert "y4" not in read and "target_favorable" not in read


def test_split_filter_reaches_the_scan(spark, sf_small, panel):
    from fieldseries.operators.split import split_cuts, with_split

    tagged = with_split(panel, split_cuts(panel, fallback=True))
    plan = plan_of(tagged.where("split = 'test'"))
    assert "PushedFilters" in plan and "Exchange" not in plan and "Join" not in plan


def test_raw_scan_is_pruned(spark, sf_small):
    plan = plan_of(site_panel(spark, sf_small))
    assert "l_extendedprice" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_facts_are_scanned_once_for_cuts_medians_and_rows(spark, sf_small):
    assert "l_shipdate" not in plan_of(split_panel(spark, sf_small))
