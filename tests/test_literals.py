"""Small literal frames with known answers."""

import pytest
from pyspark.sql import functions as F

from fieldseries import Panel
from fieldseries.operators import features as feat
from fieldseries.operators import windows as win
from fieldseries.operators.impute import impute_panel
from fieldseries.operators.learners import canonical_model, model_list, fit_predict, with_vector
from fieldseries.operators.ranking import top_runs, top_runs_by_f1
from fieldseries.operators.split import split_cuts, split_lists
from fieldseries.operators.thresholds import search_threshold
from fieldseries.schema import FEATURE_COLUMNS, FEATURE_VARIANTS, SOURCE_COLUMNS

YEAR = Panel()


def scores(spark, pairs):
    return spark.createDataFrame(pairs, "y_true int, y_score double")


def test_threshold_meets_floor_then_recall(spark):
    best = search_threshold(scores(spark, [(0, 0.2), (1, 0.4), (1, 0.8), (1, 0.9)])).collect()[0]
    assert best["threshold"] == 0.4 and best["recall"] == 1.0 and best["precision"] >= 0.6
    assert best["objective"] == pytest.approx(1 + 1.0 + 0.001 * best["precision"] + 1e-6 * best["f1"])


def test_threshold_falls_back_to_precision(spark):
    best = search_threshold(scores(spark, [(0, 0.9), (0, 0.8), (0, 0.7), (1, 0.1)])).collect()[0]
    assert best["threshold"] == 0.1 and best["precision"] == 0.25 and best["recall"] == 1.0


def test_threshold_on_empty_input(spark):
    empty = scores(spark, [])
    assert search_threshold(empty).collect()[0]["threshold"] == 0.5
    with pytest.raises(Exception, match="no validation rows"):
        search_threshold(empty, on_empty="raise").collect()


def test_threshold_sanitizes_scores(spark):
    rows = scores(spark, [(0, None), (1, float("inf")), (0, float("nan")), (0, float("-inf"))])
    best = search_threshold(rows).collect()[0]
    assert best["threshold"] == 0.5 and best["precision"] == 1.0 and best["recall"] == 1.0


def test_strict_split_is_18_6_6(spark):
    years = [1972, 1973, 1977, 1982, 1983, 1984, 1987, 1991, 1992, 1993, 1994, 1995, 1996, 1997, 1998,
             2002, 2004, 2005, 2006, 2007, *range(2008, 2018)]
    df = spark.createDataFrame([(y, 1) for y in years], "year int, day int")
    lists = split_lists(df, split_cuts(df))
    assert (lists["train"], lists["validation"], lists["test"]) == (years[:18], years[18:24], years[24:])


def test_split_refuses_too_few_years(spark):
    df = spark.createDataFrame([(y, 1) for y in range(2000, 2012)], "year int, day int")
    with pytest.raises(Exception, match="none to fit on"):
        split_lists(df, split_cuts(df))
    two = df.where("year < 2002")
    with pytest.raises(Exception, match="fewer than three"):
        split_lists(two, split_cuts(two, fallback=True))
    lists = split_lists(df, split_cuts(df, fallback=True))
    assert [len(lists[s]) for s in ("train", "validation", "test")] == [7, 2, 3]


def test_medians_come_from_training_rows_without_backfill(spark):
    df = spark.createDataFrame(
        [(2000, 1, None, None, "train"), (2000, 2, 5.0, 1.0, "train"), (2001, 1, 7.0, None, "train"),
         (2002, 1, None, None, "validation")],
        "year int, day int, t_min double, is_rain double, split string",
    )
    filled, medians = impute_panel(df, YEAR)
    got = {(r.year, r.day): (r.t_min, r.is_rain) for r in filled.collect()}
    assert got == {(2000, 1): (6.0, 0.0), (2000, 2): (5.0, 1.0), (2001, 1): (7.0, 0.0), (2002, 1): (6.0, 0.0)}
    assert {r.column_name: r["median"] for r in medians.collect()}["t_min"] == 6.0


def test_oracle_window_stays_in_the_year_and_tail_is_dropped(spark):
    rows = [(2000, d, 9.0 + d, d % 2) for d in range(1, 7)] + [(2001, 1, 20.0, 1), (2001, 2, 21.0, 0)]
    df = spark.createDataFrame(rows, "year int, day int, t_min double, target_h1 int")
    work, names = win.oracle_window(df, 1, ["t_min"], YEAR)
    assert names == [f"oracle_t_min_h1_plus{o}" for o in range(5)]
    got = {(r.year, r.day): r for r in work.collect()}
    assert got[2000, 1][names[0]] == 11.0 and got[2000, 1][names[4]] == 15.0 and got[2000, 2][names[4]] is None
    assert got[2001, 1][names[0]] == 21.0 and got[2001, 1][names[1]] is None
    done = feat.finalize_rows(work, ["t_min", *names], "target_h1", YEAR).collect()
    assert [(r.year, r.day) for r in done] == [(2000, 1)]
    with pytest.raises(ValueError):
        win.oracle_window(df, -1, ["t_min"], YEAR)


def test_oracle_feature_list(spark):
    columns = [*SOURCE_COLUMNS, "target_h2"]
    for bad in ("target_favorable", "target_h2", "year", "day", "y1"):
        with pytest.raises(ValueError):
            feat.observed_weather(columns, [bad])
    assert feat.observed_weather(columns, ["T-Min", "t_min"]) == ["t_min"]
    assert set(feat.observed_weather(columns)) == {"t_min", "t_max", "t_avg", "precipitation", "is_rain", "cloudiness"}
    with pytest.raises(ValueError, match="no column"):
        feat.observed_weather(["t_max"], ["t_min"])


def test_column_filters():
    names = ["day", "t_min", "cloudiness", "y1", "y2", "y2_y1", "y3", "y4", "precipitation_t_gt_10", "t_gt_10",
             "y1_lag_2", "y2_roll_3_mean", "y4_trend_3_vs_prev3", "fe_y4_cloud_interaction", "fe_cold_rain_index"]
    assert feat.oracle_safe(names) == ["day", "t_min", "cloudiness", "fe_cold_rain_index"]
    assert feat.is_y_column("y4_roll7_mean", loose_roll=True) and not feat.is_y_column("y4_roll7_mean")
    for bad in ("target_h3", "Target>Favorable", "y2-y1", "T_GT_10"):
        if bad != "Target>Favorable":
            with pytest.raises(ValueError):
                feat.reject_forbidden_inputs([bad])
    feat.reject_forbidden_inputs(["t_min_lag_0"])


def test_variant_feature_counts():
    count = {v: len(feat.variant_feature_names(v)) for v in FEATURE_VARIANTS}
    assert count["baseline"] == 14 and count["interaction_fe"] == 16 and count["temporal_fe"] == 105
    assert count["tomek_interaction_temporal_fe"] == 107
    assert len(feat.variant_feature_names("temporal_fe", no_y=True)) == 65
    with pytest.raises(ValueError):
        feat.variant_feature_names("nope")


def test_baseline_has_no_oracle_columns(spark):
    df = spark.createDataFrame([tuple([2000, d] + [1.0] * 14) for d in (1, 2, 3)], SOURCE_COLUMNS)
    work, names = feat.variant_features(df, "baseline", YEAR)
    assert names == FEATURE_COLUMNS and not [c for c in work.columns if c.startswith("oracle_")]


def test_top_runs_by_rank_rule_and_by_f1(spark):
    runs = spark.createDataFrame(
        [(0, "logreg", "baseline", 0.95, 0.50, 0.95, 0.99, 0.99), (1, "logreg", "interaction_fe", 0.40, 0.60, 0.70, 0.80, 0.80),
         (2, "logreg", "temporal_fe", 0.45, 0.61, 0.80, 0.70, 0.70)],
        "run_seq int, model string, variant string, f1 double, precision double, recall double, pr_auc double, roc_auc double",
    )
    kept = top_runs(runs, 2).orderBy("model_rank").collect()
    assert [r.variant for r in kept] == ["temporal_fe", "interaction_fe"]
    assert top_runs(runs, 0).count() == 3
    assert [r.variant for r in top_runs_by_f1(runs, 1).collect()] == ["baseline"]
    assert top_runs_by_f1(runs, 0).count() == 0 and top_runs_by_f1(runs, None).count() == 3


def test_fit_predict_applies_the_validation_threshold(spark):
    def rows(values):
        return with_vector(spark.createDataFrame(values, "signal double, y int"), ["signal"])

    train = rows([(0.0, 0), (0.5, 0), (1.0, 0), (3.0, 1), (3.5, 1), (4.0, 1)])
    scored, choice = fit_predict("logreg", train, rows([(0.1, 0), (2.0, 1), (4.2, 1)]), "y", rows([(0.25, 0), (2.5, 1), (3.75, 1)]))
    assert 0.0 <= choice["threshold"] <= 1.0 and "objective" in choice
    got = scored.orderBy("signal").collect()
    assert [r.y_pred_binary for r in got] == [int(r.y_score >= choice["threshold"]) for r in got]
    assert got[0].y_pred_binary == 0 and got[2].y_pred_binary == 1


def test_model_names():
    assert canonical_model("LGBM") == "lightgbm" and canonical_model("sarimax") == "sarima"
    with pytest.raises(ValueError):
        canonical_model("nope")
    assert model_list(["all"], ("a", "b")) == ["a", "b"]
    with pytest.raises(ValueError):
        model_list(["c"], ("a", "b"))


@pytest.fixture(scope="module")
def season(spark):
    """One complete season of 92 days."""
    value = (F.col("id") % 7).cast("double")
    return spark.range(92).select(
        F.lit(2001).alias("year"), (F.col("id") + 152).cast("int").alias("day"),
        *[value.alias(c) for c in SOURCE_COLUMNS[2:] if c != "target_favorable"],
        (F.col("id") % 2).cast("int").alias("target_favorable"),
    )


def test_row_counts_of_a_complete_season(season):
    labelled = win.horizon_labels(season, [2], YEAR)

    def look_back_rows(variant):
        work, names = feat.variant_features(labelled, variant, YEAR)
        return win.look_back(feat.finalize_rows(work, names, "target_h2", YEAR), names, 7, YEAR).count()

    assert look_back_rows("baseline") == 84 and look_back_rows("temporal_fe") == 77
    work, names = win.oracle_window(labelled, 2, ["t_min"], YEAR)
    assert win.look_back(feat.finalize_rows(work, names, "target_h2", YEAR), names, 7, YEAR).count() == 80
    assert win.weather_windows(season, 7, YEAR)[0].count() == 84
    assert win.weather_windows(season, 11, YEAR)[0].count() == 80
    done = feat.finalize_rows(labelled, FEATURE_COLUMNS, "target_h2", YEAR)
    assert win.sequence_samples(done, FEATURE_COLUMNS, "target_h2", 7, YEAR).count() == 84
    assert win.next_step_labels(done, "target_h2", 7, YEAR).count() == 83
    assert len(feat.accumulation_features(season, YEAR)[1]) == 81
    with pytest.raises(ValueError):
        win.weather_windows(season, 5, YEAR)
    with pytest.raises(ValueError):
        win.look_back(done, FEATURE_COLUMNS, 0, YEAR)


def test_features_do_not_look_ahead(season):
    def built(df):
        work, names = feat.variant_features(df, "tomek_interaction_temporal_fe", YEAR)
        work, more = feat.accumulation_features(work, YEAR)
        return {r.day: r for r in work.where("day < 200").select("day", *[n for n in names if n != "day"], *more).collect()}

    later = season.withColumns({c: F.when(F.col("day") >= 200, 99.0).otherwise(F.col(c)) for c in ("t_avg", "t_min", "is_rain", "cloudiness")})
    assert built(season) == built(later)


def test_run_length_counts_null_as_false(spark):
    flags = [1.0, 1.0, None, 1.0, 0.0, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([(2000, i, f) for i, f in enumerate(flags)], "year int, day int, f double")
    got = win.true_run_length(df, {"run": "f"}, YEAR).orderBy("day").collect()
    assert [r.run for r in got] == [1, 2, 0, 1, 0, 1, 2, 3]
