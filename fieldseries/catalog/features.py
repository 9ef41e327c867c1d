"""Point-in-time features over the site panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseries.catalog.fixtures import (
    FILLED,
    PANEL,
    SITE,
    SPLIT,
    W,
    filled_panel,
    labelled_panel,
    over,
    site_panel,
    split_panel,
)
from fieldseries.catalog.registry import query, r6, rounded
from fieldseries.functions.rules import (
    at_least,
    blight_day_score,
    invert_predictions,
    signal_mean_score,
    simulation_day_score,
    weighted_indicator_score,
)
from fieldseries.operators import features as feat
from fieldseries.operators import windows as win
from fieldseries.operators.impute import carry_forward, fit_medians, impute_panel
from fieldseries.operators.split import split_cuts, split_table
from fieldseries.plans.disease import prepare_features
from fieldseries.schema import (
    ACCUMULATION_PAIRS,
    ACCUMULATION_ROWS,
    FEATURE_COLUMNS,
    ORACLE_OFFSETS,
    SHARE_ROWS,
    TEMPORAL_SOURCES,
    WEATHER_VARIABLES,
)

KEYS = "site, year, day"
SQL_STAT = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}


def sql_rolling(c: str, rows: int, stat: str, full: bool) -> str:
    value = f"{SQL_STAT[stat]}({c}) {over(rows - 1)}"
    return f"case when count({c}) {over(rows - 1)} >= {rows} then {value} end" if full else value


def sql_trend(c: str) -> str:
    before = over(5, 3)
    return (
        f"({sql_rolling(c, 3, 'mean', True)}) - (case when count({c}) {before} >= 3 then avg({c}) {before} end)"
    )


def sql_temporal(c: str) -> list[tuple[str, str]]:
    cols = [(f"lag({c}, {k}) over {W}", f"{c}_lag_{k}") for k in (2, 7)]
    cols += [(sql_rolling(c, 3, s, True), f"{c}_roll_3_{s}") for s in ("mean", "std", "min", "max")]
    return [*cols, (sql_trend(c), f"{c}_trend_3_vs_prev3")]


# -- labels, splits, imputation -------------------------------------------------


@query(
    "horizon_labels",
    f"""{PANEL} select {KEYS}, target_favorable,
      lead(target_favorable, 2) over {W} as target_h2, lead(target_favorable, 3) over {W} as target_h3 from panel""",
)
def horizon_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = win.horizon_labels(site_panel(spark, sf_dir), [2, 3], SITE)
    return labelled.select(*SITE.columns, "target_favorable", "target_h2", "target_h3")


@query(
    "chronological_split",
    f"{SPLIT} select distinct year, split from tagged",
)
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = site_panel(spark, sf_dir)
    return split_table(panel, split_cuts(panel, fallback=True))


@query(
    "strict_split",
    f"""{PANEL} select year, case when r <= 2 then 'test' when r <= 5 then 'validation' else 'train' end as split
      from (select year, row_number() over (order by year desc) as r from (select distinct year from panel))""",
)
def strict_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = site_panel(spark, sf_dir)
    return split_table(panel, split_cuts(panel, n_validation=3, n_test=2))


@query(
    "rows_by_split",
    f"{SPLIT} select split, count(*) as n_rows, sum(target_favorable) as n_pos from tagged group by split",
)
def rows_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_panel(spark, sf_dir).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("target_favorable").alias("n_pos")
    )


CARRIED_COLUMNS = ["is_rain", "precipitation", "t_avg", "cloudiness"]


@query(
    "forward_fill",
    f"{FILLED} select {KEYS}, " + ", ".join(r6(c, c) for c in CARRIED_COLUMNS) + " from carried",
)
def forward_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(carry_forward(site_panel(spark, sf_dir), SITE).select(*SITE.columns, *CARRIED_COLUMNS))


@query(
    "train_medians",
    f"{FILLED} "
    + " union all ".join(
        f"select '{c}' as column_name, {r6(f'm_{c}', 'median')} from medians" for c in FEATURE_COLUMNS if c != "day"
    ),
)
def train_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(impute_panel(split_panel(spark, sf_dir), SITE)[1])


@query(
    "impute_panel",
    f"{FILLED} select {KEYS}, split, " + ", ".join(r6(c, c) for c in FEATURE_COLUMNS if c != "day") + " from filled",
)
def imputed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        filled_panel(spark, sf_dir).select(*SITE.columns, "split", *[c for c in FEATURE_COLUMNS if c != "day"])
    )


OWN = ["t_avg", "cloudiness", "is_rain"]


@query(
    "own_medians",
    f"""with {PANEL[5:]}, l as (select *, lead(target_favorable, 2) over {W} as target_h2 from panel),
      k as (select * from l where target_h2 is not null),
      m as (select {', '.join(f'median({c}) as m_{c}' for c in OWN)} from k)
      select {KEYS}, {', '.join(r6(f'coalesce({c}, m_{c}, 0)', c) for c in OWN)} from k, m""",
)
def own_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldseries.operators.impute import fill_own_medians

    filled = fill_own_medians(labelled_panel(spark, sf_dir), OWN, "target_h2")
    return rounded(filled.select(*SITE.columns, *OWN))


# -- daily projections ----------------------------------------------------------

SQL_BLIGHT = """least(greatest(
  case when t_avg between 10 and 24 then 2e0 else 0e0 end
  + case when (t_avg >= 7 and t_avg < 10) or (t_avg > 24 and t_avg <= 27) then 1e0 else 0e0 end
  + case when is_rain > 0 or precipitation >= 0.1e0 then 1e0 else 0e0 end
  + case when cloudiness >= 6 then 1e0 else 0e0 end, 0), 4)"""
SQL_SIMULATION = """least(greatest(
  case when is_rain > 0 or precipitation >= 0.1e0 then 2e0 else 0e0 end
  + case when t_avg between 10 and 23 then 2e0 else 0e0 end
  + case when t_min >= 10 then 1e0 else 0e0 end
  + case when cloudiness >= 6 then 1e0 else 0e0 end, 0), 6)"""


@query(
    "interaction_features",
    f"""{PANEL} select {KEYS}, {r6('y4 * cloudiness', 'fe_y4_cloud_interaction')},
      {r6('is_rain * (35 - t_avg)', 'fe_cold_rain_index')} from panel""",
)
def interaction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = feat.interaction_columns()
    return rounded(site_panel(spark, sf_dir).select(*SITE.columns, *[c.alias(n) for n, c in columns.items()]))


@query(
    "simple_feature_set",
    f"""with {PANEL[5:]}, z as (select * replace (coalesce(is_rain, 0) as is_rain, coalesce(precipitation, 0) as precipitation) from panel)
      select {KEYS}, {r6('t_avg * cloudiness', 'fe_cloud_temp')},
      {r6('precipitation * case when t_avg is not null then greatest(20 - t_avg, 0) end', 'fe_cold_rain_index')}, """
    + ", ".join(
        r6(sql_rolling(c, w, "mean", False), f"{c}_roll{w}_mean")
        for w in (5, 7)
        for c in ("t_avg", "precipitation", "cloudiness", "y4")
    )
    + " from z",
)
def simple_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, names = feat.simple_features(site_panel(spark, sf_dir), [7, 5], SITE)
    derived = [n for n in names if n.startswith("fe_") or "_roll" in n]
    return rounded(work.select(*SITE.columns, *derived))


FLAGS_CTE = """
f0 as (select *,
  case when precipitation > 0 or is_rain > 0 then 1e0 else 0e0 end as fe_wet_day,
  case when t_avg between 8 and 25 then 1e0 else 0e0 end as fe_temp_8_25,
  case when t_avg between 10 and 25 then 1e0 else 0e0 end as fe_temp_10_25,
  case when t_avg between 10 and 20 then 1e0 else 0e0 end as fe_temp_10_20,
  abs(t_avg - 15) as fe_temp_distance_15,
  case when t_min >= 10 then 1e0 else 0e0 end as fe_tmin_ge_10,
  case when t_max <= 25 then 1e0 else 0e0 end as fe_tmax_le_25,
  case when cloudiness >= 6 then 1e0 else 0e0 end as fe_high_cloud from panel),
flags as (select *,
  fe_wet_day * fe_temp_8_25 as fe_warm_wet_day,
  greatest(fe_wet_day, fe_high_cloud) * fe_temp_10_20 as fe_cool_moist_day,
  fe_tmin_ge_10 * greatest(fe_wet_day, fe_high_cloud) as fe_hutton_proxy_day from f0)"""
FLAG_NAMES = [
    "fe_wet_day", "fe_temp_8_25", "fe_temp_10_25", "fe_temp_10_20", "fe_temp_distance_15", "fe_tmin_ge_10",
    "fe_tmax_le_25", "fe_high_cloud", "fe_warm_wet_day", "fe_cool_moist_day", "fe_hutton_proxy_day",
]


@query("day_conditions", f"{PANEL}, {FLAGS_CTE} select {KEYS}, {', '.join(r6(c, c) for c in FLAG_NAMES)} from flags")
def day_condition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, names = feat.day_conditions(site_panel(spark, sf_dir))
    return rounded(work.select(*SITE.columns, *names))


@query(
    "rule_day_scores",
    f"""{PANEL} select {KEYS}, {SQL_BLIGHT} as blitecast, {SQL_SIMULATION} as simcast,
      {r6('''0.45e0 * case when coalesce(precipitation, 0) > 0 then 1 else 0 end
        + 0.30e0 * case when coalesce(t_avg, 0) between 12 and 20 then 1 else 0 end
        + 0.25e0 * case when coalesce(cloudiness, 0) >= 6 then 1 else 0 end''', 'weighted')} from panel""",
)
def rule_day_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        site_panel(spark, sf_dir).select(
            *SITE.columns,
            blight_day_score().alias("blitecast"),
            simulation_day_score().alias("simcast"),
            weighted_indicator_score().alias("weighted"),
        )
    )


def _sql_signals(names: list[str]) -> str:
    parts = " + ".join(f"coalesce({c}, 0) / case when m_{c} = 0 then 1 else m_{c} end" for c in names)
    return f"least(greatest(({parts}) / {len(names)}e0, 0), 1)"


@query(
    "signal_mean_score",
    f"""with {PANEL[5:]}, m as (select max(coalesce(is_rain, 0)) as m_is_rain,
        max(precipitation_t_gt_10) as m_precipitation_t_gt_10, max(t_gt_10) as m_t_gt_10,
        max(target_favorable) as m_target_favorable from panel),
      v as (select *, {_sql_signals(['is_rain', 'precipitation_t_gt_10', 't_gt_10'])} as y_score,
        {_sql_signals(['target_favorable', 'is_rain', 'precipitation_t_gt_10', 't_gt_10'])} as leaky from panel, m)
      select {KEYS}, {r6('y_score', 'y_score')}, {r6('leaky', 'leaky_score')},
        case when round(y_score, 6) >= 0.5 then 1 else 0 end as y_pred_binary from v""",
)
def signal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = site_panel(spark, sf_dir)
    leaky = signal_mean_score(panel, use_label=True).withColumnRenamed("y_score", "leaky_score")
    scored = rounded(signal_mean_score(leaky).select(*SITE.columns, "y_score", "leaky_score"))
    return scored.withColumn("y_pred_binary", at_least(F.col("y_score"), 0.5))


@query(
    "inverted_predictions",
    f"""with {PANEL[5:]}, s as (select {KEYS}, ({SQL_BLIGHT}) / 4 as y_score from panel)
      select {KEYS}, 1 - case when y_score >= 0.75 then 1 else 0 end as y_pred_binary, 1 - y_score as y_score from s""",
)
def inverted_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = site_panel(spark, sf_dir).select(*SITE.columns, (blight_day_score() / 4).alias("y_score"))
    return invert_predictions(scored.withColumn("y_pred_binary", at_least(F.col("y_score"), 0.75)))


@query(
    "float_features",
    f"{PANEL} select cast(t_avg as float) as t_avg, cast(cloudiness as float) as cloudiness from panel",
)
def float_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.float_features(site_panel(spark, sf_dir), ["t_avg", "cloudiness", "t_avg"])


# -- windows ----------------------------------------------------------------------


@query(
    "temporal_features",
    f"{PANEL} select {KEYS}, "
    + ", ".join(r6(e, n) for c in TEMPORAL_SOURCES for e, n in sql_temporal(c))
    + " from panel",
)
def temporal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = feat.temporal_columns(TEMPORAL_SOURCES, SITE)
    return rounded(site_panel(spark, sf_dir).select(*SITE.columns, *[c.alias(n) for n, c in columns.items()]))


def _sql_accumulations() -> str:
    names = []
    for rows in ACCUMULATION_ROWS:
        for c, stat in ACCUMULATION_PAIRS:
            prefix = c if c.startswith("fe_") else f"fe_{c}"
            names.append(r6(sql_rolling(c, rows, stat, False), f"{prefix}_roll_{rows}_{stat}"))
    for rows in SHARE_ROWS:
        warm, wet = (sql_rolling(c, rows, "sum", False) for c in ("fe_warm_wet_day", "fe_wet_day"))
        names.append(r6(f"coalesce(({warm}) / nullif({wet}, 0), 0)", f"fe_warm_wet_share_roll_{rows}"))
    return ", ".join(names)


@query("accumulation_features", f"{PANEL}, {FLAGS_CTE} select {KEYS}, {_sql_accumulations()} from flags")
def accumulation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, names = feat.accumulation_features(site_panel(spark, sf_dir), SITE)
    return rounded(work.select(*SITE.columns, *[n for n in names if "_roll_" in n]))


def _sql_run(flag: str, name: str) -> str:
    return (
        f"cast(sum({flag}) over (partition by site, year, i_{flag} order by day rows unbounded preceding) as double) as {name}"
    )


@query(
    "run_lengths",
    f"""{PANEL}, {FLAGS_CTE}, islands as (select *, {', '.join(
        f'sum(1 - {f}) over (partition by site, year order by day rows unbounded preceding) as i_{f}'
        for f in feat.RUN_LENGTHS.values())} from flags)
      select {KEYS}, {', '.join(_sql_run(f, n) for n, f in feat.RUN_LENGTHS.items())} from islands""",
)
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, _ = feat.day_conditions(site_panel(spark, sf_dir))
    return win.true_run_length(work, feat.RUN_LENGTHS, SITE).select(*SITE.columns, *feat.RUN_LENGTHS)


LABELLED_FILLED = f"""{FILLED}, h as (select *, lead(target_favorable, 2) over {W} as target_h2 from filled)"""
BASE_FEATURES_SQL = ", ".join(r6(c, c) for c in FEATURE_COLUMNS if c != "day")


@query(
    "finalized_rows",
    f"""{PANEL}, h as (select *, lead(target_favorable, 2) over {W} as target_h2 from panel)
      select {KEYS}, target_h2, {r6('t_avg', 't_avg')}, {r6('cloudiness', 'cloudiness')} from h
      where target_h2 is not null and t_avg is not null and cloudiness is not null""",
)
def finalized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feat.finalize_rows(labelled_panel(spark, sf_dir), ["t_avg", "cloudiness"], "target_h2", SITE))


LOOK_BACK = ["t_avg", "cloudiness"]
# The look-back runs over the rows that were finalised before it: the second
# CTE must not see the dropped ones.
SQL_LOOK_BACK = f"""{PANEL}, h as (select *, lead(target_favorable, 2) over {W} as target_h2 from panel),
      k as (select {KEYS}, target_h2, t_avg, cloudiness from h
            where target_h2 is not null and t_avg is not null and cloudiness is not null)"""


@query(
    "look_back_columns",
    f"""{SQL_LOOK_BACK} select {KEYS}, target_h2, {', '.join(r6(f'l{k}_{c}', f'{c}_win_lag_{k}')
        for c in LOOK_BACK for k in range(6, -1, -1))}
      from (select *, row_number() over {W} as rn, {', '.join(f'lag({c}, {k}) over {W} as l{k}_{c}'
        for c in LOOK_BACK for k in range(7))} from k) where rn >= 7""",
)
def look_back_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feat.finalize_rows(labelled_panel(spark, sf_dir), LOOK_BACK, "target_h2", SITE)
    wide, names = win.look_back_columns(rows, LOOK_BACK, 7, SITE)
    return rounded(wide.select(*SITE.columns, "target_h2", *names))


@query(
    "look_back_array",
    f"""{SQL_LOOK_BACK} select {KEYS}, target_h2, i as slot, {r6('v[i]', 'value')}
      from (select {KEYS}, target_h2, row_number() over {W} as rn,
              list_concat(list(t_avg) {over(6)}, list(cloudiness) {over(6)}) as v from k),
           range(1, 15) r(i) where rn >= 7""",
)
def look_back_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feat.finalize_rows(labelled_panel(spark, sf_dir), LOOK_BACK, "target_h2", SITE)
    flat = win.look_back(rows, LOOK_BACK, 7, SITE)
    slots = flat.select(*SITE.columns, "target_h2", F.posexplode("look_back").alias("slot", "value"))
    return rounded(slots.withColumn("slot", (F.col("slot") + 1).cast("long")))


@query(
    "oracle_window",
    f"{PANEL} select {KEYS}, "
    + ", ".join(
        r6(f"lead({v}, {2 + o}) over {W}", f"oracle_{v}_h2_plus{o}") for v in WEATHER_VARIABLES for o in ORACLE_OFFSETS
    )
    + " from panel",
)
def oracle_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = site_panel(spark, sf_dir)
    names = feat.observed_weather(panel.columns)
    work, columns = win.oracle_window(panel, 2, names, SITE)
    return rounded(work.select(*SITE.columns, *columns))


def sql_weather_samples(rows: int) -> str:
    lags = ", ".join(f"lag({v}, {k}) over {W} as {v}_lag_{k}" for k in range(rows) for v in WEATHER_VARIABLES)
    leads = ", ".join(
        f"lead({v}, {s}) over {W} as lead_{s}_{v}" for s in (1, 2) for v in WEATHER_VARIABLES
    )
    known = " and ".join(f"lead_{s}_{v} is not null" for s in (1, 2) for v in WEATHER_VARIABLES)
    return f"""samples as (select * from (select {KEYS}, row_number() over {W} as rn, {lags}, {leads} from panel)
      where rn >= {rows} and {known})"""


@query(
    "weather_windows",
    f"{PANEL}, {sql_weather_samples(7)} select concat_ws('_', site, year, day) as sample_id, {KEYS}, 7 as window_size, "
    + ", ".join(r6(f"{v}_lag_{k}", f"{v}_lag_{k}") for k in range(7) for v in WEATHER_VARIABLES)
    + ", "
    + ", ".join(r6(f"lead_{s}_{v}", f"lead_{s}_{v}") for s in (1, 2) for v in WEATHER_VARIABLES)
    + ", "
    + ", ".join(r6(f"{v}_lag_0", f"lead_{s}_{v}_persistence") for s in (1, 2) for v in WEATHER_VARIABLES)
    + " from samples",
)
def weather_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(win.weather_windows(site_panel(spark, sf_dir), 7, SITE)[0])


@query(
    "long_context",
    f"{PANEL}, {sql_weather_samples(7)} "
    + " union all ".join(
        f"select concat_ws('_', site, year, day) as id, {t} as timestamp, "
        + ", ".join(r6(f"{v}_lag_{6 - t}", v) for v in WEATHER_VARIABLES)
        + " from samples"
        for t in range(7)
    ),
)
def long_context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(win.long_context(win.weather_windows(site_panel(spark, sf_dir), 7, SITE)[0], 7))


def _sql_rule(expression: str) -> str:
    return f"""{PANEL}, h as (select *, lead(target_favorable, 2) over {W} as target_h2, {expression} as s from panel)
      select {KEYS}, target_h2, rule_score from
        (select *, row_number() over {W} as rn, sum(s) {over(6)} as rule_score from h)
      where rn >= 7 and target_h2 is not null"""


@query("rolling_blight_score", _sql_rule(SQL_BLIGHT))
def rolling_blight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.rolling_rule_score(labelled_panel(spark, sf_dir), blight_day_score(), "target_h2", 7, SITE)


@query("rolling_simulation_score", _sql_rule(SQL_SIMULATION))
def rolling_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.rolling_rule_score(labelled_panel(spark, sf_dir), simulation_day_score(), "target_h2", 7, SITE)


@query(
    "sequence_samples",
    f"""{PANEL}, h as (select *, lead(target_favorable, 2) over {W} as target_h2 from panel),
      g as (select {KEYS}, target_h2, row_number() over {W} as rn, count(t_avg) {over(4)} as n1,
              count(cloudiness) {over(4)} as n2, sum(cast(t_avg as float)) {over(4)} as s1,
              sum(cast(cloudiness as float)) {over(4)} as s2 from h)
      select {KEYS}, cast(target_h2 as double) as target_h2, 5 as n_steps, round(s1, 3) as sum_t_avg,
        round(s2, 3) as sum_cloudiness
      from g where rn >= 5 and n1 = 5 and n2 = 5 and target_h2 is not null""",
)
def sequence_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = win.sequence_samples(labelled_panel(spark, sf_dir), LOOK_BACK, "target_h2", 5, SITE)

    def column_sum(i: int):
        return F.round(F.aggregate("sequence", F.lit(0.0), lambda a, day: a + day[i].cast("double")), 3)

    return samples.select(
        *SITE.columns,
        "target_h2",
        F.size("sequence").alias("n_steps"),
        column_sum(0).alias("sum_t_avg"),
        column_sum(1).alias("sum_cloudiness"),
    )


@query(
    "next_step_labels",
    f"""{PANEL} select {KEYS}, target_favorable from (select *, row_number() over {W} as rn from panel) where rn > 7""",
)
def next_step_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.next_step_labels(site_panel(spark, sf_dir), "target_favorable", 7, SITE)


@query(
    "series_position",
    f"""{PANEL} select {KEYS}, concat_ws('_', site, year) as series_id, cast(row_number() over {W} - 1 as int) as time_idx
      from panel""",
)
def series_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.series_position(site_panel(spark, sf_dir), SITE).select(*SITE.columns, "series_id", "time_idx")


# -- whole preparations -------------------------------------------------------------

TEMPORAL_SQL = [(e, n) for c in TEMPORAL_SOURCES for e, n in sql_temporal(c)]


def _sql_prepared(extra: list[tuple[str, str]], names: list[str]) -> str:
    added = "".join(f", {e} as {n}" for e, n in extra)
    return (
        f"{LABELLED_FILLED}, w as (select *{added} from h) select {KEYS}, split, cast(target_h2 as int) as target_h2, "
        + ", ".join(r6(n, n) for n in names if n != "day")
        + " from w where target_h2 is not null"
        + "".join(f" and {n} is not null" for _, n in extra)
    )


BASE = [c for c in FEATURE_COLUMNS if c != "day"]
INTERACTION_SQL = [
    ("y4 * cloudiness", "fe_y4_cloud_interaction"),
    ("is_rain * (35 - t_avg)", "fe_cold_rain_index"),
]


def _prepared(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    prepared = prepare_features(split_panel_labelled(spark, sf_dir), SITE, horizon=2, **options)
    return rounded(prepared.rows)


def split_panel_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.horizon_labels(split_panel(spark, sf_dir), [2], SITE)


@query("prepared_baseline", _sql_prepared([], BASE))
def prepared_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir, variant="baseline")


@query(
    "prepared_interaction_temporal",
    _sql_prepared(INTERACTION_SQL + TEMPORAL_SQL, BASE + [n for _, n in INTERACTION_SQL + TEMPORAL_SQL]),
)
def prepared_interaction_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir, variant="tomek_interaction_temporal_fe")


NO_Y_SQL = [(e, n) for e, n in TEMPORAL_SQL if not feat.is_y_column(n)]


@query(
    "prepared_temporal_without_y",
    _sql_prepared(NO_Y_SQL, [c for c in BASE if not feat.is_y_column(c)] + [n for _, n in NO_Y_SQL]),
)
def prepared_temporal_without_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir, variant="temporal_fe", no_y=True)


ORACLE_SQL = [
    (f"lead({v}, {2 + o}) over {W}", f"oracle_{v}_h2_plus{o}") for v in WEATHER_VARIABLES for o in ORACLE_OFFSETS
]


@query(
    "prepared_oracle",
    _sql_prepared(ORACLE_SQL, [c for c in BASE if not feat.is_formula_column(c)] + [n for _, n in ORACLE_SQL]),
)
def prepared_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir, variant="baseline", oracle=True)


@query(
    "approximate_medians",
)
def approximate_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fit_medians(site_panel(spark, sf_dir), BASE, approximate=True))
