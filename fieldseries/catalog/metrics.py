"""Metrics over score tables and weather heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseries.catalog.features import KEYS, sql_weather_samples
from fieldseries.catalog.fixtures import (
    EVENT_SCORES,
    PANEL,
    SITE,
    SPLIT,
    TIED_SCORES,
    event_scores,
    site_panel,
    table,
    tied_scores,
)
from fieldseries.catalog.registry import query, r6, rounded
from fieldseries.functions.rules import at_least, clip_by_name
from fieldseries.operators import metrics as met
from fieldseries.operators.ranked import exact_quantiles
from fieldseries.operators.materialize import materialize
from fieldseries.operators.split import split_cuts, with_split
from fieldseries.operators.windows import weather_windows
from fieldseries.plans.weather import HEADS, blend_and_decide, evaluate_heads, long_heads, wide_predictions
from fieldseries.schema import RAIN, WEATHER_VARIABLES

DECIDED = ", p as (select *, case when y_score >= 0.5 then 1 else 0 end as y_pred from s)"
SQL_COUNTS = """sum(case when y_true = 1 and y_pred = 1 then 1 else 0 end) as tp,
  sum(case when y_true = 0 and y_pred = 1 then 1 else 0 end) as fp,
  sum(case when y_true = 1 and y_pred = 0 then 1 else 0 end) as fn,
  sum(case when y_true = 0 and y_pred = 0 then 1 else 0 end) as tn"""


def _decided(scores: DataFrame) -> DataFrame:
    return scores.withColumn("y_pred_binary", at_least(F.col("y_score"), 0.5))


@query("confusion_counts", f"{EVENT_SCORES}{DECIDED} select grp, {SQL_COUNTS} from p group by grp")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return met.confusion(_decided(event_scores(spark, sf_dir)), by=["grp"])


def sql_ratio(a: str, b: str) -> str:
    return f"coalesce(({a}) * 1e0 / nullif({b}, 0), 0)"


SQL_BINARY = ", ".join(
    [
        r6(sql_ratio("tp", "tp + fp"), "precision"),
        r6(sql_ratio("tp", "tp + fn"), "recall"),
        r6(sql_ratio("2 * tp", "2 * tp + fp + fn"), "f1"),
        r6(sql_ratio("tp + tn", "tp + fp + fn + tn"), "accuracy"),
    ]
)


@query(
    "binary_metrics",
    f"{EVENT_SCORES}{DECIDED}, c as (select grp, {SQL_COUNTS} from p group by grp) select grp, {SQL_BINARY} from c",
)
def binary_metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = met.confusion(_decided(event_scores(spark, sf_dir)), by=["grp"])
    return rounded(met.binary_metrics(counts, ["grp"]))


@query(
    "classification_report",
    f"""{TIED_SCORES}{DECIDED}, c as (select grp, {SQL_COUNTS} from p group by grp),
      k as (select grp, '0' as class, {sql_ratio('tn', 'tn + fn')} as p, {sql_ratio('tn', 'tn + fp')} as r,
              {sql_ratio('2 * tn', '2 * tn + fn + fp')} as f, tn + fp as s from c
            union all select grp, '1', {sql_ratio('tp', 'tp + fp')}, {sql_ratio('tp', 'tp + fn')},
              {sql_ratio('2 * tp', '2 * tp + fp + fn')}, tp + fn from c),
      a as (select grp, {sql_ratio('tp + tn', 'tp + fp + fn + tn')} as acc from c),
      u as (select * from k
            union all select grp, 'accuracy', acc, acc, acc, acc from a
            union all select grp, 'macro avg', avg(p), avg(r), avg(f), sum(s) from k group by grp
            union all select grp, 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s)
              from k group by grp)
      select grp, class, {r6('p', 'precision')}, {r6('r', 'recall')}, {r6('f', 'f1_score')},
        {r6('cast(s as double)', 'support')} from u""",
)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = met.confusion(_decided(tied_scores(spark, sf_dir)), by=["grp"])
    return rounded(met.classification_report(counts, ["grp"]))


def sql_curve(by: str) -> str:
    return f""", c0 as (select {by}, y_score, sum(y_true) as pos, sum(1 - y_true) as neg from s group by {by}, y_score),
      c as (select *, sum(pos) over (partition by {by} order by y_score desc rows unbounded preceding) as tp,
              sum(neg) over (partition by {by} order by y_score desc rows unbounded preceding) as fp,
              sum(neg) over (partition by {by} order by y_score rows unbounded preceding) as negcum,
              sum(pos) over (partition by {by}) as p, sum(neg) over (partition by {by}) as q from c0)"""


def sql_auc(by: str) -> str:
    return f"""select {by},
        {r6('case when max(p) > 0 and max(q) > 0 then sum(pos * (negcum - neg / 2e0)) / (max(p) * max(q)) end', 'roc_auc')},
        {r6('case when max(p) > 0 and max(q) > 0 then sum(pos * (tp * 1e0 / (tp + fp))) / max(p) end', 'pr_auc')}
      from c group by {by}"""


@query("auc_few_ties", f"{EVENT_SCORES}{sql_curve('grp')} {sql_auc('grp')}")
def auc_few_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(met.ranking_metrics(event_scores(spark, sf_dir), by=["grp"]))


@query("auc_heavy_ties", f"{TIED_SCORES}{sql_curve('grp')} {sql_auc('grp')}")
def auc_heavy_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(met.ranking_metrics(tied_scores(spark, sf_dir), by=["grp"]))


@query(
    "roc_points",
    f"""{EVENT_SCORES}{sql_curve('grp')} select grp, {r6('y_score', 'threshold')}, {r6('fp * 1e0 / q', 'fpr')},
      {r6('tp * 1e0 / p', 'tpr')} from c where p > 0 and q > 0
      union all select distinct grp, cast(null as double), 0e0, 0e0 from c where p > 0 and q > 0""",
)
def roc_point_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(met.roc_points(event_scores(spark, sf_dir), by=["grp"], ranges=16))


@query(
    "pr_points",
    f"""{EVENT_SCORES}{sql_curve('grp')} select grp, {r6('y_score', 'threshold')},
      {r6('tp * 1e0 / (tp + fp)', 'precision')}, {r6('tp * 1e0 / p', 'recall')} from c where p > 0 and q > 0
      union all select distinct grp, cast(null as double), 1e0, 0e0 from c where p > 0 and q > 0""",
)
def pr_point_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(met.pr_points(event_scores(spark, sf_dir), by=["grp"], ranges=16))


@query(
    "exact_quantiles",
    """select cast(user_id % 7 as int) as grp, 0 as q_index, round(quantile_cont(value, 0.1), 6) as quantile from events group by 1
      union all select cast(user_id % 7 as int), 1, round(quantile_cont(value, 0.5), 6) from events group by 1
      union all select cast(user_id % 7 as int), 2, round(quantile_cont(value, 0.99), 6) from events group by 1""",
)
def exact_quantile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "events").select((F.col("user_id") % 7).cast("int").alias("grp"), "value")
    return rounded(exact_quantiles(values, "value", [0.1, 0.5, 0.99], ["grp"], ranges=8))


@query(
    "class_balance",
    """with c as (select lang, sum(quality) as n_pos, sum(1 - quality) as n_neg
        from labels join documents on labels.doc_id = documents.doc_id group by lang)
      select lang, n_pos, n_neg, round(greatest(n_neg, 1) * 1e0 / greatest(n_pos, 1), 6) as class_ratio,
        round((n_pos + n_neg) * 1e0 / nullif(2 * n_pos, 0), 6) as weight_pos,
        round((n_pos + n_neg) * 1e0 / nullif(2 * n_neg, 0), 6) as weight_neg,
        n_pos = 0 or n_neg = 0 as single_class,
        case when n_neg = 0 then 1e0 when n_pos = 0 then 0e0 end as constant_probability from c""",
)
def class_balance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(met.class_balance(labelled, "quality", ["lang"]))


@query(
    "panel_counts",
    f"""{PANEL} select count(*) as n_rows, count(distinct year) as n_periods,
      array_to_string(list_sort(list(distinct year)), ',') as periods from panel""",
)
def panel_count_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return met.panel_counts(site_panel(spark, sf_dir))


# -- weather heads ----------------------------------------------------------------


def lag_mean_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads whose model is the mean of the last three days."""
    panel = materialize(site_panel(spark, sf_dir))
    samples, _ = weather_windows(panel, 7, SITE)
    tagged = with_split(samples, split_cuts(panel, fallback=True)).withColumn("model", F.lit("lag_mean"))
    model_of = {
        (lead, v): (F.col(f"{v}_lag_0") + F.col(f"{v}_lag_1") + F.col(f"{v}_lag_2")) / 3 for lead, v in HEADS
    }
    return long_heads(tagged, ["sample_id", *SITE.columns, "split", "model", "window_size"], model_of)


def sql_clip(variable: str, value: str) -> str:
    if variable == "precipitation":
        return f"case when {value} is not null then greatest({value}, 0) end"
    if variable == "cloudiness":
        return f"case when {value} is not null then least(greatest({value}, 0), 10) end"
    if variable == RAIN:
        return f"case when {value} is not null then least(greatest({value}, 0), 1) end"
    return value


def _sql_heads() -> str:
    parts = []
    for lead, v in HEADS:
        model = f"(({v}_lag_0 + {v}_lag_1 + {v}_lag_2) / 3)"
        parts.append(
            f"select concat_ws('_', site, year, day) as sample_id, {KEYS}, split, '{lead}' as lead, '{v}' as variable, "
            f"{lead}_{v} as y_true, {sql_clip(v, f'{v}_lag_0')} as y_baseline, {sql_clip(v, model)} as y_model from ts"
        )
    return " union all ".join(parts)


HEADS_SQL = f"""{SPLIT}, {sql_weather_samples(7)},
  ts as (select x.*, y.split from samples x join (select distinct year, split from tagged) y on x.year = y.year),
  heads as ({_sql_heads()})"""


@query(
    "weather_heads",
    f"""{HEADS_SQL} select sample_id, {KEYS}, split, 'lag_mean' as model, 7 as window_size, lead, variable,
      {r6('y_true', 'y_true')}, {r6('y_baseline', 'y_baseline')}, {r6('y_model', 'y_model')} from heads""",
)
def weather_head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lag_mean_heads(spark, sf_dir))


def sql_regression(y: str, p: str) -> str:
    both = f"filter (where {y} is not null and {p} is not null)"
    return ", ".join(
        [
            r6(f"avg(abs({p} - {y})) {both}", "mae"),
            r6(f"sqrt(avg(({p} - {y}) * ({p} - {y})) {both})", "rmse"),
            r6(f"avg(coalesce(2 * abs({p} - {y}) / nullif(abs({y}) + abs({p}), 0), 0)) {both}", "smape"),
            r6(
                f"case when count(*) {both} >= 2 and min({y}) {both} <> max({y}) {both} "
                f"then 1 - sum(({p} - {y}) * ({p} - {y})) {both} / (count(*) {both} * var_pop({y}) {both}) end",
                "r2",
            ),
        ]
    )


@query(
    "regression_metrics",
    f"{HEADS_SQL} select lead, variable, {sql_regression('y_true', 'y_model')} from heads group by lead, variable",
)
def regression_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(met.regression_metrics(lag_mean_heads(spark, sf_dir), "y_true", "y_model", ["lead", "variable"]))


@query(
    "persistence_metrics",
    f"""{HEADS_SQL} select lead, variable, {sql_regression('y_true', 'y_baseline')} from heads
      where split = 'test' group by lead, variable""",
)
def persistence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = lag_mean_heads(spark, sf_dir).where(F.col("split") == "test")
    return rounded(met.regression_metrics(test, "y_true", "y_baseline", ["lead", "variable"]))


@query(
    "brier_score",
    f"""{HEADS_SQL} select lead, {r6('avg((y_model - y_true) * (y_model - y_true))', 'brier')} from heads
      where variable = 'is_rain' group by lead""",
)
def brier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rain = lag_mean_heads(spark, sf_dir).where(F.col("variable") == RAIN)
    return rounded(met.brier(rain, "y_true", "y_model", ["lead"]))


@query(
    "clipped_values",
    f"{PANEL} "
    + " union all ".join(
        f"select {KEYS}, '{v}' as variable, round({sql_clip(v, f'({v} - 3)')}, 6) as clipped from panel"
        for v in WEATHER_VARIABLES
    ),
)
def clipped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(v).alias("variable"), (F.col(v) - 3).alias("x")) for v in WEATHER_VARIABLES])
    long = site_panel(spark, sf_dir).select(*SITE.columns, F.explode(entries).alias("e")).select(*SITE.columns, "e.*")
    return rounded(long.select(*SITE.columns, "variable", clip_by_name(F.col("variable"), F.col("x")).alias("clipped")))


def _sql_blend_losses() -> str:
    parts = []
    for i in range(21):
        w = repr(1.0 if i == 20 else i * (1.0 / 20))
        mixed = f"({w}e0 * y_model + (1e0 - {w}e0) * y_baseline)"
        clipped = (
            f"case when variable = 'precipitation' then greatest({mixed}, 0) "
            f"when variable = 'cloudiness' then least(greatest({mixed}, 0), 10) "
            f"when variable = 'is_rain' then least(greatest({mixed}, 0), 1) else {mixed} end"
        )
        parts.append(
            f"select lead, variable, {w}e0 as w, round(avg(case when variable = 'is_rain' "
            f"then (({clipped}) - y_true) * (({clipped}) - y_true) else abs(({clipped}) - y_true) end), 12) as loss from known "
            "group by lead, variable"
        )
    return " union all ".join(parts)


BLEND_SQL = f"""{HEADS_SQL}, known as (select * from heads where split = 'validation' and y_true is not null
      and y_model is not null and y_baseline is not null),
  losses as ({_sql_blend_losses()}),
  weights as (select lead, variable, w as blend_weight, loss as blend_loss from losses
      qualify row_number() over (partition by lead, variable order by loss, w) = 1)"""


@query(
    "blend_weights",
    f"""{BLEND_SQL}, n as (select lead, variable, count(*) as n_all,
        count(case when y_true is not null and y_model is not null and y_baseline is not null then 1 end) as n_pairs
        from heads where split = 'validation' group by lead, variable)
      select lead, variable, {r6('blend_weight', 'blend_weight')}, {r6('blend_loss', 'blend_loss')}, n_pairs,
        n_all - n_pairs as n_skipped from weights join n using (lead, variable)""",
)
def blend_weight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldseries.operators.thresholds import search_blend_weight

    validation = lag_mean_heads(spark, sf_dir).where(F.col("split") == "validation")
    return rounded(search_blend_weight(validation, ["lead", "variable"]))


GRID = ", ".join(repr(0.95 if i == 18 else i * ((0.95 - 0.05) / 18) + 0.05) + "e0" for i in range(19))


def sql_rain_threshold(source: str, by: str) -> str:
    """CTEs ending in ``rain_best``; ``source`` has by, y_true and y_score."""
    return f"""rain_cand as (select distinct {by}, t from (
        select {by}, unnest([{GRID}]) as t from (select distinct {by} from {source})
        union all select {by}, round_even(y_score * 1e8, 0) / 1e8 from {source})),
      rain_m as (select c.{by}, c.t, sum(case when s.y_score >= c.t and s.y_true = 1 then 1 else 0 end) as tp,
          sum(case when s.y_score >= c.t and s.y_true = 0 then 1 else 0 end) as fp,
          sum(case when s.y_score < c.t and s.y_true = 1 then 1 else 0 end) as fn
        from rain_cand c join {source} s on c.{by} = s.{by} group by c.{by}, c.t),
      rain_r as (select {by}, t as threshold, {sql_ratio('2 * tp', '2 * tp + fp + fn')} as f1,
          {sql_ratio('tp', 'tp + fp')} as precision, {sql_ratio('tp', 'tp + fn')} as recall from rain_m),
      rain_best as (select * from rain_r
        qualify row_number() over (partition by {by} order by f1 desc, precision desc, recall desc, threshold) = 1)"""


def _unrounded(sql: str) -> str:
    """For metrics that are averaged again."""
    return sql.replace(", 6) as", ", 14) as")


WEATHER_SQL = f"""{BLEND_SQL},
  mixed as (select h.*, blend_weight, blend_weight * y_model + (1 - blend_weight) * y_baseline as mix
    from heads h join weights using (lead, variable) where split in ('validation', 'test')),
  blended as (select *, case when variable = 'precipitation' then {sql_clip('precipitation', 'mix')}
      when variable = 'cloudiness' then {sql_clip('cloudiness', 'mix')}
      when variable = 'is_rain' then {sql_clip('is_rain', 'mix')} else mix end as y_pred from mixed),
  rain_rows as (select lead, cast(y_true as int) as y_true, coalesce(y_pred, 0) as y_score from blended
    where variable = 'is_rain' and split = 'validation'),
  {sql_rain_threshold('rain_rows', 'lead')},
  s as (select b.lead, cast(b.y_true as int) as y_true, b.y_pred as y_score, r.threshold, b.blend_weight,
          case when b.y_pred >= r.threshold then 1 else 0 end as y_pred
        from blended b join rain_best r using (lead) where variable = 'is_rain' and split = 'test' and b.y_pred is not null),
  counts as (select lead, {SQL_COUNTS} from s group by lead){sql_curve('lead')},
  auc as ({_unrounded(sql_auc('lead'))}),
  rain_metrics as (select lead, 'is_rain' as variable, 'classification' as metric_family, {_unrounded(SQL_BINARY)} from counts),
  rain_other as (select lead, avg((y_score - y_true) * (y_score - y_true)) as brier, max(threshold) as threshold,
      max(blend_weight) as blend_weight from s group by lead),
  reg_metrics as (select lead, variable, 'regression' as metric_family, {_unrounded(sql_regression('y_true', 'y_pred'))},
      max(blend_weight) as blend_weight from blended where variable <> 'is_rain' and split = 'test' group by lead, variable),
  metrics as (
    select lead, variable, metric_family, mae, rmse, smape, r2, null::double as accuracy, null::double as f1,
      null::double as precision, null::double as recall, null::double as roc_auc, null::double as brier,
      null::double as threshold, blend_weight from reg_metrics
    union all
    select lead, variable, metric_family, null, null, null, null, accuracy, f1, precision, recall, roc_auc, brier,
      threshold, blend_weight from rain_metrics join rain_other using (lead) join auc using (lead))"""
METRIC_NAMES = "mae rmse smape r2 accuracy f1 precision recall roc_auc brier threshold blend_weight".split()


@query(
    "weather_blend_metrics",
    f"""{WEATHER_SQL} select 'lag_mean' as model, 7 as window_size, lead, variable, metric_family,
      {', '.join(r6(m, m) for m in METRIC_NAMES)} from metrics""",
)
def weather_blend_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate_heads(blend_and_decide(lag_mean_heads(spark, sf_dir))))


@query(
    "weather_run_summary",
    f"""{WEATHER_SQL}, m as (select avg(mae) as mean_mae, avg(rmse) as mean_rmse, avg(smape) as mean_smape,
        avg(r2) as mean_r2, avg(accuracy) as rain_accuracy, avg(f1) as rain_f1, avg(brier) as rain_brier from metrics)
      select 'lag_mean' as model, 7 as window_size, {', '.join(r6(c, c) for c in
        'mean_mae mean_rmse mean_smape mean_r2 rain_accuracy rain_f1 rain_brier'.split())},
        {r6('(mean_smape + rain_brier + 1 - rain_f1) / 3', 'weather_score_lower_is_better')} from m""",
)
def weather_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(met.run_summary(evaluate_heads(blend_and_decide(lag_mean_heads(spark, sf_dir)))))


def _wide_sql() -> str:
    columns = []
    for lead, v in HEADS:
        here = f"lead = '{lead}' and variable = '{v}'"
        columns.append(r6(f"max(y_true) filter (where {here})", f"{lead}_{v}_true"))
        if v == RAIN:
            columns.append(r6(f"max(y_pred) filter (where {here})", f"{lead}_{v}_score"))
            columns.append(f"max(y_hit) filter (where {here}) as {lead}_{v}_pred")
        else:
            columns.append(r6(f"max(y_pred) filter (where {here})", f"{lead}_{v}_pred"))
    return ", ".join(columns)


@query(
    "weather_predictions",
    f"""{WEATHER_SQL} select sample_id, {KEYS}, {_wide_sql()} from (
        select b.*, case when variable = 'is_rain' and y_pred is not null then
          case when y_pred >= r.threshold then 1 else 0 end end as y_hit
        from blended b join rain_best r using (lead) where split = 'test') group by sample_id, {KEYS}""",
)
def weather_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wide_predictions(blend_and_decide(lag_mean_heads(spark, sf_dir)), ["sample_id", *SITE.columns]))
