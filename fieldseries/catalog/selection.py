"""Thresholds, candidates, ranking of runs and the rule benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseries.catalog.features import (
    KEYS,
    LABELLED_FILLED,
    SQL_BLIGHT,
    SQL_SIMULATION,
    TEMPORAL_SQL,
)
from fieldseries.catalog.fixtures import (
    EVENT_SCORES,
    SITE,
    TIED_SCORES,
    W,
    event_scores,
    over,
    site_panel,
    table,
    tied_scores,
)
from fieldseries.catalog.metrics import (
    SQL_BINARY,
    SQL_COUNTS,
    sql_auc,
    sql_curve,
    sql_rain_threshold,
    sql_ratio,
)
from fieldseries.catalog.registry import query, r6, rounded
from fieldseries.functions.rules import at_least, threshold_objective
from fieldseries.operators import metrics as met
from fieldseries.operators import ranking as rank
from fieldseries.operators.ranked import ungroup, value_cells
from fieldseries.operators.thresholds import score_candidates, search_rain_threshold, search_threshold
from fieldseries.plans.disease import rule_benchmark

SQL_OBJECTIVE = """case when precision >= 0.6e0 then 1 + recall + 0.001e0 * precision + 0.000001e0 * f1
  else precision + 0.001e0 * recall + 0.000001e0 * f1 end"""


def sql_threshold(source: str, by: str, prefix: str = "t") -> str:
    """CTEs ending in ``{prefix}_best``: threshold search with precision floor 0.6."""
    return f"""{prefix}_rank as (select {by}, y_score, row_number() over (partition by {by} order by y_score) - 1 as k,
        count(*) over (partition by {by}) as n from {source}),
  {prefix}_size as (select {by}, count(distinct round_even(y_score * 1e10, 0)) as k, count(*) as n from {source} group by {by}),
  {prefix}_at as (select {by}, n, i, (case when i = 399 then 1e0 else i * (1e0 / 399) end) * (n - 1) as pos
      from {prefix}_size, range(400) r(i) where k > 400),
  {prefix}_lo as materialized (select a.{by}, a.n, a.pos, y_score as lo from {prefix}_at a
      join {prefix}_rank r on r.{by} = a.{by} and r.k = cast(floor(a.pos) as bigint)),
  {prefix}_hi as materialized (select a.{by}, a.pos, a.lo, y_score as hi from {prefix}_lo a
      join {prefix}_rank r on r.{by} = a.{by} and r.k = cast(least(floor(a.pos) + 1, a.n - 1) as bigint)),
  {prefix}_cand as (select distinct {by}, c from (
      select {by}, 0.5e0 as c from {prefix}_size
      union all select {by}, round_even(y_score * 1e10, 0) / 1e10 from {source} join {prefix}_size z using ({by}) where z.k <= 400
      union all select {by}, case when pos - floor(pos) >= 0.5 then hi - (hi - lo) * (1 - (pos - floor(pos)))
            else lo + (hi - lo) * (pos - floor(pos)) end from {prefix}_hi)),
  {prefix}_m as (select c.{by}, c.c as threshold, sum(case when s.y_score >= c.c and s.y_true = 1 then 1 else 0 end) as tp,
      sum(case when s.y_score >= c.c and s.y_true = 0 then 1 else 0 end) as fp,
      sum(case when s.y_score < c.c and s.y_true = 1 then 1 else 0 end) as fn
    from {prefix}_cand c join {source} s on c.{by} = s.{by} group by c.{by}, c.c),
  {prefix}_r as (select {by}, threshold, {sql_ratio('tp', 'tp + fp')} as precision, {sql_ratio('tp', 'tp + fn')} as recall,
      {sql_ratio('2 * tp', '2 * tp + fp + fn')} as f1 from {prefix}_m),
  {prefix}_best as (select *, {SQL_OBJECTIVE} as objective from {prefix}_r
    qualify row_number() over (partition by {by} order by precision >= 0.6e0 desc,
      case when precision >= 0.6e0 then recall else precision end desc,
      case when precision >= 0.6e0 then precision else recall end desc, f1 desc, threshold) = 1)"""


BEST = ", ".join(r6(c, c) for c in "threshold precision recall f1 objective".split())


@query("threshold_few_ties", f"{EVENT_SCORES}, {sql_threshold('s', 'grp')} select grp, {BEST} from t_best")
def threshold_few_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search_threshold(event_scores(spark, sf_dir), by=["grp"]))


@query("threshold_heavy_ties", f"{TIED_SCORES}, {sql_threshold('s', 'grp')} select grp, {BEST} from t_best")
def threshold_heavy_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search_threshold(tied_scores(spark, sf_dir), by=["grp"]))


@query(
    "threshold_ungrouped",
    f"{EVENT_SCORES}, u as (select 0 as g, y_true, y_score from s), {sql_threshold('u', 'g')} select {BEST} from t_best",
)
def threshold_ungrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search_threshold(event_scores(spark, sf_dir)))


@query("threshold_candidates", f"{EVENT_SCORES}, {sql_threshold('s', 'grp')} select grp, {r6('c', 'candidate')} from t_cand")
def threshold_candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = {"pos": F.col("y_true"), "n": F.lit(1)}
    cells = value_cells(event_scores(spark, sf_dir), "y_score", sums, ["grp"])
    return rounded(ungroup(score_candidates(cells), ["grp"], F.col("_v").alias("candidate")))


@query(
    "rain_threshold",
    f"""{EVENT_SCORES}, {sql_rain_threshold('s', 'grp')}
      select grp, {', '.join(r6(c, c) for c in 'threshold f1 precision recall'.split())} from rain_best""",
)
def rain_threshold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search_rain_threshold(event_scores(spark, sf_dir), by=["grp"]))


@query(
    "threshold_objective",
    f"""{TIED_SCORES}, p as (select *, case when y_score >= 0.5 then 1 else 0 end as y_pred from s),
      c as (select grp, {SQL_COUNTS} from p group by grp),
      m as (select grp, {sql_ratio('tp', 'tp + fp')} as precision, {sql_ratio('tp', 'tp + fn')} as recall,
        {sql_ratio('2 * tp', '2 * tp + fp + fn')} as f1 from c)
      select grp, {r6(SQL_OBJECTIVE, 'objective')} from m""",
)
def objective_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = tied_scores(spark, sf_dir).withColumn("y_pred_binary", at_least(F.col("y_score"), 0.5))
    rows = met.binary_metrics(met.confusion(decided, by=["grp"]), ["grp"])
    return rounded(
        rows.select("grp", threshold_objective(F.col("recall"), F.col("precision"), F.col("f1"), 0.6).alias("objective"))
    )


# -- runs: one per user bucket, three models ----------------------------------------


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run table of twelve user buckets; the AUC columns are null for every fifth."""
    scores = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 12).cast("int").alias("run_seq"),
        F.col("event_type").isin("error", "purchase").cast("int").alias("y_true"),
        (F.col("value") / 500.0).alias("y_score"),
    )
    decided = scores.withColumn("y_pred_binary", at_least(F.col("y_score"), 0.5))
    by = ["run_seq"]
    runs = met.binary_metrics(met.confusion(decided, by=by), by).join(met.ranking_metrics(scores, by=by), by)
    known = F.col("run_seq") % 5 != 0
    return runs.select(
        "run_seq",
        F.concat(F.lit("m"), (F.col("run_seq") % 3).cast("string")).alias("model"),
        "precision",
        "recall",
        "f1",
        F.when(known, F.col("pr_auc")).alias("pr_auc"),
        F.when(known, F.col("roc_auc")).alias("roc_auc"),
    )


RUNS_SQL = f"""with s as (select cast(user_id % 12 as int) as run_seq,
    case when event_type in ('error', 'purchase') then 1 else 0 end as y_true, value / 500.0e0 as y_score from events),
  p as (select *, case when y_score >= 0.5 then 1 else 0 end as y_pred from s),
  k as (select run_seq, {SQL_COUNTS} from p group by run_seq){sql_curve('run_seq')},
  a as ({sql_auc('run_seq')}),
  runs as (select run_seq, 'm' || (run_seq % 3) as model, {SQL_BINARY},
    case when run_seq % 5 <> 0 then pr_auc end as pr_auc, case when run_seq % 5 <> 0 then roc_auc end as roc_auc
    from k join a using (run_seq))"""
RANK_ORDER = """case when precision >= 0.4e0 then 1 else 0 end desc, recall desc, coalesce(pr_auc, -1) desc, f1 desc,
  coalesce(roc_auc, -1) desc, run_seq"""


@query(
    "top_runs",
    f"""{RUNS_SQL}, r as (select *, row_number() over (partition by model order by {RANK_ORDER}) as model_rank from runs)
      select run_seq, model, {r6('recall', 'recall')}, case when precision >= 0.4e0 then 1 else 0 end as precision_floor_met,
        {r6('coalesce(pr_auc, -1)', 'rank_pr_auc')}, {r6('coalesce(roc_auc, -1)', 'rank_roc_auc')}, model_rank
      from r where model_rank <= 2""",
)
def top_run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rank.top_runs(event_runs(spark, sf_dir), 2, 0.4)
    return rounded(
        kept.select("run_seq", "model", "recall", "precision_floor_met", "rank_pr_auc", "rank_roc_auc", "model_rank")
    )


@query(
    "top_runs_by_f1",
    f"""{RUNS_SQL} select run_seq, model, {r6('f1', 'f1')}, r as model_rank from
      (select *, row_number() over (partition by model order by f1 desc, run_seq) as r from runs) where r <= 2""",
)
def top_by_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rank.top_runs_by_f1(event_runs(spark, sf_dir), 2)
    return rounded(kept.select("run_seq", "model", "f1", "model_rank"))


@query(
    "leaderboard",
    f"""{RUNS_SQL} select model, run_seq as window_size, {r6('1 - roc_auc', 'weather_score_lower_is_better')}
      from runs order by weather_score_lower_is_better nulls last, model, window_size""",
)
def leaderboard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = event_runs(spark, sf_dir).select(
        "model", F.col("run_seq").alias("window_size"), (1 - F.col("roc_auc")).alias("weather_score_lower_is_better")
    )
    return rounded(rank.weather_leaderboard(summary))


IMPORTANCE = ["t_min", "t_max", "t_avg", "precipitation", "cloudiness", "y1", "y2", "y3"]


@query(
    "top_importances",
    f"""with {LABELLED_FILLED[5:]}, c as ("""
    + " union all ".join(
        f"select '{c}' as feature, abs(covar_pop({c}, target_favorable)) as v from panel" for c in IMPORTANCE
    )
    + f") select feature, {r6('v', 'importance')} from c order by v desc limit 5",
)
def top_importance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    strength = F.array(*[F.abs(F.covar_pop(c, "target_favorable")) for c in IMPORTANCE])
    one = site_panel(spark, sf_dir).agg(strength.alias("importances"))
    return rounded(rank.top_importances(one, "importances", IMPORTANCE, 5))


# -- the rule benchmark, from raw rows to test metrics --------------------------------


def _sql_benchmark() -> str:
    temporal = ", ".join(f"{e} as {n}" for e, n in TEMPORAL_SQL)
    known = " and ".join(f"{n} is not null" for _, n in TEMPORAL_SQL)
    return f"""{LABELLED_FILLED}, w as (select *, {temporal} from h),
  fin as (select * from w where target_h2 is not null and {known}),
  daily as (select {KEYS}, split, target_h2, {SQL_BLIGHT} as a, {SQL_SIMULATION} as b from fin),
  rolled as (select {KEYS}, split, target_h2 as y_true, row_number() over {W} as rn,
      sum(a) {over(6)} as blitecast, sum(b) {over(6)} as simcast from daily),
  scored as (select split, 'blitecast' as model, y_true, blitecast as y_score from rolled where rn >= 7
    union all select split, 'simcast', y_true, simcast from rolled where rn >= 7),
  val as (select model, y_true, y_score from scored where split = 'validation'),
  {sql_threshold('val', 'model')},
  s as (select x.model, x.y_true, x.y_score, case when x.y_score >= b.threshold then 1 else 0 end as y_pred
    from scored x join t_best b using (model) where split = 'test'),
  k as (select model, {SQL_COUNTS} from s group by model){sql_curve('model')},
  a as ({sql_auc('model')}),
  m as (select model, {SQL_BINARY} from k)
  select m.model, m.precision, m.recall, m.f1, m.accuracy, a.roc_auc, a.pr_auc, {r6('b.threshold', 'threshold')},
    {r6('b.objective', 'threshold_objective')}, {r6('b.precision', 'val_precision')}, {r6('b.recall', 'val_recall')},
    {r6('b.f1', 'val_f1')}, 0.6e0 as min_precision, m.precision >= 0.6e0 as precision_floor_met
  from m join a using (model) join t_best b using (model)"""


@query("rule_benchmark", _sql_benchmark())
def rule_benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rule_benchmark(site_panel(spark, sf_dir), SITE))
