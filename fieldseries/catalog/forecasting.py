"""Autoregressive forecasts and forecasts from outside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseries.catalog.features import sql_weather_samples
from fieldseries.catalog.fixtures import PANEL, SITE, SPLIT, site_panel, split_panel
from fieldseries.catalog.registry import query, r6, rounded
from fieldseries.operators.forecast import SINGULAR, ar_forecast, arma_candidates, arma_forecast, attach_forecasts, external_forecasts
from fieldseries.operators.materialize import materialize
from fieldseries.operators.windows import long_context, weather_windows
from fieldseries.plans.weather import HEADS, long_heads
from fieldseries.schema import WEATHER_VARIABLES

SERIES = "partition by site order by year, day"


@query(
    "ar1_forecast",
    f"""{SPLIT}, tr as (select site, year, day, target_favorable * 1e0 as y, lag(target_favorable * 1e0) over ({SERIES}) as l,
        row_number() over (partition by site order by year desc, day desc) as r from tagged where split = 'train'),
      fit as (select site, sum(y * l) as xy, sum(l * l) as xx, avg(y) as m, max(case when r = 1 then y end) as y0
        from tr group by site),
      ahead as (select *, row_number() over ({SERIES}) as k from tagged where split <> 'train')
      select site, year, day, split, target_favorable as y_true,
        {r6('''case when m is null then 0.5e0 when xx is null or xx = 0 then m
          else least(greatest(pow(xy / xx, k) * y0, 0), 1) end''', 'y_score')}
      from ahead left join fit using (site)""",
)
def ar1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ar_forecast(split_panel(spark, sf_dir), ["site"], ["year", "day"], "target_favorable", 1))


def _cramer(s11: str, s12: str, s22: str, b1: str, b2: str) -> tuple[str, str, str]:
    """Solution of a symmetric 2x2 system by Cramer's rule, and whether it counts as singular."""
    det = f"({s11} * {s22} - {s12} * {s12})"
    singular = f"({s11} is null or {s11} * {s22} <= 0 or abs({det}) <= {SINGULAR!r} * {s11} * {s22})"
    return f"(({b1}) * {s22} - ({b2}) * {s12}) / {det}", f"({s11} * ({b2}) - {s12} * ({b1})) / {det}", singular


_A1, _A2, _S1 = _cramer("sum(l1 * l1)", "sum(l1 * l2)", "sum(l2 * l2)", "sum(l1 * y)", "sum(l2 * y)")
_P, _T, _S2 = _cramer("sum(l1 * l1)", "sum(l1 * le)", "sum(le * le)", "sum(l1 * y)", "sum(le * y)")
_ARMA_SCORE = """case when m is null then 0.5e0 when ph is null then m
          else least(greatest(pow(ph, k - 1) * (ph * y0 + th * e0), 0), 1) end"""


@query(
    "arma11_forecast",
    f"""{SPLIT}, tr as (select site, year, day, target_favorable * 1e0 as y,
        lag(target_favorable * 1e0, 1) over ({SERIES}) as l1, lag(target_favorable * 1e0, 2) over ({SERIES}) as l2,
        row_number() over (partition by site order by year desc, day desc) as r from tagged where split = 'train'),
      s1 as (select site, case when {_S1} then null else {_A1} end as a1, case when {_S1} then null else {_A2} end as a2
        from tr where l2 is not null group by site),
      re as (select tr.*, case when l2 is not null then y - a1 * l1 - a2 * l2 end as e from tr left join s1 using (site)),
      st as (select *, lag(e) over ({SERIES}) as le from re),
      s2 as (select site, case when {_S2} then null else {_P} end as ph, case when {_S2} then null else {_T} end as th
        from st where l1 is not null and le is not null group by site),
      fit as (select site, avg(y) as m, max(case when r = 1 then y end) as y0, max(case when r = 1 then coalesce(e, 0) end) as e0
        from st group by site),
      ahead as (select *, row_number() over ({SERIES}) as k from tagged where split <> 'train')
      select site, year, day, split, target_favorable as y_true, {r6(_ARMA_SCORE, 'y_score')}
      from ahead left join fit using (site) left join s2 using (site)""",
)
def arma11_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARMA(1, 1) with a long autoregression of two lags: both stages are 2x2 systems, as in the SQL."""
    return rounded(arma_forecast(split_panel(spark, sf_dir), ["site"], ["year", "day"], "target_favorable", 1, 1, long_order=2))


@query("arma_order_grid")
def arma_grid_rows(spark: SparkSession, sf_dir: str, window: int = 7) -> DataFrame:
    """Scores of every (AR, MA) candidate order of one window, with ``ar_order`` and ``ma_order``."""
    panel = materialize(split_panel(spark, sf_dir))
    each = [
        arma_forecast(panel, ["site"], ["year", "day"], "target_favorable", p, q).select("*", F.lit(p).alias("ar_order"), F.lit(q).alias("ma_order"))
        for p, q in arma_candidates(window)
    ]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return rounded(out)


@query("seasonal_ar_forecast")
def seasonal_ar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ar_forecast(split_panel(spark, sf_dir), ["site"], ["year", "day"], "target_favorable", 3, 7))


@query(
    "external_forecasts",
    f"{PANEL}, {sql_weather_samples(7)} "
    + " union all ".join(
        f"select concat_ws('_', site, year, day) as sample_id, '{lead}' as lead, '{v}' as variable, "
        f"{r6(f'{lead}_{v}', 'y_true')}, {r6(f'{v}_lag_{1 if lead == 'lead_1' else 0}', 'y_pred')} from samples "
        f"where {v}_lag_1 is not null and {v}_lag_0 is not null"
        for lead, v in HEADS
    ),
)
def external_forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context itself plays the forecaster: its last two steps are the leads."""
    samples, _ = weather_windows(site_panel(spark, sf_dir), 7, SITE)
    output = long_context(samples, 7).withColumnsRenamed({v: f"{v}_median" for v in WEATHER_VARIABLES})
    forecasts = external_forecasts(output)
    heads = long_heads(samples, ["sample_id"], {h: F.lit(None) for h in HEADS}).drop("y_baseline", "y_model")
    both = F.array(F.lit("lead_1"), F.lit("lead_2"))
    complete = forecasts.groupBy("sample_id", "variable").agg(F.count("y_pred").alias("n")).where("n = 2")
    wanted = complete.select("sample_id", "variable", F.explode(both).alias("lead"))
    return rounded(attach_forecasts(heads.join(wanted, ["sample_id", "lead", "variable"], "left_semi"), forecasts)).select(
        "sample_id", "lead", "variable", "y_true", "y_pred"
    )
