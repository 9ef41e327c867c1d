"""Cleaning of raw cells, keys and day numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseries.catalog.fixtures import PANEL, SITE, site_panel, table
from fieldseries.catalog.registry import query, r6, rounded
from fieldseries.catalog.selection import RUNS_SQL, event_runs
from fieldseries.functions.cleaning import coerce_numeric, rain_flag, repair_numeric
from fieldseries.operators.materialize import shared_folder
from fieldseries.panel import panel_violations
from fieldseries.sources.readers import (
    canonical_days,
    cap_rows,
    panel_keys,
    read_named,
    read_weather,
    season_days,
    union_tables,
    weather_panel,
)
from fieldseries.schema import SOURCE_COLUMNS
from fieldseries.sources.sinks import commit_run, params_json, read_committed, write_runs

ROW = "l_orderkey, l_linenumber"
# Each seventh of the line items gets another kind of hand-typed cell.
DIRTY = """case l_orderkey % 7
  when 0 then '-' when 1 then concat(' ', {nbsp}, replace(cast(l_tax as {text}), '.', ','), ' ')
  when 2 then concat('б', cast(l_linenumber as {text}), ',5') when 3 then 'nan'
  when 4 then concat(cast(l_linenumber as {text}), '.0d') when 5 then concat(' +', cast(l_discount as {text}), 'e1 ')
  else null end"""
SQL_DIRTY = DIRTY.format(nbsp="chr(160)", text="varchar")
NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def dirty_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.expr(DIRTY.format(nbsp="chr(160)", text="string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell"))


@query(
    "repaired_numbers",
    f"""with c as (select {ROW}, replace(replace(trim(replace({SQL_DIRTY}, chr(160), ' ')), 'б', '6'), ',', '.') as t from lineitem)
      select {ROW}, {r6(f'case when regexp_matches(t, {NUMBER}) then cast(t as double) end', 'number')} from c""",
)
def repaired_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = dirty_cells(spark, sf_dir)
    return rounded(cells.select("l_orderkey", "l_linenumber", repair_numeric(F.col("cell")).alias("number")))


@query(
    "coerced_numbers",
    f"""with c as (select {ROW}, trim({SQL_DIRTY}) as t from lineitem)
      select {ROW}, {r6(f'case when regexp_matches(t, {NUMBER}) then cast(t as double) end', 'number')} from c""",
)
def coerced_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = dirty_cells(spark, sf_dir)
    return rounded(cells.select("l_orderkey", "l_linenumber", coerce_numeric(F.col("cell")).alias("number")))


@query(
    "panel_keys",
    f"""{PANEL}, k as (select site, year + 0.25e0 as year, case when day % 10 = 0 then null else day + (site % 3) * 0.25e0 end as day,
        case when day % 7 = 3 then null else target_favorable * 1.5e0 - (site % 2) * 0.5e0 end as target from panel)
      select site, cast(round_even(year, 0) as int) as year, cast(round_even(day, 0) as int) as day,
        cast(least(greatest(round_even(target, 0), 0), 1) as int) as target_favorable, cast(null as double) as t_min
      from k where day is not null and target is not null""",
)
def panel_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = site_panel(spark, sf_dir).select(
        "site",
        (F.col("year") + 0.25).alias("year"),
        F.when(F.col("day") % 10 != 0, F.col("day") + (F.col("site") % 3) * 0.25).alias("day"),
        F.when(F.col("day") % 7 != 3, F.col("target_favorable") * 1.5 - (F.col("site") % 2) * 0.5).alias("target_favorable"),
    )
    return panel_keys(raw, SITE, features=["t_min"])


@query(
    "rain_flags",
    f"""{PANEL} select site, year, day, {r6('least(greatest(round_even(coalesce(is_rain * 2.5e0 - day % 3, 0), 0), 0), 1)', 'rain')}
      from panel""",
)
def rain_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("is_rain") * 2.5 - F.col("day") % 3
    return rounded(site_panel(spark, sf_dir).select(*SITE.columns, rain_flag(raw).alias("rain")))


@query(
    "weather_panel",
    f"""{PANEL} select site, year, day, {', '.join(r6(c, c) for c in ('t_min', 't_max', 't_avg', 'precipitation', 'cloudiness'))},
      coalesce(is_rain, 0) as is_rain from panel""",
)
def weather_panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(weather_panel(site_panel(spark, sf_dir), SITE))


SEASONS_SQL = f"""{PANEL}, u as (select distinct site, year from panel),
  days as (select site, year, unnest(range(152 + case when year % 4 = 0 then 1 else 0 end,
      152 + case when year % 4 = 0 then 1 else 0 end + 92)) as day from u),
  kept as (select * from days where not (site % 3 = 0 and day = 200))"""


@query(
    "season_days",
    f"""{SEASONS_SQL}, n as (select *, row_number() over (partition by site, year order by day) as r from kept)
      select site, year, cast(r as int) as line, site % 3 <> 0 as valid_days,
        cast(case when site % 3 <> 0 then day else 151 + case when year % 4 = 0 then 1 else 0 end + r end as int) as day
      from n""",
)
def season_day_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete seasons per site and year; every third site misses a day."""
    seasons = site_panel(spark, sf_dir).select("site", "year").distinct()
    days = canonical_days(seasons.select("year").distinct())
    lines = (
        seasons.join(days, "year")
        .where(~((F.col("site") % 3 == 0) & (F.col("day") == 200)))
        .withColumn("line", F.col("day"))
    )
    checked = season_days(lines, ["site", "year"], ["line"])
    first = F.when(F.col("year") % 4 == 0, 152).otherwise(151)
    missed = F.when((F.col("site") % 3 == 0) & (F.col("line") > 200), 1).otherwise(0)
    return checked.select("site", "year", (F.col("line") - first - missed).alias("line"), "valid_days", "day")


@query(
    "canonical_days",
    """with y as (select distinct cast(year(l_shipdate) as int) as year from lineitem)
      select year, cast(unnest(range(152, 244 + case when year % 4 = 0 then 1 else 0 end)) as int) as day from y""",
)
def canonical_day_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()
    return canonical_days(years, through_august=True)


@query(
    "capped_rows",
    """select l_suppkey, l_orderkey, l_linenumber from lineitem
      qualify row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber) <= 92""",
)
def capped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return cap_rows(items, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).drop("l_shipdate")


@query(
    "panel_violations",
    """with p as (select user_id, dayofyear(ts) as day, count(*) as n from events group by all)
      select user_id, cast(sum(n) as bigint) as n_rows, max(n) as max_copies from p group by user_id having max(n) > 1 or sum(n) > 366""",
)
def panel_violation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldseries.panel import Panel

    days = table(spark, sf_dir, "events").select("user_id", F.dayofyear("ts").alias("day"))
    return panel_violations(days, Panel(("user_id",), "day"))


@query(
    "union_by_name",
    """select 'orders' as source, cast(year(o_orderdate) as int) as year, count(*) as n_rows, null::bigint as n_items from orders group by 2
      union all select 'lineitem', cast(year(l_shipdate) as int), null, count(*) from lineitem group by 2""",
)
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.lit("orders").alias("source"), F.year("o_orderdate").alias("year"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.lit("lineitem").alias("source"), F.year("l_shipdate").alias("year"))
    count = F.count(F.lit(1))
    return union_tables([orders.agg(count.alias("n_rows")), items.agg(count.alias("n_items"))])


@query(
    "params_json",
    f"""{RUNS_SQL} select run_seq, '{{"model":"' || model || '","seq":' || run_seq || '}}' as best_params from runs""",
)
def params_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = event_runs(spark, sf_dir).select("run_seq", "model", F.col("run_seq").alias("seq"))
    return params_json(runs, ["model", "seq"])


# -- files: what is written is read back by the readers -------------------------------


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


WEATHER_COLUMNS = ("t_min", "t_max", "t_avg", "precipitation", "cloudiness")


@query(
    "flat_weather_read",
    f"""{PANEL} select site, year, day, {', '.join(r6(c, c) for c in WEATHER_COLUMNS)}, coalesce(is_rain, 0) as is_rain from panel""",
)
def flat_weather_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as CSV under hand-written headers, read as a flat weather table."""
    path = _new_folder(spark)
    headers = {"t_min": "T min", "t_max": " T-Max", "is_rain": "Is rain", "precipitation_t_gt_10": "Precipitation t>10"}
    site_panel(spark, sf_dir).withColumnsRenamed(headers).write.option("header", True).csv(path)
    return rounded(read_weather(spark, path, "csv", panel=SITE).withColumn("site", F.col("site").cast("int")))


_NUMBERS = [c for c in SOURCE_COLUMNS if c not in ("year", "day", "target_favorable")]


@query(
    "flat_named_read",
    f"""{PANEL} select site, year, day, target_favorable, {', '.join(r6(f'cast({c} as double)', c) for c in _NUMBERS)} from panel""",
)
def flat_named_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as CSV with decimal commas and a letter for a digit, read by header name."""
    path = _new_folder(spark)
    cells = {c: F.translate(F.col(c).cast("decimal(30,12)").cast("string"), ".6", ",б") for c in _NUMBERS}
    site_panel(spark, sf_dir).withColumns(cells).write.option("header", True).csv(path)
    read = read_named(spark, path, "csv", panel=SITE).withColumn("site", F.col("site").cast("int"))
    return rounded(read.select("site", *SOURCE_COLUMNS))


@query(
    "runs_written_twice",
    f"""{RUNS_SQL} select run_seq, cast(run_seq % 3 as varchar) as run_id, model from runs""",
)
def runs_written_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in partitions by run; writing one run again replaces it and leaves the others."""
    path = _new_folder(spark)
    runs = event_runs(spark, sf_dir).select("run_seq", (F.col("run_seq") % 3).cast("string").alias("run_id"), "model")
    write_runs(runs, path)
    write_runs(runs.where("run_id = '1'"), path)
    return spark.read.schema("run_seq long, model string, run_id string").parquet(path).select("run_seq", "run_id", "model")


@query(
    "committed_runs",
    f"""{RUNS_SQL} select run_seq, cast(run_seq % 3 as varchar) as run_id, model from runs where run_seq % 3 <> 1""",
)
def committed_run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs 0 and 2 committed with their tables sorted; run 1 stopped before its marker and is not read."""
    path = _new_folder(spark)
    runs = event_runs(spark, sf_dir).select("run_seq", (F.col("run_seq") % 3).cast("string").alias("run_id"), "model")
    for run in ("0", "2"):
        commit_run({"runs": runs.where(F.col("run_id") == run)}, path, run, {"runs": ["run_seq"]})
    # a run that stopped after its table and before its marker
    runs.where("run_id = '1'").drop("run_id").write.parquet(f"{path}/runs/run_id=1")
    return read_committed(spark, path, "runs", "run_seq long, model string").select("run_seq", "run_id", "model")
