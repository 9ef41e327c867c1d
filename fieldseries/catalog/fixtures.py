"""Panels and score tables derived from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseries.operators.impute import impute_panel
from fieldseries.operators.materialize import materialize
from fieldseries.operators.split import split_cuts, with_split
from fieldseries.operators.windows import horizon_labels
from fieldseries.panel import Panel
from fieldseries.schema import FEATURE_COLUMNS, SOURCE_COLUMNS

SITE = Panel(keys=("site", "year"), order="day")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add_when(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


def site_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel of shipments per supplier nation, as (site, year, day).

    Line items are added up per supplier and day before they meet the supplier
    table, so the join moves day totals, also for a supplier with a third of
    all rows.
    """
    items = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.year("l_shipdate").alias("year"),
        F.dayofyear("l_shipdate").alias("day"),
        "l_quantity",
        "l_returnflag",
        F.round(F.col("l_tax") * 100).cast("int").alias("tax"),
        F.round(F.col("l_discount") * 100).cast("int").alias("discount"),
    )
    returned, accepted = F.col("l_returnflag") == "R", F.col("l_returnflag") == "A"
    per_supplier = items.groupBy("l_suppkey", "year", "day").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("l_quantity").alias("q0"),
        F.max("l_quantity").alias("q1"),
        F.sum("l_quantity").alias("qs"),
        _add_when(returned, F.lit(1)).alias("nr"),
        _add_when(accepted, F.lit(1)).alias("na"),
        _add_when(returned, F.col("tax")).alias("px"),
        F.sum("discount").alias("cs"),
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("site"))
    days = (
        per_supplier.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("site", "year", "day")
        .agg(F.min("q0").alias("q0"), F.max("q1").alias("q1"), *[F.sum(c).alias(c) for c in ("n", "qs", "nr", "na", "px", "cs")])
    )
    wet = F.col("nr") > F.col("na")
    e = days.select(
        "site", "year", "day", "n", "nr", "na",
        (0.6 * F.col("q0")).alias("t_min"),
        (0.6 * F.col("q1")).alias("t_max"),
        (0.6 * F.col("qs") / F.col("n")).alias("t"),
        F.when(wet, 1.0).otherwise(0.0).alias("rain"),
        F.when(wet, F.col("px") / 10.0).otherwise(0.0).alias("prec"),
        (F.col("cs") * 1.0 / F.col("n")).alias("cloud"),
    )
    warm = F.col("t") > 10
    favorable = (F.col("rain") == 1) & F.col("t").between(10, 25) & (F.col("cloud") >= 4)
    return e.select(
        "site", "year", "day", "t_min", "t_max",
        F.when((F.col("site") + F.col("year") + F.col("day")) % 13 != 0, F.col("rain")).alias("is_rain"),
        F.when(favorable, 1).otherwise(0).alias("target_favorable"),
        F.col("nr").cast("double").alias("y2"),
        F.col("na").cast("double").alias("y1"),
        (F.col("nr") - F.col("na")).cast("double").alias("y2_y1"),
        F.col("prec").alias("precipitation"),
        F.when((F.col("site") + F.col("day")) % 17 != 0, F.col("t")).alias("t_avg"),
        F.when((F.col("year") + F.col("day")) % 11 != 0, F.col("cloud")).alias("cloudiness"),
        F.col("n").cast("double").alias("y3"),
        (F.col("rain") * F.col("cloud")).alias("y4"),
        F.when(warm, F.col("prec")).otherwise(0.0).alias("precipitation_t_gt_10"),
        F.when(warm, 1.0).otherwise(0.0).alias("t_gt_10"),
    )


PANEL_CTE = f"""
d as (
  select s_nationkey as site, year(l_shipdate) as year, dayofyear(l_shipdate) as day, count(*) as n,
         min(l_quantity) as q0, max(l_quantity) as q1, sum(l_quantity) as qs,
         sum(case when l_returnflag = 'R' then 1 else 0 end) as nr,
         sum(case when l_returnflag = 'A' then 1 else 0 end) as na,
         sum(case when l_returnflag = 'R' then cast(round(l_tax * 100) as int) else 0 end) as px,
         sum(cast(round(l_discount * 100) as int)) as cs
  from lineitem join supplier on l_suppkey = s_suppkey
  group by s_nationkey, year(l_shipdate), dayofyear(l_shipdate)),
e as (
  select *, 0.6e0 * q0 as t_min, 0.6e0 * q1 as t_max, 0.6e0 * qs / n as t_avg,
         case when nr > na then 1e0 else 0e0 end as rain, case when nr > na then px / 10e0 else 0e0 end as prec,
         cs * 1e0 / n as cloud
  from d),
panel as (
select cast(site as int) as site, cast(year as int) as year, cast(day as int) as day, t_min, t_max,
       case when (site + year + day) % 13 = 0 then null else rain end as is_rain,
       case when rain = 1 and t_avg between 10 and 25 and cloud >= 4 then 1 else 0 end as target_favorable,
       cast(nr as double) as y2, cast(na as double) as y1, cast(nr - na as double) as y2_y1,
       prec as precipitation,
       case when (site + day) % 17 = 0 then null else t_avg end as t_avg,
       case when (year + day) % 11 = 0 then null else cloud end as cloudiness,
       cast(n as double) as y3, rain * cloud as y4,
       case when t_avg > 10 then prec else 0e0 end as precipitation_t_gt_10,
       case when t_avg > 10 then 1e0 else 0e0 end as t_gt_10
from e)"""

W = "(partition by site, year order by day)"


def over(rows_before: int, rows_until: int = 0) -> str:
    end = "current row" if rows_until == 0 else f"{rows_until} preceding"
    return f"over (partition by site, year order by day rows between {rows_before} preceding and {end})"


# X1 has seven years, so the split falls back to 4 / 1 / 2.
CUTS_CTE = """
years as (select distinct year from panel),
cuts as (
  select list_sort(list(year)) as ys, count(*) as n,
         cast(greatest(1, ceil(count(*) * 0.2e0)) as int) as n_test,
         cast(greatest(1, ceil((count(*) - greatest(1, ceil(count(*) * 0.2e0))) * 0.2e0)) as int) as n_val
  from years),
tagged as (
  select p.*, case when p.year >= c.ys[c.n - c.n_test + 1] then 'test'
                   when p.year >= c.ys[greatest(1, c.n - c.n_val - c.n_test) + 1] then 'validation'
                   else 'train' end as split
  from panel p, cuts c)"""

_IMPUTED = [c for c in FEATURE_COLUMNS if c != "day"]
_ZERO = {"is_rain", "precipitation", "precipitation_t_gt_10"}
FILL_CTE = (
    """
zeroed as (select site, year, day, split, target_favorable, """
    + ", ".join(f"coalesce({c}, 0) as {c}" if c in _ZERO else c for c in _IMPUTED)
    + """ from tagged),
carried as (select site, year, day, split, target_favorable, """
    + ", ".join(f"last_value({c} ignore nulls) {over(1000)} as {c}" for c in _IMPUTED)
    + """ from zeroed),
medians as (select """
    + ", ".join(f"median({c}) as m_{c}" for c in _IMPUTED)
    + """ from carried where split = 'train'),
filled as (select site, year, day, split, target_favorable, """
    + ", ".join(f"coalesce({c}, m_{c}, 0) as {c}" for c in _IMPUTED)
    + """ from carried, medians)"""
)

PANEL = f"with {PANEL_CTE}"
SPLIT = f"with {PANEL_CTE}, {CUTS_CTE}"
FILLED = f"with {PANEL_CTE}, {CUTS_CTE}, {FILL_CTE}"


def split_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with its splits; written once, as cuts, medians and rows are all read from it."""
    panel = materialize(site_panel(spark, sf_dir))
    return with_split(panel, split_cuts(panel, fallback=True))


def filled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled, _ = impute_panel(split_panel(spark, sf_dir), SITE)
    return filled.select("site", "split", *SOURCE_COLUMNS)


def labelled_panel(spark: SparkSession, sf_dir: str, horizon: int = 2) -> DataFrame:
    return horizon_labels(site_panel(spark, sf_dir), [horizon], SITE)


# -- score tables -------------------------------------------------------------


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mostly distinct scores with a 0/1 truth, seven groups."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 7).cast("int").alias("grp"),
        F.col("event_type").isin("error", "purchase").cast("int").alias("y_true"),
        (F.col("value") / 500.0).alias("y_score"),
    )


EVENT_SCORES = """with s as (
  select cast(user_id % 7 as int) as grp, case when event_type in ('error', 'purchase') then 1 else 0 end as y_true,
         value / 500.0e0 as y_score from events)"""


def tied_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven distinct scores, so nearly all pairs are ties."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 3).cast("int").alias("grp"),
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
        (F.col("l_discount") * 10).alias("y_score"),
    )


TIED_SCORES = """with s as (
  select cast(l_linenumber % 3 as int) as grp, case when l_returnflag = 'R' then 1 else 0 end as y_true,
         l_discount * 10 as y_score from lineitem)"""
