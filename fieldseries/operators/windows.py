"""Point-in-time operators over one series.

Each operator builds all of its columns in a single ``select`` over one window
specification, so a whole feature set costs one shuffle and one sort on
``(keys, order)``. Chained operators on the same panel reuse that layout.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseries.panel import Panel
from fieldseries.schema import (
    LABEL,
    LEADS,
    ORACLE_OFFSETS,
    WEATHER_VARIABLES,
    WEATHER_WINDOWS,
)

POSITION = "_pos"


def add_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace many columns in one projection."""
    return df.withColumns(columns) if columns else df


def horizon_labels(df: DataFrame, horizons: Iterable[int], panel: Panel, label: str = LABEL) -> DataFrame:
    """``target_h{h}``: the label ``h`` rows ahead in the same series."""
    columns = {}
    for h in horizons:
        if h < 0:
            raise ValueError("horizon must be non-negative")
        columns[f"target_h{h}"] = F.lead(label, h).over(panel.window()) if h else F.col(label)
    return add_columns(df, columns)


def forward_fill(df: DataFrame, columns: Iterable[str], panel: Panel) -> DataFrame:
    """Last known value of the series so far; never looks ahead.

    Order and key columns have no gaps, so they are left alone.
    """
    names = [c for c in columns if c in df.columns and c not in panel.columns]
    return add_columns(df, {c: F.last(c, ignorenulls=True).over(panel.running()) for c in names})


def lag_columns(columns: Iterable[str], steps: Iterable[int], panel: Panel) -> dict[str, Column]:
    steps = list(steps)
    return {f"{c}_lag_{k}": F.lag(c, k).over(panel.window()) for c in columns for k in steps}


_STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def rolling(column: str, rows: int, stat: str, panel: Panel, min_rows: int = 1) -> Column:
    """Statistic of the last ``rows`` rows; null below ``min_rows`` known values."""
    frame = panel.trailing(rows)
    value = _STATS[stat](column).over(frame)
    if min_rows <= 1:
        return value
    return F.when(F.count(column).over(frame) >= min_rows, value)


def trend(column: str, rows: int, panel: Panel) -> Column:
    """Mean of the last ``rows`` rows minus the mean of the ``rows`` before them."""
    before = panel.window().rowsBetween(-(2 * rows - 1), -rows)
    now = rolling(column, rows, "mean", panel, min_rows=rows)
    earlier = F.when(F.count(column).over(before) >= rows, F.avg(column).over(before))
    return now - earlier


def true_run_length(df: DataFrame, flags: dict[str, str], panel: Panel) -> DataFrame:
    """``{output: flag}``: number of consecutive true rows ending here, 0 on a false row.

    The run is the distance to the last false row, so all runs share the
    window of the other features instead of one grouping per island.
    """
    df = df.withColumn(POSITION, F.row_number().over(panel.window()))
    columns = {}
    for output, name in flags.items():
        last_false = F.last(
            F.when(F.coalesce(F.col(name), F.lit(0.0)) == 0, F.col(POSITION)), ignorenulls=True
        ).over(panel.running())
        columns[output] = (F.col(POSITION) - F.coalesce(last_false, F.lit(0))).cast("double")
    return add_columns(df, columns).drop(POSITION)


#: Names of columns that later steps and stored runs refer to.
ORACLE_NAME = "oracle_{feature}_h{horizon}_plus{offset}"


class Head(NamedTuple):
    """One weather target: the column that is learned and the persistence next to it."""

    target: str
    baseline: str


WEATHER_HEADS = {(lead, v): Head(f"{lead}_{v}", f"{lead}_{v}_persistence") for lead in LEADS for v in WEATHER_VARIABLES}


def oracle_window(df: DataFrame, horizon: int, features: Iterable[str], panel: Panel) -> tuple[DataFrame, list[str]]:
    """Observed values ``h .. h+4`` rows ahead: an upper bound, not a forecast."""
    if horizon < 0:
        raise ValueError(f"a horizon looks ahead, {horizon} does not")
    columns = {
        ORACLE_NAME.format(feature=f, horizon=int(horizon), offset=o): F.lead(f, horizon + o).over(panel.window())
        for f in features
        for o in ORACLE_OFFSETS
    }
    return add_columns(df, columns), list(columns)


def look_back_names(features: Iterable[str], rows: int) -> list[str]:
    return [f"{f}_win_lag_{k}" for f in features for k in range(rows - 1, -1, -1)]


def look_back(
    df: DataFrame, features: list[str], rows: int, panel: Panel, output: str = "look_back"
) -> DataFrame:
    """Flat look-back of finalised rows as one array, feature-major, oldest first.

    The array keeps the plan narrow: its names are :func:`look_back_names`.
    Rows without a full history are dropped. Give it written rows (the plans
    do): stacked on the null checks of a hundred computed features, the
    optimizer would try to infer constraints for every combination of them.
    """
    if int(rows) <= 0:
        raise ValueError("window_size must be positive")
    history = F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(panel.trailing(rows))
    per_feature = F.transform(
        F.sequence(F.lit(0), F.lit(len(features) - 1)),
        lambda i: F.transform(F.col(output), lambda row: F.get(row, i)),
    )
    return (
        df.withColumn(output, history)
        .where(F.size(output) == rows)
        .withColumn(output, F.flatten(per_feature))
    )


def look_back_columns(df: DataFrame, features: list[str], rows: int, panel: Panel) -> tuple[DataFrame, list[str]]:
    """The same look-back as named columns, for narrow feature lists."""
    if int(rows) <= 0:
        raise ValueError("window_size must be positive")
    w = panel.window()
    columns = {
        f"{f}_win_lag_{k}": F.lag(f, k).over(w) for f in features for k in range(rows - 1, -1, -1)
    }
    out = add_columns(df, {**columns, POSITION: F.row_number().over(w)})
    return out.where(F.col(POSITION) >= rows).drop(POSITION), list(columns)


def weather_feature_names(rows: int) -> list[str]:
    return [f"{v}_lag_{k}" for k in range(rows) for v in WEATHER_VARIABLES]


def weather_windows(df: DataFrame, rows: int, panel: Panel) -> tuple[DataFrame, list[str]]:
    """Supervised rows: ``rows`` days of history, targets at t+1 and t+2, persistence.

    Rows with a null target are dropped; features may be null.
    """
    if rows not in WEATHER_WINDOWS:
        raise ValueError(f"a history of {rows} days is not among {WEATHER_WINDOWS}")
    w = panel.window()
    lags = {f"{v}_lag_{k}": F.lag(v, k).over(w) for k in range(rows) for v in WEATHER_VARIABLES}
    leads = {head.target: F.lead(v, LEADS[lead]).over(w) for (lead, v), head in WEATHER_HEADS.items()}
    position = {POSITION: F.row_number().over(w)}
    framed = df.select(*panel.columns, *[c.alias(n) for n, c in {**lags, **leads, **position}.items()])
    baselines = {head.baseline: F.col(f"{v}_lag_0") for (_, v), head in WEATHER_HEADS.items()}
    samples = (
        framed.where(F.col(POSITION) >= rows)
        .drop(POSITION)
        .dropna(subset=list(leads))
        .withColumns(
            {
                "sample_id": F.concat_ws("_", *[F.col(c).cast("string") for c in panel.columns]),
                "window_size": F.lit(int(rows)),
                **baselines,
            }
        )
    )
    return samples, weather_feature_names(rows)


def rolling_rule_score(df: DataFrame, daily: Column, target: str, rows: int, panel: Panel) -> DataFrame:
    """A daily rule summed over a full window; incomplete rows are dropped."""
    return (
        df.withColumn("rule_score_daily", daily)
        .withColumn("rule_score", rolling("rule_score_daily", rows, "sum", panel, min_rows=rows))
        .select(*panel.columns, F.col(target), "rule_score")
        .dropna()
        .withColumn(target, F.col(target).cast("int"))
    )


def sequence_samples(df: DataFrame, features: list[str], target: str, rows: int, panel: Panel) -> DataFrame:
    """``[rows][feature]`` arrays ending at each row, with the label of that row."""
    step = F.array(*[F.col(f).cast("float") for f in features])
    return (
        df.withColumn("sequence", F.collect_list(step).over(panel.trailing(rows)))
        .where(F.size("sequence") == rows)
        .where(F.forall("sequence", lambda day: F.forall(day, lambda v: v.isNotNull() & ~F.isnan(v))))
        .where(F.col(target).isNotNull())
        .select(*panel.columns, F.col(target).cast("double").alias(target), "sequence")
    )


def next_step_labels(df: DataFrame, target: str, rows: int, panel: Panel) -> DataFrame:
    """Labels of the rows that have ``rows`` rows before them."""
    return (
        df.select(*panel.columns, F.col(target).cast("int").alias(target), F.row_number().over(panel.window()).alias(POSITION))
        .where(F.col(POSITION) > rows)
        .drop(POSITION)
    )


def series_position(df: DataFrame, panel: Panel) -> DataFrame:
    """Series id and 0-based position, the two index columns of a sequence model."""
    return df.withColumns(
        {
            "series_id": F.concat_ws("_", *[F.col(k).cast("string") for k in panel.keys]),
            "time_idx": F.row_number().over(panel.window()) - 1,
        }
    )


def long_context(samples: DataFrame, rows: int) -> DataFrame:
    """One row per sample and time step, oldest first, from the lag columns."""
    steps = F.array(
        *[
            F.struct(*[F.col(f"{v}_lag_{rows - 1 - t}").alias(v) for v in WEATHER_VARIABLES])
            for t in range(rows)
        ]
    )
    return samples.select(
        F.col("sample_id").alias("id"), F.posexplode(steps).alias("timestamp", "step")
    ).select("id", "timestamp", *[F.col(f"step.{v}").alias(v) for v in WEATHER_VARIABLES])
