"""Agronomic day rules, prediction predicates and clips.

Comparisons with null count as false, as a missing reading is no evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseries.schema import RAIN


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    return holds(condition).cast("double")


def _rain_signal() -> Column:
    return holds(F.col("is_rain") > 0) | holds(F.col("precipitation") >= 0.1)


def _points(condition: Column, points: float) -> Column:
    return F.when(holds(condition), F.lit(points)).otherwise(F.lit(0.0))


def blight_day_score() -> Column:
    """0..4: temperature band, rain and cloud."""
    t = F.col("t_avg")
    score = (
        _points(t.between(10, 24), 2.0)
        + _points(((t >= 7) & (t < 10)) | ((t > 24) & (t <= 27)), 1.0)
        + _points(_rain_signal(), 1.0)
        + _points(F.col("cloudiness") >= 6, 1.0)
    )
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(4.0))


def simulation_day_score() -> Column:
    """0..6: rain counts double, warm nights add a point."""
    score = (
        _points(_rain_signal(), 2.0)
        + _points(F.col("t_avg").between(10, 23), 2.0)
        + _points(F.col("t_min") >= 10, 1.0)
        + _points(F.col("cloudiness") >= 6, 1.0)
    )
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(6.0))


DAY_SCORES = {"blitecast": blight_day_score, "simcast": simulation_day_score}


def weighted_indicator_score() -> Column:
    """0.45 wet + 0.30 mild + 0.25 cloudy."""
    def reading(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    return (
        0.45 * flag(reading("precipitation") > 0)
        + 0.30 * flag(reading("t_avg").between(12, 20))
        + 0.25 * flag(reading("cloudiness") >= 6)
    )


SIGNAL_COLUMNS = ["is_rain", "precipitation_t_gt_10", "t_gt_10"]


def signal_mean_score(df: DataFrame, use_label: bool = False, label: str = "target_favorable") -> DataFrame:
    """Mean of the signals, each divided by its table maximum; adds ``y_score``.

    The maxima are one row, read back as a scalar subquery. ``use_label``
    restores the leaking variant that also averages the label itself.
    """
    wanted = ([label] if use_label else []) + SIGNAL_COLUMNS
    signals = [c for c in wanted if c in df.columns]
    if not signals:
        return df.withColumn("y_score", F.lit(0.0))

    def reading(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    maxima = df.agg(F.struct(*[F.max(reading(c)).alias(c) for c in signals]).alias("m")).scalar()
    total = F.lit(0.0)
    for name in signals:
        top = maxima.getField(name)
        total = total + reading(name) / F.when(top == 0, F.lit(1.0)).otherwise(top)
    mean = total / F.lit(float(len(signals)))
    return df.withColumn("y_score", F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)))


def at_least(score: Column, threshold: Column | float) -> Column:
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (score >= cut).cast("int")


def invert_predictions(df: DataFrame, pred: str = "y_pred_binary", score: str | None = "y_score") -> DataFrame:
    changed = {pred: (1 - F.col(pred)).cast("int")}
    if score is not None and score in df.columns:
        changed[score] = 1.0 - F.col(score)
    return df.withColumns(changed)


# Physical range of the variables that have one: (lowest, highest).
VARIABLE_RANGES = {"precipitation": (0.0, None), "cloudiness": (0.0, 10.0), RAIN: (0.0, 1.0)}


def _clip(value: Column, low: Column, high: Column) -> Column:
    # greatest and least skip nulls, so an absent bound does not bind
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def _bound(value: float | None) -> Column:
    return F.lit(value).cast("double")


def clip_variable(variable: str, value: Column) -> Column:
    """Clip to the physical range of one weather variable; null stays null."""
    if variable not in VARIABLE_RANGES:
        return value
    low, high = VARIABLE_RANGES[variable]
    return _clip(value, _bound(low), _bound(high))


def range_by_name(variable: Column) -> tuple[Column, Column]:
    low = F.when(variable.isin(*VARIABLE_RANGES), F.lit(0.0))
    high = F.when(variable == "cloudiness", F.lit(10.0)).when(variable == RAIN, F.lit(1.0))
    return low, high


def clip_by_name(variable: Column, value: Column) -> Column:
    """:func:`clip_variable` for a long table that names the variable in a column."""
    return _clip(value, *range_by_name(variable))


def sanitize_score(score: Column) -> Column:
    """Null and NaN become 0, +inf 1, -inf 0."""
    number = F.coalesce(score.cast("double"), F.lit(0.0))
    return (
        F.when(F.isnan(number) | (number == F.lit(float("-inf"))), F.lit(0.0))
        .when(number == F.lit(float("inf")), F.lit(1.0))
        .otherwise(number)
    )


def threshold_objective(recall: Column, precision: Column, f1: Column, min_precision: float) -> Column:
    """Above the precision floor recall decides, below it precision."""
    return F.when(
        precision >= min_precision, 1.0 + recall + 0.001 * precision + 0.000001 * f1
    ).otherwise(precision + 0.001 * recall + 0.000001 * f1)
