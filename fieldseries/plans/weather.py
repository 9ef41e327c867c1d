"""The weather workload: six variables one and two days ahead.

Its twelve heads (two leads, six variables) are kept in one long table, so the
blend weights, thresholds and metrics of all heads come out of the same jobs.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseries.functions.rules import clip_by_name
from fieldseries.operators.features import reject_forbidden_inputs
from fieldseries.operators.impute import apply_medians, fit_medians
from fieldseries.operators.learners import (
    add_score,
    add_value,
    model_list,
    fit_classifier,
    fit_regressor,
    tune_head,
    with_vector,
)
from fieldseries.operators.lookup import attach_small
from fieldseries.operators.materialize import materialize
from fieldseries.operators.metrics import HEAD_COLUMNS, class_balance, evaluate_targets, run_summary
from fieldseries.operators.ranking import weather_leaderboard
from fieldseries.operators.split import TEST, TRAIN, VALIDATION, split_cuts, split_table, with_split
from fieldseries.operators.thresholds import blend, search_blend_weight, search_rain_threshold
from fieldseries.operators.windows import (
    WEATHER_HEADS,
    weather_windows,
)
from fieldseries.panel import Panel, check_panel
from fieldseries.schema import LEADS, RAIN, WEATHER_VARIABLES
from fieldseries.sources.readers import union_tables

HEADS = [(lead, variable) for lead in LEADS for variable in WEATHER_VARIABLES]


def long_heads(samples: DataFrame, keep: list[str], model_of: dict[tuple[str, str], Column]) -> DataFrame:
    """One row per sample and head: ``lead, variable, y_true, y_baseline, y_model``.

    Model output and baseline are clipped to the range of the variable.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(lead).alias("lead"),
                F.lit(variable).alias("variable"),
                F.col(WEATHER_HEADS[lead, variable].target).cast("double").alias("y_true"),
                F.col(WEATHER_HEADS[lead, variable].baseline).cast("double").alias("y_baseline"),
                model_of[(lead, variable)].cast("double").alias("y_model"),
            )
            for lead, variable in HEADS
            if (lead, variable) in model_of
        ]
    )
    rows = samples.select(*keep, F.explode(entries).alias("h")).select(*keep, "h.*")
    return rows.withColumns(
        {
            "y_baseline": clip_by_name(F.col("variable"), F.col("y_baseline")),
            "y_model": clip_by_name(F.col("variable"), F.col("y_model")),
        }
    )


def blend_and_decide(heads: DataFrame, by: list[str] = HEAD_COLUMNS, **bucketing: int) -> DataFrame:
    """Blend with persistence and pick rain thresholds, both on validation rows.

    The head rows are written once: the searches and the result all read them.
    Adds ``blend_weight``, ``y_pred``, ``threshold`` (rain only) and
    ``y_pred_binary`` (rain only) to the validation and test rows.
    """
    judged = materialize(heads.where(F.col("split").isin(VALIDATION, TEST)))
    weights = search_blend_weight(judged.where(F.col("split") == VALIDATION), by)
    weighted = attach_small(judged, weights, by, ["blend_weight"])
    blended = weighted.withColumn(
        "y_pred", blend(F.coalesce(F.col("blend_weight"), F.lit(1.0)), F.col("y_model"), F.col("y_baseline"), F.col("variable"))
    )
    rain_rows = blended.where((F.col("split") == VALIDATION) & (F.col("variable") == RAIN))
    thresholds = search_rain_threshold(rain_rows, "y_true", "y_pred", by, **bucketing)
    decided = attach_small(blended, thresholds, by, ["threshold"])
    return decided.withColumn(
        "y_pred_binary", F.when(F.col("variable") == RAIN, (F.col("y_pred") >= F.col("threshold")).cast("int"))
    )


def evaluate_heads(decided: DataFrame, by: list[str] = HEAD_COLUMNS, **bucketing: int) -> DataFrame:
    return evaluate_targets(decided.where(F.col("split") == TEST), by, **bucketing)


def wide_predictions(decided: DataFrame, keep: list[str]) -> DataFrame:
    """One row per sample: ``{head}_true``, ``{head}_pred`` and ``{head}_score`` for rain."""
    columns: list[Column] = []
    for lead, variable in HEADS:
        here = (F.col("lead") == lead) & (F.col("variable") == variable)
        name = f"{lead}_{variable}"
        columns.append(F.max(F.when(here, F.col("y_true"))).alias(f"{name}_true"))
        if variable == RAIN:
            columns.append(F.max(F.when(here, F.col("y_pred"))).alias(f"{name}_score"))
            columns.append(F.max(F.when(here, F.col("y_pred_binary"))).alias(f"{name}_pred"))
        else:
            columns.append(F.max(F.when(here, F.col("y_pred"))).alias(f"{name}_pred"))
    return decided.where(F.col("split") == TEST).groupBy(*keep).agg(*columns)


MODELS = ("catboost_hybrid", "lightgbm_hybrid")
NOT_BUILT = ("chronos2",)


def _head_column(lead: str, variable: str) -> str:
    return f"_model_{lead}_{variable}"


def fit_heads(
    samples: DataFrame, features: list[str], model: str, trials: int = 0, params: dict[str, Any] | None = None
) -> tuple[DataFrame, dict[str, Any]]:
    """Fit the twelve heads of one model; adds one output column per head.

    ``samples`` carries ``split``. Features are filled with training medians
    shared by all heads. A rain head with one class in training becomes that
    constant probability.
    """
    filled = apply_medians(samples, fit_medians(samples.where(F.col("split") == TRAIN), features), features)
    rows = materialize(with_vector(filled, features).drop(*features))
    train, held = rows.where(F.col("split") == TRAIN), rows.where(F.col("split") == VALIDATION)
    present = {r["split"] for r in rows.select("split").distinct().collect()}
    if not {TRAIN, VALIDATION, TEST} <= present:
        raise ValueError("Train, validation and test samples must be non-empty.")
    scored, used = rows, {}
    for lead, variable in HEADS:
        target, output = WEATHER_HEADS[lead, variable].target, _head_column(lead, variable)
        is_rain = variable == RAIN
        if is_rain:
            balance = class_balance(train, target).collect()[0]
            if balance["single_class"]:
                scored = scored.withColumn(output, F.lit(balance["constant_probability"]))
                used[f"{lead}_{variable}"] = {"constant_probability": balance["constant_probability"]}
                continue
        best = tune_head(model, train, held, target, is_rain, trials, params)
        if is_rain:
            scored = add_score(fit_classifier(model, train, target, best, held), scored, output)
        else:
            scored = add_value(fit_regressor(model, train, target, best, held), scored, output)
        used[f"{lead}_{variable}"] = best
    return scored.drop("features"), used


def weather_benchmark(
    df: DataFrame,
    panel: Panel,
    models: Iterable[str] = MODELS,
    windows: Iterable[int] = (7, 11),
    n_validation: int = 6,
    n_test: int = 6,
    trials: int = 0,
    params: dict[str, Any] | None = None,
    split_by: str = "year",
) -> dict[str, DataFrame]:
    """Run models x windows. A failing model is recorded with its error.

    Returns ``summary`` (leaderboard), ``metrics`` (one row per head),
    ``predictions`` (long over heads) and ``split``.
    """
    reject_forbidden_inputs(WEATHER_VARIABLES)
    models = model_list(list(models), (*MODELS, *NOT_BUILT))
    spark = df.sparkSession
    cuts = split_cuts(df, n_validation, n_test, split_by, fallback=True)
    tagged = materialize(
        with_split(check_panel(df, panel).select(*panel.columns, *WEATHER_VARIABLES), cuts, split_by)
    )
    decided, notes = [], []
    for window in sorted({int(w) for w in windows}):
        samples, features = weather_windows(tagged, window, panel)
        reject_forbidden_inputs(features)
        samples = materialize(with_split(samples, cuts, split_by))
        for model in models:
            start = time.time()
            error = used = None
            try:
                if model in NOT_BUILT:
                    raise NotImplementedError("pretrained forecasters are not built; see attach_forecasts")
                scored, used = fit_heads(samples, features, model, trials, params)
                named = scored.withColumn("model", F.lit(model))
                keep = ["sample_id", *panel.columns, "split", "model", "window_size"]
                heads = long_heads(named, keep, {h: F.col(_head_column(*h)) for h in HEADS})
                decided.append(materialize(blend_and_decide(heads)))
            except Exception as exc:  # the benchmark goes on; the reason stays in the table
                error = f"{type(exc).__name__}: {exc}"
            notes.append((model, window, round(time.time() - start, 3), error, json.dumps(used)))
    listed = spark.createDataFrame(notes, "model string, window_size int, seconds double, error string, params string")
    split = split_table(df, cuts, split_by)
    if not decided:
        return {"summary": listed, "split": split}
    predictions = union_tables(decided)
    metrics = materialize(evaluate_heads(predictions))
    summary = listed.join(run_summary(metrics), ["model", "window_size"], "left")
    return {
        "summary": weather_leaderboard(summary),
        "metrics": metrics,
        "predictions": predictions.where(F.col("split") == TEST),
        "split": split,
    }
