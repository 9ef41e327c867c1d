"""The disease workload: will day t+h be favourable?"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldseries.functions.rules import DAY_SCORES, at_least, invert_predictions
from fieldseries.operators.features import (
    finalize_rows,
    oracle_safe,
    observed_weather,
    variant_feature_names,
    variant_features,
)
from fieldseries.operators.impute import impute_panel
from fieldseries.operators.lookup import attach_small
from fieldseries.operators.materialize import materialize
from fieldseries.operators.metrics import binary_metrics, confusion, ranking_metrics
from fieldseries.operators.split import TEST, VALIDATION, split_cuts, with_split
from fieldseries.operators.thresholds import search_threshold
from fieldseries.operators.windows import horizon_labels, oracle_window, rolling
from fieldseries.panel import Panel
from fieldseries.schema import MIN_PRECISION


@dataclass(frozen=True)
class Prepared:
    """Finalised rows of all splits, the feature names and the fitted medians."""

    rows: DataFrame
    features: list[str]
    target: str
    medians: DataFrame


def prepare_features(
    df: DataFrame,
    panel: Panel,
    horizon: int,
    variant: str = "baseline",
    oracle: bool = False,
    oracle_features: Iterable[str] | None = None,
    no_y: bool = False,
    split: str = "split",
) -> Prepared:
    """Impute, add the features of the variant, finalise; all splits at once.

    ``df`` carries ``target_h{horizon}`` and a ``split`` column. A series lies in
    one split and every window stays in its series, so the splits are prepared
    by the same plan: one shuffle on the panel keys.
    """
    target = f"target_h{horizon}"
    filled, medians = impute_panel(df, panel, split=split)
    names = variant_feature_names(variant, no_y)
    if oracle:
        names = oracle_safe(names)
    work, _ = variant_features(filled, variant, panel, no_y)
    if oracle:
        wanted = observed_weather(df.columns, oracle_features)
        work, future = oracle_window(work, horizon, wanted, panel)
        names = list(dict.fromkeys(names + future))
    return Prepared(finalize_rows(work, names, target, panel, carry=[split]), names, target, medians)


def rule_scores(prepared: Prepared, panel: Panel, window: int, models: Iterable[str] = tuple(DAY_SCORES)) -> DataFrame:
    """Long table ``(keys, split, model, y_true, y_score)`` of the rule models.

    All rules read the same window, so they are scored in one pass.
    """
    models = list(models)
    daily = prepared.rows.select(
        *panel.columns, "split", prepared.target, *[DAY_SCORES[m]().alias(f"_{m}") for m in models]
    )
    summed = {m: rolling(f"_{m}", window, "sum", panel, min_rows=window) for m in models}
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), c.alias("y_score")) for m, c in summed.items()])
    return (
        daily.withColumn("_scores", pairs)
        .select(*panel.columns, "split", F.col(prepared.target).alias("y_true"), F.explode("_scores").alias("s"))
        .select(*panel.columns, "split", "y_true", "s.model", "s.y_score")
        .where(F.col("y_score").isNotNull())
    )


def decide(
    scored: DataFrame, by: list[str], min_precision: float = MIN_PRECISION, invert: bool = False, **bucketing: int
) -> tuple[DataFrame, DataFrame]:
    """Thresholds from the validation rows and test rows with a decision.

    ``scored`` is long over runs: every run named by ``by`` is searched, applied
    and later evaluated in the same jobs.
    """
    scored = materialize(scored.where(F.col("split").isin(VALIDATION, TEST)))
    thresholds = materialize(
        search_threshold(scored.where(F.col("split") == VALIDATION), by=by, min_precision=min_precision, **bucketing)
    )
    test = attach_small(scored.where(F.col("split") == TEST), thresholds, by, ["threshold"])
    decided = test.withColumn("y_pred_binary", at_least(F.col("y_score"), F.coalesce(F.col("threshold"), F.lit(0.5))))
    return thresholds, (invert_predictions(decided) if invert else decided)


def evaluate_runs(
    thresholds: DataFrame, decided: DataFrame, by: list[str], min_precision: float = MIN_PRECISION, **bucketing: int
) -> DataFrame:
    """One row per run: validation choice, test metrics and the rank key."""
    test = binary_metrics(confusion(decided, by=by), by).join(ranking_metrics(decided, by=by, **bucketing), by)
    chosen = thresholds.select(
        *by,
        "threshold",
        F.col("objective").alias("threshold_objective"),
        F.col("precision").alias("val_precision"),
        F.col("recall").alias("val_recall"),
        F.col("f1").alias("val_f1"),
    )
    runs = test.join(chosen, by, "left").withColumn("min_precision", F.lit(float(min_precision)))
    return runs.withColumn("precision_floor_met", F.coalesce(F.col("precision") >= min_precision, F.lit(False)))


def rule_benchmark(
    df: DataFrame,
    panel: Panel,
    horizon: int = 2,
    window: int = 7,
    variant: str = "temporal_fe",
    split_by: str = "year",
    fallback: bool = True,
    min_precision: float = MIN_PRECISION,
) -> DataFrame:
    """From a cleaned panel to the test metrics of both rule models.

    The panel is written once: cuts, medians and rows are read from it, not from the
    facts that it is made of.
    """
    df = materialize(df)
    tagged = with_split(df, split_cuts(df, by=split_by, fallback=fallback), split_by)
    prepared = prepare_features(horizon_labels(tagged, [horizon], panel), panel, horizon, variant)
    scored = rule_scores(prepared, panel, window)
    thresholds, decided = decide(scored, ["model"], min_precision)
    return evaluate_runs(thresholds, decided, ["model"], min_precision)
