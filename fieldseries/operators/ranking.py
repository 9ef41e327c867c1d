"""Ranking runs and features. Run tables are small, one row per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldseries.schema import MIN_PRECISION


def rank_key(min_precision: Column | float = MIN_PRECISION) -> list[Column]:
    """Precision floor met, recall, PR-AUC, F1, ROC-AUC; null counts as -1."""
    floor = min_precision if isinstance(min_precision, Column) else F.lit(min_precision)

    def known(name: str) -> Column:
        return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(-1.0)), F.lit(-1.0))

    met = (known("precision") >= floor).cast("int").alias("precision_floor_met")
    return [met, *[known(c).alias(f"rank_{c}") for c in ("recall", "pr_auc", "f1", "roc_auc")]]


def rank_runs(runs: DataFrame, min_precision: Column | float = MIN_PRECISION, sequence: str = "run_seq") -> DataFrame:
    """Add the rank key and ``model_rank``, 1 = best; ties keep the run order."""
    keyed = runs.drop("precision_floor_met").select("*", *rank_key(min_precision))
    order = [F.col(c).desc() for c in ("precision_floor_met", "rank_recall", "rank_pr_auc", "rank_f1", "rank_roc_auc")]
    return keyed.withColumn(
        "model_rank", F.row_number().over(Window.partitionBy("model").orderBy(*order, F.col(sequence)))
    )


def top_runs(
    runs: DataFrame, top_n: int, min_precision: Column | float = MIN_PRECISION, sequence: str = "run_seq"
) -> DataFrame:
    """Best ``top_n`` runs of each model; a count of 0 or less keeps all."""
    ranked = rank_runs(runs, min_precision, sequence)
    return ranked.where(F.col("model_rank") <= top_n) if top_n > 0 else ranked


def top_runs_by_f1(runs: DataFrame, top_n: int | None, sequence: str = "run_seq") -> DataFrame:
    """Best runs of each model by F1; ``None`` keeps all, 0 or less keeps none."""
    by_f1 = Window.partitionBy("model").orderBy(F.col("f1").desc(), F.col(sequence))
    ranked = runs.withColumn("model_rank", F.row_number().over(by_f1))
    return ranked if top_n is None else ranked.where(F.col("model_rank") <= max(int(top_n), 0))


def weather_leaderboard(summary: DataFrame) -> DataFrame:
    """Runs by weather score, then model and window; runs without a score last."""
    return summary.orderBy(F.asc_nulls_last("weather_score_lower_is_better"), "model", "window_size")


def top_importances(df: DataFrame, importances: str, names: list[str], limit: int = 20) -> DataFrame:
    """The ``limit`` largest of an importance array, with feature names.

    Empty when the two lengths differ.
    """
    labels = F.array(*[F.lit(n) for n in names])
    pairs = F.arrays_zip(labels.alias("feature"), F.col(importances).alias("importance"))
    return (
        df.where(F.size(importances) == len(names))
        .select(F.explode(pairs).alias("p"))
        .select(F.col("p.feature").alias("feature"), F.col("p.importance").alias("importance"))
        .orderBy(F.col("importance").desc(), F.col("feature"))
        .limit(limit)
    )
