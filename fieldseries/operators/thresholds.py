"""Choosing a decision threshold or blend weight on a validation split.

Candidates are laid on the same axis as the scores, as values of zero weight,
and read their counts off the cumulative sums. No score is compared with every
candidate, and the number of candidates need not be small.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseries.functions.rules import clip_by_name, range_by_name, sanitize_score, threshold_objective
from fieldseries.operators.materialize import materialize
from fieldseries.operators.metrics import f1_of, precision_of, recall_of
from fieldseries.operators.ranked import quantiles_of_cells, ranked_cells, ungroup, value_cells
from fieldseries.schema import MAX_SCORE_CANDIDATES, MIN_PRECISION, RAIN


def rounded_half_even(value: Column, places: int) -> Column:
    scale = F.lit(float(10**places))
    return F.rint(value * scale) / scale


def _score_cells(df: DataFrame, truth: str, score: str, by: list[str]) -> DataFrame:
    known = df.where(F.col(truth).isNotNull()).withColumn("_s", sanitize_score(F.col(score)))
    return value_cells(known, "_s", {"pos": F.col(truth).cast("int"), "n": F.lit(1)}, by)


def _metrics_at(cells: DataFrame, candidates: DataFrame, **bucketing: int) -> DataFrame:
    """tp-based metrics of ``score >= _v`` for each row ``(_g, _v)`` of ``candidates``."""
    zero = F.lit(0).cast("long")
    marked = candidates.select("_g", "_v", zero.alias("pos"), zero.alias("n"), F.lit(True).alias("cand"))
    axis = (
        cells.select("_g", "_v", "pos", "n", F.lit(False).alias("cand"))
        .unionByName(marked)
        .groupBy("_g", "_v")
        .agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.max("cand").alias("cand"))
    )
    ranked = ranked_cells(axis, ["pos", "n"], **bucketing).where("cand")
    tp = F.col("pos_total") - F.col("pos_before")
    fp = (F.col("n_total") - F.col("n_before")) - tp
    fn = F.col("pos_before")
    return ranked.select(
        "_g",
        F.col("_v").alias("threshold"),
        precision_of(tp, fp).alias("precision"),
        recall_of(tp, fn).alias("recall"),
        f1_of(tp, fp, fn).alias("f1"),
    )


def score_candidates(cells: DataFrame, max_candidates: int | None = MAX_SCORE_CANDIDATES, **bucketing: int) -> DataFrame:
    """Distinct scores rounded to 10 places, or that many even quantiles if they are more than ``max_candidates``; and 0.5.

    With None all distinct scores are candidates.

    ``cells`` is read several times and should be a written table.
    """
    rounded = cells.select("_g", rounded_half_even(F.col("_v"), 10).alias("_v")).distinct()
    if max_candidates is None:
        return rounded.unionByName(cells.select("_g").distinct().select("_g", F.lit(0.5).alias("_v"))).distinct()
    most = max_candidates
    sizes = materialize(rounded.groupBy("_g").agg(F.count(F.lit(1)).alias("k")))
    few = sizes.where(F.col("k") <= most).select("_g")
    many = sizes.where(F.col("k") > most).select("_g")
    found = rounded.join(few, "_g", "left_semi").unionByName(sizes.select("_g", F.lit(0.5).alias("_v")))
    if not many.isEmpty():
        quantiles = quantiles_of_cells(cells.join(many, "_g", "left_semi"), most, **bucketing)
        found = found.unionByName(quantiles.select("_g", F.col("quantile").alias("_v")))
    return found.distinct()


def search_threshold(
    df: DataFrame,
    truth: str = "y_true",
    score: str = "y_score",
    by: Iterable[str] = (),
    min_precision: float = MIN_PRECISION,
    on_empty: str = "default",
    max_candidates: int | None = MAX_SCORE_CANDIDATES,
    **bucketing: int,
) -> DataFrame:
    """Best threshold per group: ``threshold, precision, recall, f1, objective``.

    If any candidate reaches ``min_precision``, those compete on recall, then
    precision, F1 and the lowest threshold; otherwise precision comes before
    recall. ``max_candidates`` is the rule of :func:`score_candidates`. Without rows and groups the answer is 0.5, or an error when
    ``on_empty="raise"``.
    """
    by = list(by)
    cells = materialize(_score_cells(df, truth, score, by))
    rated = _metrics_at(cells, score_candidates(cells, max_candidates, **bucketing), **bucketing)
    floor_met = F.col("precision") >= min_precision
    order = F.struct(
        floor_met.alias("ok"),
        F.when(floor_met, F.col("recall")).otherwise(F.col("precision")).alias("a"),
        F.when(floor_met, F.col("precision")).otherwise(F.col("recall")).alias("b"),
        F.col("f1").alias("c"),
        (-F.col("threshold")).alias("d"),
    )
    best = rated.groupBy("_g").agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"), order).alias("w"))
    objective = threshold_objective(F.col("w.recall"), F.col("w.precision"), F.col("w.f1"), min_precision)
    found = ungroup(best, by, "w.*", objective.alias("objective"))
    return found if by else _with_empty_answer(found, on_empty)


def _with_empty_answer(found: DataFrame, on_empty: str) -> DataFrame:
    """Exactly one row also for an empty input."""
    names = ["threshold", "precision", "recall", "f1", "objective"]
    one = found.agg(*[F.max(n).alias(n) for n in names])
    if on_empty == "raise":
        message = F.raise_error(F.lit("no validation rows to choose a threshold on")).cast("double")
        return one.withColumn("threshold", F.coalesce(F.col("threshold"), message))
    default = {n: F.lit(0.5 if n == "threshold" else 0.0) for n in names}
    return one.select(*[F.coalesce(F.col(n), default[n]).alias(n) for n in names])


def search_rain_threshold(
    df: DataFrame, truth: str = "y_true", score: str = "y_score", by: Iterable[str] = (), **bucketing: int
) -> DataFrame:
    """Threshold with the best (F1, precision, recall); the lowest one wins ties.

    Candidates: 0.05, 0.10 .. 0.95 and all scores rounded to 8 places.
    """
    by = list(by)
    cells = materialize(_score_cells(df, truth, score, by))
    step = (0.95 - 0.05) / 18
    grid = F.array(*[F.lit(0.95 if i == 18 else i * step + 0.05) for i in range(19)])
    fixed = cells.select("_g").distinct().select("_g", F.explode(grid).alias("_v"))
    rounded = cells.select("_g", rounded_half_even(F.col("_v"), 8).alias("_v"))
    rated = _metrics_at(cells, fixed.unionByName(rounded).distinct(), **bucketing)
    order = F.struct("f1", "precision", "recall", (-F.col("threshold")).alias("t"))
    best = rated.groupBy("_g").agg(F.max_by(F.struct("threshold", "f1", "precision", "recall"), order).alias("w"))
    return ungroup(best, by, "w.*")


BLEND_STEPS = 21


def search_blend_weight(
    df: DataFrame,
    by: Iterable[str],
    truth: str = "y_true",
    model: str = "y_model",
    baseline: str = "y_baseline",
    variable: str = "variable",
) -> DataFrame:
    """Weight w of ``w*model + (1-w)*baseline`` with the least loss, per group.

    21 even weights, loss Brier for rain and MAE otherwise, after clipping to
    the range of the variable; the lowest weight wins ties. All weights are
    averaged in one pass over the rows, so no row is copied. Rows with a null
    are left out and counted.
    """
    by = list(by)
    low, high = range_by_name(F.col(variable))
    known = df.select(
        *by,
        F.col(truth).cast("double").alias("_y"),
        F.col(model).cast("double").alias("_m"),
        F.col(baseline).cast("double").alias("_b"),
        low.alias("_low"),
        high.alias("_high"),
        F.when(F.col(variable) == RAIN, 2.0).otherwise(1.0).alias("_power"),
    )
    complete = F.col("_y").isNotNull() & F.col("_m").isNotNull() & F.col("_b").isNotNull()
    weights = [i * (1.0 / (BLEND_STEPS - 1)) for i in range(BLEND_STEPS - 1)] + [1.0]

    def loss(w: float) -> Column:
        mixed = F.lit(w) * F.col("_m") + F.lit(1.0 - w) * F.col("_b")
        clipped = F.least(F.greatest(mixed, F.col("_low")), F.col("_high"))
        return F.pow(F.abs(clipped - F.col("_y")), F.col("_power"))

    sums = known.groupBy(*by).agg(
        *[F.avg(F.when(complete, loss(w))).alias(f"loss_{i}") for i, w in enumerate(weights)],
        F.count(F.when(complete, 1)).alias("n_pairs"),
        F.count(F.when(~complete, 1)).alias("n_skipped"),
    )
    # Losses that differ by summation order only are ties.
    ranked = F.array(
        *[F.struct(F.round(F.col(f"loss_{i}"), 12).alias("loss"), F.lit(w).alias("w")) for i, w in enumerate(weights)]
    )
    best = F.array_min(F.filter(ranked, lambda s: s["loss"].isNotNull()))
    return sums.select(
        *by,
        F.coalesce(best["w"], F.lit(1.0)).alias("blend_weight"),
        best["loss"].alias("blend_loss"),
        "n_pairs",
        "n_skipped",
    )


def blend(weight: Column, model: Column, baseline: Column, variable: Column) -> Column:
    return clip_by_name(variable, weight * model + (1.0 - weight) * baseline)
