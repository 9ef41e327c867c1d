"""The disease experiment grid and the smaller pipeline, as driver loops over jobs.

Features are prepared once per horizon and variant and written; models and
windows reuse them. The scores of all runs go into one long table, so
thresholds and metrics of the whole grid come out of a fixed number of jobs.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldseries.functions.rules import DAY_SCORES, at_least, invert_predictions, signal_mean_score
from fieldseries.operators.features import simple_features
from fieldseries.operators.forecast import SEASONAL_PERIOD, ar_candidates, ar_forecast
from fieldseries.operators.impute import fill_own_medians
from fieldseries.operators.learners import (
    BOOSTERS,
    CLASSIFIERS,
    add_score,
    model_list,
    fit_classifier,
    fit_predict,
    tune_classifier,
    with_vector,
)
from fieldseries.operators.lookup import small_rows
from fieldseries.operators.materialize import materialize
from fieldseries.operators.metrics import binary_metrics, classification_report, confusion
from fieldseries.operators.ranking import top_runs, top_runs_by_f1
from fieldseries.operators.split import TEST, TRAIN, VALIDATION, split_cuts, split_table, with_split
from fieldseries.operators.thresholds import search_threshold
from fieldseries.operators.tomek import remove_tomek_links
from fieldseries.operators.windows import horizon_labels, look_back
from fieldseries.panel import Panel, check_panel
from fieldseries.sources.ledger import Ledger, run_key
from fieldseries.plans.disease import Prepared, decide, evaluate_runs, prepare_features, rule_scores
from fieldseries.schema import FEATURE_VARIANTS, MIN_PRECISION
from fieldseries.sources.readers import union_tables

NOT_BUILT = ("gru", "tft")
MODELS = ("logreg", "svm", "rf", *NOT_BUILT, *DAY_SCORES, *BOOSTERS, "arima", "sarima")
RUN_COLUMNS = "run_id string, run_seq int, model string, variant string, horizon int, window_size int, n_features int, n_removed long, best_params string, seconds double, error string"


def _tabular_rows(prepared: Prepared, panel: Panel, window: int) -> DataFrame:
    """Look-back vectors with a row id, written once per window."""
    rows = look_back(prepared.rows, prepared.features, window, panel)
    kept = rows.select(*panel.columns, "split", prepared.target, "look_back")
    return materialize(kept.withColumn("_row", F.monotonically_increasing_id()))


def _undersampled(rows: DataFrame, target: str) -> tuple[DataFrame, int]:
    """Training rows without majority members of links; other splits untouched."""
    train = rows.where(F.col("split") == TRAIN)
    kept = materialize(remove_tomek_links(train, "look_back", target, "_row").select(*rows.columns))
    return kept, train.count() - kept.count()


def _score_columns(scored: DataFrame, panel: Panel, target: str, run_id: str) -> DataFrame:
    return scored.where(F.col("split") != TRAIN).select(
        F.lit(run_id).alias("run_id"), *panel.columns, "split", F.col(target).cast("int").alias("y_true"), "y_score"
    )


def _best_ar_scores(
    rows: DataFrame, panel: Panel, target: str, window: int, seasonal: bool, split_by: str, min_precision: float
) -> tuple[DataFrame, dict[str, Any]]:
    """Scores of the AR order with the best validation objective; the first wins ties."""
    series = [k for k in panel.keys if k != split_by]
    order_by = [split_by, panel.order]
    period = SEASONAL_PERIOD if seasonal else None
    if not series:
        rows, series = rows.withColumn("_all", F.lit(0)), ["_all"]
    tried = [
        ar_forecast(rows, series, order_by, target, order, period).withColumn("ar_order", F.lit(order))
        for order in ar_candidates(window)
    ]
    scored = materialize(union_tables(tried))
    found = small_rows(search_threshold(scored.where(F.col("split") == VALIDATION), by=["ar_order"], min_precision=min_precision))
    rank = {order: i for i, order in enumerate(ar_candidates(window))}
    best = max(found, key=lambda r: (r["objective"], -rank[r["ar_order"]]))["ar_order"]
    chosen = scored.where(F.col("ar_order") == best).withColumnRenamed("y_true", target)
    return chosen, {"ar_order": best, "seasonal_period": period}


def disease_benchmark(
    df: DataFrame,
    panel: Panel,
    models: Iterable[str] = ("logreg",),
    horizons: Iterable[int] = (2,),
    windows: Iterable[int] = (7,),
    variants: Iterable[str] = tuple(FEATURE_VARIANTS),
    top_n: int = 1,
    trials: int = 0,
    min_precision: float = MIN_PRECISION,
    no_y: bool = False,
    invert: bool = False,
    oracle: bool = False,
    oracle_features: Iterable[str] | None = None,
    n_validation: int = 6,
    n_test: int = 6,
    fallback: bool = False,
    split_by: str = "year",
    params: dict[str, dict[str, Any]] | None = None,
    ledger: str | None = None,
) -> dict[str, DataFrame]:
    """Run models x horizons x windows x variants on a cleaned panel.

    ``params`` overrides model parameters by model name. With ``ledger`` (a folder) each
    finished run is appended there under the hash of its parameters and input files, and
    a grid started again takes finished runs from it and computes only the rest. Returns the tables
    ``runs`` (one row per run, failed ones with their error), ``best`` (top runs
    per model), ``predictions``, ``report``, ``thresholds`` and ``split``.
    """
    if not 0.0 <= min_precision <= 1.0:
        raise ValueError("min_precision must be between 0 and 1.")
    models = model_list(list(models), MODELS)
    horizons, windows, variants = list(horizons), list(windows), list(variants)
    params = params or {}
    cuts = split_cuts(df, n_validation, n_test, split_by, fallback)
    tagged = materialize(horizon_labels(with_split(check_panel(df, panel), cuts, split_by), horizons, panel))
    runs: list[dict[str, Any]] = []
    scores: list[DataFrame] = []
    book = Ledger(df.sparkSession, ledger) if ledger else None
    inputs = sorted(df.inputFiles()) if ledger else []
    fixed = dict(
        oracle=oracle, oracle_features=sorted(oracle_features or []), no_y=no_y, trials=trials, min_precision=min_precision,
        n_validation=n_validation, n_test=n_test, fallback=fallback, split_by=split_by, inputs=inputs,
    )

    def record(model: str, variant: str, horizon: int, window: int, n_features: int, score) -> None:
        """Score one run; a failing model becomes a row with its error."""
        run_id = f"{model}-{variant}-h{horizon}-w{window}" + ("-oracle" if oracle else "")
        key = run_key(dict(fixed, model=model, variant=variant, horizon=horizon, window=window, params=params.get(model)))
        if book is not None and book.committed(key):
            row = book.row(key).first().asDict()
            row["run_seq"] = len(runs)
            runs.append(row)
            done = book.scores(key)
            if done is not None:
                scores.append(done)
            return
        row = dict(
            run_id=run_id, run_seq=len(runs), model=model, variant=variant, horizon=horizon, window_size=window,
            n_features=n_features, n_removed=0, best_params=None, seconds=0.0, error=None,
        )
        start = time.time()
        scored_rows = None
        try:
            scored, details = score()
            scored_rows = materialize(_score_columns(scored, panel, f"target_h{horizon}", run_id))
            scores.append(scored_rows)
            row["n_removed"] = details.pop("n_removed", 0)
            row["best_params"] = json.dumps(details)
        except Exception as exc:  # the grid goes on; the reason stays in the table
            row["error"] = f"{type(exc).__name__}: {exc}"
        row["seconds"] = round(time.time() - start, 3)
        runs.append(row)
        if book is not None:
            one = df.sparkSession.createDataFrame([tuple(row[c.split()[0]] for c in RUN_COLUMNS.split(", "))], RUN_COLUMNS)
            book.append(key, one, scored_rows)

    def tabular(model: str, rows: DataFrame, train: DataFrame, removed: int, target: str):
        def score():
            vectors = with_vector(rows, "look_back")
            fit_rows = with_vector(train, "look_back")
            held = vectors.where(F.col("split") == VALIDATION)
            best = tune_classifier(model, fit_rows, held, target, trials, min_precision, params.get(model))
            fitted = fit_classifier(model, fit_rows, target, best, held if model in BOOSTERS else None)
            return add_score(fitted, vectors), {"n_removed": removed, **best}

        return score

    def not_built():
        raise NotImplementedError("recurrent and attention networks are not built; see sequence_samples")

    for horizon in horizons:
        target = f"target_h{horizon}"
        for variant in variants:
            ready = prepare_features(tagged, panel, horizon, variant, oracle, oracle_features, no_y)
            prepared = Prepared(materialize(ready.rows), ready.features, target, ready.medians)
            for window in windows:
                fits = [m for m in models if m in CLASSIFIERS]
                rows = train = None
                removed = 0
                if fits:
                    rows = _tabular_rows(prepared, panel, window)
                    train = rows.where(F.col("split") == TRAIN)
                    if FEATURE_VARIANTS[variant][2]:
                        train, removed = _undersampled(rows, target)
                for model in models:
                    width = len(prepared.features) * (window if model in CLASSIFIERS else 1)
                    if model in CLASSIFIERS:
                        score = tabular(model, rows, train, removed, target)
                    elif model in DAY_SCORES:
                        def score(model=model):
                            return rule_scores(prepared, panel, window, [model]).withColumnRenamed("y_true", target), {}
                    elif model in NOT_BUILT:
                        if variant != "baseline":
                            continue
                        score = not_built
                    else:
                        def score(model=model):
                            return _best_ar_scores(
                                prepared.rows, panel, target, window, model == "sarima", split_by, min_precision
                            )
                    record(model, variant, horizon, window, width, score)

    spark = df.sparkSession
    listed = spark.createDataFrame([tuple(r[c.split()[0]] for c in RUN_COLUMNS.split(", ")) for r in runs], RUN_COLUMNS)
    split = split_table(df, cuts, split_by)
    if not scores:
        return {"runs": listed, "split": split}
    thresholds, predictions = decide(union_tables(scores), ["run_id"], min_precision, invert)
    predictions = materialize(predictions)
    table = materialize(
        listed.join(evaluate_runs(thresholds, predictions, ["run_id"], min_precision), "run_id", "left")
    )
    return {
        "runs": table,
        "best": top_runs(table.where(F.col("error").isNull()), top_n, min_precision),
        "predictions": predictions,
        "report": classification_report(confusion(predictions, by=["run_id"]), ["run_id"]),
        "thresholds": thresholds,
        "split": split,
    }


SIMPLE_MODELS = ("logreg", "rf", "blitecast", "sarima")


def simple_benchmark(
    df: DataFrame,
    panel: Panel,
    models: Iterable[str] = ("logreg",),
    horizons: Iterable[int] = (2,),
    windows: Iterable[int] = (7,),
    top_n: int | None = None,
    no_y: bool = False,
    invert: bool = False,
    use_label_signal: bool = False,
    n_validation: int = 7,
    n_test: int = 5,
    fallback: bool = False,
    split_by: str = "year",
    params: dict[str, dict[str, Any]] | None = None,
) -> dict[str, DataFrame]:
    """The smaller pipeline: short-history features, medians per split, ranking by F1.

    Returns ``runs`` and ``predictions``.
    """
    models = model_list(list(models), SIMPLE_MODELS)
    params = {"rf": {"n_trees": 200, "class_weight": "balanced"}, **(params or {})}
    tagged = with_split(df, split_cuts(df, n_validation, n_test, split_by, fallback), split_by)
    built, features = simple_features(horizon_labels(tagged, horizons, panel), windows, panel, no_y)
    built = materialize(built)
    outputs, thresholds = [], []
    for seq, (horizon, model) in enumerate((h, m) for h in horizons for m in models):
        target = f"target_h{horizon}"
        known = built.where(F.col(target).isNotNull())
        if model in ("logreg", "rf"):
            parts = {
                s: with_vector(
                    fill_own_medians(known.where(F.col("split") == s), features, target), features
                ).withColumn(target, F.col(target).cast("int"))
                for s in (TRAIN, VALIDATION, TEST)
            }
            scored, choice = fit_predict(model, parts[TRAIN], parts[TEST], target, parts[VALIDATION], params.get(model))
        elif model == "blitecast":
            scored = signal_mean_score(known.where(F.col("split") == TEST), use_label_signal)
            scored, choice = scored.withColumn("y_pred_binary", at_least(F.col("y_score"), 0.5)), {"threshold": 0.5}
        else:
            series = [k for k in panel.keys if k != split_by]
            rows = known if series else known.withColumn("_all", F.lit(0))
            # training rows forecast the test rows directly; validation rows are skipped
            rows = rows.where(F.col("split") != VALIDATION)
            ahead = ar_forecast(rows, series or ["_all"], [split_by, panel.order], target, 1, SEASONAL_PERIOD)
            scored = ahead.withColumnRenamed("y_true", target).withColumn("y_pred_binary", at_least(F.col("y_score"), 0.5))
            choice = {"threshold": 0.5}
        outputs.append(
            scored.select(
                F.lit(seq).alias("run_seq"), F.lit(model).alias("model"), F.lit(horizon).alias("horizon"),
                *panel.columns, F.col(target).cast("int").alias("y_true"), "y_pred_binary", "y_score",
            )
        )
        thresholds.append((seq, float(choice["threshold"])))
    predictions = union_tables(outputs)
    predictions = materialize(invert_predictions(predictions) if invert else predictions)
    by = ["run_seq", "model", "horizon"]
    metrics = binary_metrics(confusion(predictions, by=by), by)
    chosen = df.sparkSession.createDataFrame(thresholds, "run_seq int, threshold double")
    return {"runs": top_runs_by_f1(metrics.join(chosen, "run_seq"), top_n), "predictions": predictions}
