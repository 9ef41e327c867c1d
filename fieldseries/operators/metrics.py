"""Exact binary and regression metrics, each grouped by any columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseries.functions.rules import clip_by_name
from fieldseries.operators.ranked import ranked_cells, ungroup, value_cells
from fieldseries.schema import RAIN


def _zero_safe(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)))


def confusion(df: DataFrame, truth: str = "y_true", pred: str = "y_pred_binary", by: Iterable[str] = ()) -> DataFrame:
    """tp, fp, fn, tn in one pass."""
    y, p = F.col(truth) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(
        _count(y & p).alias("tp"), _count(~y & p).alias("fp"), _count(y & ~p).alias("fn"), _count(~y & ~p).alias("tn")
    )


def precision_of(tp: Column, fp: Column) -> Column:
    return _zero_safe(tp, tp + fp)


def recall_of(tp: Column, fn: Column) -> Column:
    return _zero_safe(tp, tp + fn)


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return _zero_safe(2 * tp, 2 * tp + fp + fn)


def binary_metrics(counts: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Precision, recall, F1 and accuracy from confusion counts; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by,
        precision_of(tp, fp).alias("precision"),
        recall_of(tp, fn).alias("recall"),
        f1_of(tp, fp, fn).alias("f1"),
        _zero_safe(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def classification_report(counts: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Rows for both classes, accuracy, macro and weighted averages.

    As in the usual report the accuracy row repeats one value in all columns.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = (precision_of(tn, fn), recall_of(tn, fp), f1_of(tn, fn, fp), (tn + fp).cast("double"))
    one = (precision_of(tp, fp), recall_of(tp, fn), f1_of(tp, fp, fn), (tp + fn).cast("double"))
    total = zero[3] + one[3]
    accuracy = _zero_safe(tp + tn, tp + fp + fn + tn)
    rows = [
        ("0", zero),
        ("1", one),
        ("accuracy", (accuracy, accuracy, accuracy, accuracy)),
        ("macro avg", (*[(zero[i] + one[i]) / 2 for i in range(3)], total)),
        ("weighted avg", (*[_zero_safe(zero[i] * zero[3] + one[i] * one[3], total) for i in range(3)], total)),
    ]
    names = ("precision", "recall", "f1_score", "support")
    entries = F.array(
        *[
            F.struct(F.lit(label).alias("class"), *[value.alias(n) for n, value in zip(names, values)])
            for label, values in rows
        ]
    )
    return counts.select(*by, F.explode(entries).alias("r")).select(*by, "r.*")


def score_curve(
    df: DataFrame, truth: str = "y_true", score: str = "y_score", by: Iterable[str] = (), **bucketing: int
) -> DataFrame:
    """Per distinct score: tp and fp when everything at or above it is positive.

    Keeps the packed group ``_g``. Columns: ``_v, pos, n, tp, fp, pos_total,
    neg_total`` and ``neg_above``, the negatives strictly above the score.
    """
    cells = value_cells(df.where(F.col(truth).isNotNull()), score, {"pos": F.col(truth).cast("int"), "n": F.lit(1)}, by)
    ranked = ranked_cells(cells, ["pos", "n"], **bucketing)
    tp = F.col("pos_total") - F.col("pos_before")
    predicted = F.col("n_total") - F.col("n_before")
    neg = F.col("n") - F.col("pos")
    return ranked.select(
        "_g",
        "_v",
        "pos",
        "n",
        tp.alias("tp"),
        (predicted - tp).alias("fp"),
        "pos_total",
        (F.col("n_total") - F.col("pos_total")).alias("neg_total"),
        (predicted - tp - neg).alias("neg_above"),
    )


def ranking_metrics(
    df: DataFrame, truth: str = "y_true", score: str = "y_score", by: Iterable[str] = (), **bucketing: int
) -> DataFrame:
    """``roc_auc`` and ``pr_auc`` (average precision, a step sum) per group.

    Null when a group has one class only. Ties count one half for ROC.
    """
    curve = score_curve(df, truth, score, by, **bucketing)
    neg = F.col("n") - F.col("pos")
    neg_below = F.col("neg_total") - F.col("neg_above") - neg
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    sums = curve.groupBy("_g").agg(
        # twice the Mann-Whitney statistic keeps the sum an exact integer
        F.sum((F.col("pos") * (2 * neg_below + neg)).cast("decimal(38,0)")).alias("u2"),
        F.sum(F.col("pos") * precision).alias("ap"),
        F.max("pos_total").alias("p"),
        F.max("neg_total").alias("q"),
    )
    two_classes = (F.col("p") > 0) & (F.col("q") > 0)
    pairs = F.col("p").cast("double") * F.col("q").cast("double")
    return ungroup(
        sums,
        by,
        F.when(two_classes, F.col("u2").cast("double") / (2.0 * pairs)).alias("roc_auc"),
        F.when(two_classes, F.col("ap") / F.col("p")).alias("pr_auc"),
    )


def roc_points(
    df: DataFrame, truth: str = "y_true", score: str = "y_score", by: Iterable[str] = (), **bucketing: int
) -> DataFrame:
    """``(threshold, fpr, tpr)`` for every distinct score of two-class groups, and the start (null, 0, 0)."""
    curve = score_curve(df, truth, score, by, **bucketing).where("pos_total > 0 and neg_total > 0")
    points = curve.select(
        "_g",
        F.col("_v").alias("threshold"),
        (F.col("fp") / F.col("neg_total")).alias("fpr"),
        (F.col("tp") / F.col("pos_total")).alias("tpr"),
        (F.col("fp") + F.col("tp") == F.col("neg_total") + F.col("pos_total")).alias("_end"),
    )
    return ungroup(_with_end(points, threshold=None, fpr=0.0, tpr=0.0), by, "threshold", "fpr", "tpr")


def _with_end(points: DataFrame, **values: float | None) -> DataFrame:
    """One more point for each group: its least score, of which there is one, stands for two points."""
    own = F.struct(*values)
    end = F.struct(*[F.lit(v).cast("double").alias(k) for k, v in values.items()])
    doubled = points.withColumn("_p", F.explode(F.when(F.col("_end"), F.array(own, end)).otherwise(F.array(own))))
    return doubled.select("_g", "_p.*")


def pr_points(
    df: DataFrame, truth: str = "y_true", score: str = "y_score", by: Iterable[str] = (), **bucketing: int
) -> DataFrame:
    """``(threshold, precision, recall)`` for every distinct score, and the end (null, 1, 0)."""
    curve = score_curve(df, truth, score, by, **bucketing).where("pos_total > 0 and neg_total > 0")
    points = curve.select(
        "_g",
        F.col("_v").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("pos_total")).alias("recall"),
        (F.col("fp") + F.col("tp") == F.col("neg_total") + F.col("pos_total")).alias("_end"),
    )
    return ungroup(_with_end(points, threshold=None, precision=1.0, recall=0.0), by, "threshold", "precision", "recall")


# -- regression ---------------------------------------------------------------


def smape_term(y: Column, p: Column) -> Column:
    return F.when(
        y.isNotNull() & p.isNotNull(), _zero_safe(2.0 * F.abs(p - y), F.abs(y) + F.abs(p))
    )


def _regression_aggregates(y: Column, p: Column) -> list[Column]:
    both = y.isNotNull() & p.isNotNull()
    y, p = F.when(both, y), F.when(both, p)
    error = p - y
    n = F.count(y)
    # n * var_pop is the total sum of squares, computed without cancellation
    r2 = F.when((n >= 2) & (F.min(y) != F.max(y)), 1 - F.sum(error * error) / (n * F.var_pop(y)))
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(smape_term(y, p)).alias("smape"),
        r2.alias("r2"),
    ]


def regression_metrics(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", by: Iterable[str] = ()) -> DataFrame:
    """MAE, RMSE, sMAPE and R2 in one pass; R2 is null for constant truth."""
    return df.groupBy(*by).agg(*_regression_aggregates(F.col(truth).cast("double"), F.col(pred).cast("double")))


def brier(df: DataFrame, truth: str = "y_true", score: str = "y_score", by: Iterable[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(truth), F.lit(2.0))).alias("brier"))


HEAD_COLUMNS = ["model", "window_size", "lead", "variable"]


def evaluate_targets(predictions: DataFrame, by: list[str] | None = None, **bucketing: int) -> DataFrame:
    """One metrics row per head of a long prediction table.

    Input columns: the head columns, ``y_true``, ``y_pred`` (value or
    probability) and, constant per head, ``threshold`` and ``blend_weight``.
    """
    by = by or HEAD_COLUMNS
    clipped = predictions.withColumn("y_pred", clip_by_name(F.col("variable"), F.col("y_pred")))
    regression = (
        clipped.where(F.col("variable") != RAIN)
        .groupBy(*by)
        .agg(
            *_regression_aggregates(F.col("y_true").cast("double"), F.col("y_pred")),
            F.first("blend_weight").alias("blend_weight"),
        )
        .withColumn("metric_family", F.lit("regression"))
    )
    rain = clipped.where(F.col("variable") == RAIN).withColumn(
        "hit", (F.col("y_pred") >= F.coalesce(F.col("threshold"), F.lit(0.5))).cast("int")
    )
    counts = confusion(rain, "y_true", "hit", by)
    other = rain.groupBy(*by).agg(
        F.avg(F.pow(F.col("y_pred") - F.col("y_true"), F.lit(2.0))).alias("brier"),
        F.first("threshold").alias("threshold"),
        F.first("blend_weight").alias("blend_weight"),
    )
    auc = ranking_metrics(rain, "y_true", "y_pred", by, **bucketing).drop("pr_auc")
    classification = (
        binary_metrics(counts, by).join(other, by).join(auc, by).withColumn("metric_family", F.lit("classification"))
    )
    return regression.unionByName(classification, allowMissingColumns=True)


def run_summary(metrics: DataFrame, by: Iterable[str] = ("model", "window_size")) -> DataFrame:
    """Means over the heads of a run and one score, lower is better.

    The score is the mean of those of sMAPE, Brier and 1 - F1 that exist.
    """
    regression = F.col("metric_family") == "regression"
    rain = F.col("metric_family") == "classification"
    summary = metrics.groupBy(*by).agg(
        F.avg(F.when(regression, F.col("mae"))).alias("mean_mae"),
        F.avg(F.when(regression, F.col("rmse"))).alias("mean_rmse"),
        F.avg(F.when(regression, F.col("smape"))).alias("mean_smape"),
        F.avg(F.when(regression, F.col("r2"))).alias("mean_r2"),
        F.avg(F.when(rain, F.col("accuracy"))).alias("rain_accuracy"),
        F.avg(F.when(rain, F.col("f1"))).alias("rain_f1"),
        F.avg(F.when(rain, F.col("brier"))).alias("rain_brier"),
    )
    parts = F.array_compact(F.array(F.col("mean_smape"), F.col("rain_brier"), 1.0 - F.col("rain_f1")))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return summary.withColumn("weather_score_lower_is_better", F.try_divide(total, F.size(parts)))


# -- class balance ------------------------------------------------------------


def class_balance(df: DataFrame, label: str, by: Iterable[str] = ()) -> DataFrame:
    """Class counts, neg/pos ratio (each floored at 1) and balanced weights."""
    y = F.col(label)
    counts = df.where(y.isNotNull()).groupBy(*by).agg(_count(y == 1).alias("n_pos"), _count(y == 0).alias("n_neg"))
    one = F.lit(1)
    total = F.col("n_pos") + F.col("n_neg")
    return counts.withColumns(
        {
            "class_ratio": F.greatest(F.col("n_neg"), one) / F.greatest(F.col("n_pos"), one),
            "weight_pos": F.try_divide(total.cast("double"), 2.0 * F.col("n_pos")),
            "weight_neg": F.try_divide(total.cast("double"), 2.0 * F.col("n_neg")),
            "single_class": (F.col("n_pos") == 0) | (F.col("n_neg") == 0),
            "constant_probability": F.when(
                (F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.when(F.col("n_pos") > 0, 1.0).otherwise(0.0)
            ),
        }
    )


def panel_counts(df: DataFrame, period: str = "year") -> DataFrame:
    """Rows, number of periods and the sorted list of periods."""
    per_period = df.groupBy(period).agg(F.count(F.lit(1)).alias("n"))
    return per_period.agg(
        F.sum("n").alias("n_rows"),
        F.count(period).alias("n_periods"),
        F.array_join(F.sort_array(F.collect_list(F.col(period))), ",").alias("periods"),
    )
