"""Autoregressive forecasts of a label per series, and forecasts from outside."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fieldseries.operators.split import TRAIN
from fieldseries.schema import LEADS, WEATHER_VARIABLES

SEASONAL_PERIOD = 7


def ar_lags(order: int, seasonal_period: int | None = None) -> list[int]:
    """Lags 1..order, and the seasonal lag as one more regressor."""
    lags = list(range(1, max(1, int(order)) + 1))
    if seasonal_period and seasonal_period not in lags:
        lags.append(int(seasonal_period))
    return lags


def ar_candidates(window: int) -> list[int]:
    """AR orders tried for one window: 1 and the window itself."""
    return list(dict.fromkeys([1, max(1, int(window))]))


def _recursive(gram: np.ndarray, xty: np.ndarray, tail: np.ndarray, lags: list[int], mean: float, steps: int) -> np.ndarray:
    """Least-squares coefficients and their recursion; the mean where that fails."""
    fallback = np.full(steps, mean)
    if len(tail) < max(lags):
        return fallback
    try:
        beta = np.linalg.solve(gram, xty)
    except np.linalg.LinAlgError:
        return fallback
    if not np.all(np.isfinite(beta)):
        return fallback
    values = list(tail)
    with np.errstate(over="ignore", invalid="ignore"):
        for _ in range(steps):
            values.append(float(sum(b * values[-k] for b, k in zip(beta, lags))))
    scores = np.asarray(values[len(tail) :], dtype=float)
    return np.nan_to_num(scores, nan=mean, posinf=1.0, neginf=0.0)


def ar_forecast(
    df: DataFrame,
    series: list[str],
    order_by: list[str],
    target: str,
    order: int,
    seasonal_period: int | None = None,
    split: str = "split",
) -> DataFrame:
    """Scores 0..1 for the validation and test rows, from the training rows only.

    A series is fitted by least squares on its lagged values: the normal
    equations are plain sums, so only one small row per series reaches Python,
    which solves it and runs the recursion. A series is bounded by the calendar.
    Falls back to the mean of the training rows, 0.5 when there are none.
    Result: ``series, order_by, split, y_true, y_score``.
    """
    lags = ar_lags(order, seasonal_period)
    k = len(lags)
    known = df.where(F.col(target).isNotNull()).select(*series, *order_by, split, F.col(target).cast("double").alias("_y"))
    w = Window.partitionBy(*series).orderBy(*order_by)
    backwards = Window.partitionBy(*series).orderBy(*[F.col(c).desc() for c in order_by])
    history = known.where(F.col(split) == TRAIN).withColumns(
        {**{f"_l{j}": F.lag("_y", lag).over(w) for j, lag in enumerate(lags)}, "_r": F.row_number().over(backwards)}
    )
    full = F.col(f"_l{int(np.argmax(lags))}").isNotNull()

    def product(a: str, b: str):
        return F.sum(F.when(full, F.col(a) * F.col(b)))

    tail = F.when(F.col("_r") <= max(lags), F.struct((-F.col("_r")).alias("r"), "_y"))
    fits = history.groupBy(*series).agg(
        F.array(*[product(f"_l{i}", f"_l{j}") for i in range(k) for j in range(k)]).alias("_gram"),
        F.array(*[product(f"_l{i}", "_y") for i in range(k)]).alias("_xty"),
        # at most max(lags) values per series
        F.transform(F.sort_array(F.collect_list(tail)), lambda e: e["_y"]).alias("_tail"),
        F.avg("_y").alias("_mean"),
    )
    ahead = known.where(F.col(split) != TRAIN).withColumn("_step", F.row_number().over(w))
    demand = ahead.groupBy(*series).agg(F.max("_step").alias("_steps"))

    @pandas_udf("array<double>")
    def forecast(gram: pd.Series, xty: pd.Series, tail: pd.Series, mean: pd.Series, steps: pd.Series) -> pd.Series:
        rows = []
        for g, x, t, m, n in zip(gram, xty, tail, mean, steps):
            level = 0.5 if m is None or np.isnan(m) else float(m)
            if g is None or any(v is None or np.isnan(v) for v in g):
                rows.append(np.full(int(n), level))
                continue
            matrix = np.asarray(g, dtype=float).reshape(k, k)
            rows.append(_recursive(matrix, np.asarray(x, dtype=float), np.asarray(t, dtype=float), lags, level, int(n)))
        return pd.Series(rows)

    scores = demand.join(fits, series, "left").select(
        *series, forecast("_gram", "_xty", "_tail", "_mean", "_steps").alias("_scores")
    )
    return ahead.join(scores, series).select(
        *series,
        *order_by,
        split,
        F.col("_y").cast("int").alias("y_true"),
        F.least(F.greatest(F.get("_scores", F.col("_step") - 1), F.lit(0.0)), F.lit(1.0)).alias("y_score"),
    )


def ma_candidates(window: int) -> list[int]:
    """Moving-average orders tried for one window: 0, 1 and the window itself."""
    return list(dict.fromkeys([0, 1, max(1, int(window))]))


def arma_candidates(window: int) -> list[tuple[int, int]]:
    """(AR, MA) orders tried for one window: AR orders by MA orders."""
    return [(p, q) for p in ar_candidates(window) for q in ma_candidates(window)]


#: A Gram matrix counts as singular when |det| <= SINGULAR * (product of its diagonal).
SINGULAR = 1e-12


def _solve(gram: np.ndarray, xty: np.ndarray) -> np.ndarray | None:
    """Least-squares coefficients from the normal equations; None when they are singular or not finite."""
    if not np.all(np.isfinite(gram)) or not np.all(np.isfinite(xty)):
        return None
    scale = float(np.prod(np.diag(gram)))
    if scale <= 0 or abs(np.linalg.det(gram)) <= SINGULAR * scale:
        return None
    beta = np.linalg.solve(gram, xty)
    return beta if np.all(np.isfinite(beta)) else None


def _gram_sums(rows: DataFrame, series: list[str], regressors: list[str], complete) -> DataFrame:
    """Per series: the normal equations of ``_y`` on ``regressors`` over complete rows, as two arrays."""
    k = len(regressors)

    def product(a: str, b: str):
        return F.sum(F.when(complete, F.col(a) * F.col(b)))

    return rows.groupBy(*series).agg(
        F.array(*[product(regressors[i], regressors[j]) for i in range(k) for j in range(k)]).alias("_gram"),
        F.array(*[product(r, "_y") for r in regressors]).alias("_xty"),
    )


def _coefficients(k: int):
    @pandas_udf("array<double>")
    def solve(gram: pd.Series, xty: pd.Series) -> pd.Series:
        out = []
        for g, x in zip(gram, xty):
            if g is None or x is None or any(v is None for v in g) or any(v is None for v in x):
                out.append(None)
                continue
            beta = _solve(np.asarray(g, dtype=float).reshape(k, k), np.asarray(x, dtype=float))
            out.append(None if beta is None else beta.tolist())
        return pd.Series(out, dtype=object)

    return solve


def arma_forecast(
    df: DataFrame,
    series: list[str],
    order_by: list[str],
    target: str,
    ar_order: int,
    ma_order: int,
    long_order: int | None = None,
    split: str = "split",
) -> DataFrame:
    """ARMA(ar_order, ma_order) scores 0..1 for the validation and test rows, from the training rows only.

    Two-stage innovations regression: a long autoregression of ``long_order`` lags (default
    ``max(4, 2 * (ar_order + ma_order))``) gives each training row a residual, an estimate of its
    innovation; then ``_y`` is regressed on its own ``ar_order`` lags and the ``ma_order`` lags of
    those residuals. Both fits are grouped sums of products (one row per series), and each is a
    small solve. Forecasts run the recursion from the last training values, future innovations
    0. A series without enough complete rows, or with singular equations (see ``SINGULAR``),
    scores the mean of its training rows (0.5 without any). With ``ma_order`` 0 this is the plain
    autoregression. Result: ``series, order_by, split, y_true, y_score``.
    """
    if ma_order <= 0:
        return ar_forecast(df, series, order_by, target, ar_order, split=split)
    p, q = max(1, int(ar_order)), int(ma_order)
    m = int(long_order) if long_order else max(4, 2 * (p + q))
    known = df.where(F.col(target).isNotNull()).select(*series, *order_by, split, F.col(target).cast("double").alias("_y"))
    w = Window.partitionBy(*series).orderBy(*order_by)
    backwards = Window.partitionBy(*series).orderBy(*[F.col(c).desc() for c in order_by])
    train = known.where(F.col(split) == TRAIN)

    # stage 1: the long autoregression and its residuals
    longs = [f"_a{j}" for j in range(1, m + 1)]
    lagged = train.withColumns({name: F.lag("_y", j).over(w) for j, name in enumerate(longs, 1)})
    full = F.col(longs[-1]).isNotNull()
    phi = _gram_sums(lagged, series, longs, full).select(*series, _coefficients(m)("_gram", "_xty").alias("_phi"))
    fitted = F.aggregate(F.zip_with("_phi", F.array(*longs), lambda b, x: b * x), F.lit(0.0), lambda acc, v: acc + v)
    res = lagged.join(phi, series, "left").withColumn("_e", F.when(full & F.col("_phi").isNotNull(), F.col("_y") - fitted))

    # stage 2: own lags and lagged residuals
    regs = [f"_b{i}" for i in range(1, p + 1)] + [f"_c{j}" for j in range(1, q + 1)]
    second = res.select(*series, *order_by, "_y", "_e").withColumns(
        {
            **{f"_b{i}": F.lag("_y", i).over(w) for i in range(1, p + 1)},
            **{f"_c{j}": F.lag("_e", j).over(w) for j in range(1, q + 1)},
            "_r": F.row_number().over(backwards),
        }
    )
    complete = F.lit(True)
    for r in regs:
        complete = complete & F.col(r).isNotNull()
    tail = F.when(F.col("_r") <= max(p, q), F.struct((-F.col("_r")).alias("r"), "_y", "_e"))
    fits = _gram_sums(second, series, regs, complete).join(
        second.groupBy(*series).agg(F.sort_array(F.collect_list(tail)).alias("_tail"), F.avg("_y").alias("_mean")), series
    )
    fits = fits.select(*series, _coefficients(p + q)("_gram", "_xty").alias("_beta"), "_tail", "_mean")
    ahead = known.where(F.col(split) != TRAIN).withColumn("_step", F.row_number().over(w))
    demand = ahead.groupBy(*series).agg(F.max("_step").alias("_steps"))

    @pandas_udf("array<double>")
    def forecast(beta: pd.Series, tail: pd.Series, mean: pd.Series, steps: pd.Series) -> pd.Series:
        rows = []
        for b, t, level, n in zip(beta, tail, mean, steps):
            level = 0.5 if level is None or np.isnan(level) else float(level)
            ys = [float(v["_y"]) for v in t] if t is not None else []
            es = [0.0 if v["_e"] is None else float(v["_e"]) for v in t] if t is not None else []
            if b is None or len(ys) < p:
                rows.append(np.full(int(n), level))
                continue
            values = []
            with np.errstate(over="ignore", invalid="ignore"):
                for _ in range(int(n)):
                    y = sum(b[i] * ys[-1 - i] for i in range(p)) + sum(b[p + j] * es[-1 - j] for j in range(min(q, len(es))))
                    ys.append(float(y))
                    es.append(0.0)
                    values.append(float(y))
            rows.append(np.nan_to_num(np.asarray(values, dtype=float), nan=level, posinf=1.0, neginf=0.0))
        return pd.Series(rows)

    scores = demand.join(fits, series, "left").select(*series, forecast("_beta", "_tail", "_mean", "_steps").alias("_scores"))
    return ahead.join(scores, series).select(
        *series,
        *order_by,
        split,
        F.col("_y").cast("int").alias("y_true"),
        F.least(F.greatest(F.get("_scores", F.col("_step") - 1), F.lit(0.0)), F.lit(1.0)).alias("y_score"),
    )


# -- forecasts made elsewhere -------------------------------------------------------


def median_column(columns: Iterable[str], variable: str) -> str:
    """The column that holds the median forecast of a variable, by usual spellings."""
    columns = list(columns)
    # fixed spellings, in order of preference
    spellings = [
        variable, f"{variable}_0.5", f"{variable}_q0.5", f"{variable}_median", f"{variable}_mean",
        f"0.5_{variable}", f"median_{variable}",
    ]
    found = [c for c in spellings if c in columns] or [c for c in columns if c.startswith(f"{variable}_")]
    if not found:
        raise ValueError(f"No median column for {variable} in {columns}")
    return found[0]


def external_forecasts(forecasts: DataFrame, variables: Iterable[str] = WEATHER_VARIABLES) -> DataFrame:
    """Long ``(sample_id, lead, variable, y_pred)`` from a forecaster's output table.

    The last two rows of a sample, by timestamp, are its two leads.
    """
    names = forecasts.columns
    id_column = next((c for c in ("id", "item_id") if c in names), names[0])
    latest = Window.partitionBy(id_column).orderBy(F.col("timestamp").desc())
    entries = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), F.col(f"`{median_column(names, v)}`").cast("double").alias("y_pred"))
            for v in variables
        ]
    )
    last = forecasts.withColumn("_back", F.row_number().over(latest)).where(F.col("_back") <= 2)
    lead_names = {2 - (step - 1): name for name, step in LEADS.items()}
    lead = F.coalesce(*[F.when(F.col("_back") == back, F.lit(name)) for back, name in lead_names.items()])
    return last.select(
        F.col(id_column).cast("string").alias("sample_id"), lead.alias("lead"), F.explode(entries).alias("e")
    ).select("sample_id", "lead", "e.*")


def attach_forecasts(heads: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Join forecasts to head rows; a sample without forecast raises."""
    joined = heads.join(forecasts, ["sample_id", "lead", "variable"], "left")
    message = F.concat(F.lit("Forecast output is missing sample_id="), F.col("sample_id"))
    return joined.withColumn("y_pred", F.coalesce(F.col("y_pred"), F.raise_error(message).cast("double")))
