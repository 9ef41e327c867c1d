"""Missing values: medians learned on the training rows, applied everywhere."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldseries.functions.cleaning import finite
from fieldseries.operators.lookup import small_rows
from fieldseries.operators.ranked import column_medians
from fieldseries.operators.split import TRAIN
from fieldseries.operators.windows import add_columns, forward_fill
from fieldseries.panel import Panel
from fieldseries.schema import FEATURE_COLUMNS, ZERO_FILL_COLUMNS


def carry_forward(df: DataFrame, panel: Panel, columns: Iterable[str] = FEATURE_COLUMNS) -> DataFrame:
    """Rain columns to zero, then the last known value of the same series."""
    zeroed = add_columns(df, {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ZERO_FILL_COLUMNS if c in df.columns})
    return forward_fill(zeroed, columns, panel)


def fit_medians(df: DataFrame, columns: Iterable[str], approximate: bool = False) -> DataFrame:
    """Rows ``(column_name, median)``; nulls are skipped, all-null columns are absent.

    ``approximate`` trades exactness for a sketch that needs no shuffle of the
    values.
    """
    names = [c for c in columns if c in df.columns]
    if not approximate:
        return column_medians(df, names)
    sketches = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 100_000).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("median")) for c in names])
    return sketches.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("median").isNotNull())


def apply_medians(df: DataFrame, medians: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fill with the fitted medians, 0.0 where none exists.

    The medians are one number per column, read once into the plan.
    """
    fills = {r["column_name"]: r["median"] for r in small_rows(medians)}
    return add_columns(
        df,
        {
            c: F.coalesce(F.col(c).cast("double"), F.lit(float(fills.get(c, 0.0))))
            for c in columns
            if c in df.columns
        },
    )


def impute_panel(
    df: DataFrame, panel: Panel, columns: Iterable[str] = FEATURE_COLUMNS, split: str = "split", approximate: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Carry forward inside each series, then fill from training medians.

    ``df`` holds all splits; a series belongs to one split, so carrying forward
    cannot leak. Returns the filled panel and the medians. The order column
    and the keys are complete by contract and stay untouched.
    """
    names = [c for c in columns if c in df.columns and c not in panel.columns]
    carried = carry_forward(df, panel, names)
    medians = fit_medians(carried.where(F.col(split) == TRAIN), names, approximate)
    return apply_medians(carried, medians, names), medians


def fill_own_medians(df: DataFrame, columns: Iterable[str], target: str | None = None) -> DataFrame:
    """Infinities to null, then the medians of this very frame, then 0.

    With ``target`` only rows that have one are kept, and count.
    """
    names = list(columns)
    rows = df if target is None else df.where(F.col(target).isNotNull())
    rows = add_columns(rows, {c: finite(F.col(c)) for c in names})
    return apply_medians(rows, fit_medians(rows, names), names)
