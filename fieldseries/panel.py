"""The panel contract: one row per series and order value.

A panel has series keys (default ``year``; with many stations
``site, year``) and an order column (``day``). A daily panel holds at most one
row per series and day of the year, so a series has at most 366 rows. That
bound is what makes ``Window.partitionBy(keys)`` safe at any data size: more
data means more series, never a longer one. :func:`check_panel` verifies it
with a map-side-combined count, so even a key that holds a third of all rows is
reduced before it is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MAX_DAYS_PER_SERIES = 366


@dataclass(frozen=True)
class Panel:
    keys: tuple[str, ...] = ("year",)
    order: str = "day"

    @property
    def columns(self) -> list[str]:
        return [*self.keys, self.order]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def trailing(self, rows: int) -> WindowSpec:
        """The current row and the ``rows - 1`` rows before it."""
        return self.window().rowsBetween(-(rows - 1), 0)

    def running(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)


def panel_violations(df: DataFrame, panel: Panel, max_rows: int = MAX_DAYS_PER_SERIES) -> DataFrame:
    """Series that repeat an order value or are longer than ``max_rows``."""
    per_day = df.groupBy(*panel.columns).agg(F.count(F.lit(1)).alias("n"))
    return (
        per_day.groupBy(*panel.keys)
        .agg(F.sum("n").alias("n_rows"), F.max("n").alias("max_copies"))
        .where((F.col("max_copies") > 1) | (F.col("n_rows") > max_rows))
    )


def check_panel(df: DataFrame, panel: Panel, max_rows: int = MAX_DAYS_PER_SERIES) -> DataFrame:
    """Return ``df`` unchanged or raise on the first broken series."""
    bad = panel_violations(df, panel, max_rows).limit(1).collect()
    if bad:
        raise ValueError(f"Not a panel on {panel.columns}: {bad[0].asDict()}")
    return df
