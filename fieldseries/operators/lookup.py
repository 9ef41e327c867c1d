"""Attaching a table with one row per run or head."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldseries.operators.materialize import materialize

#: Rows that the driver reads at once where it needs them, and that a join may broadcast.
SMALL_ROWS = 10_000


def small_rows(small: DataFrame, limit: int = SMALL_ROWS) -> list:
    """Rows of a table with one row per run or head; a longer table raises."""
    rows = small.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows where one for each run or head was expected")
    return rows


def attach_small(df: DataFrame, small: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Add ``columns`` of ``small`` by the key ``on``, nulls included; null where the key is absent.

    Thresholds and weights come one per head, and a head may own most rows. The table is
    written and counted: up to ``SMALL_ROWS`` rows it is broadcast, so the rows stay where
    they are; a longer one is joined by key, where adaptive execution splits a hot head.
    """
    table = materialize(small.select(*[F.col(c).alias(f"_on_{c}") for c in on], *columns))
    if table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        table = F.broadcast(table)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on], F.lit(True))
    return df.join(table, same, "left").drop(*[f"_on_{c}" for c in on])
