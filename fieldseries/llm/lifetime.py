"""Settings that hold while an operator runs: how long shuffle files live, how much a task reads at once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from fieldseries.operators.materialize import short_lived_shuffles as short_lived_shuffles

#: For rows of about a megabyte: few of them at once, in the table reader and on the way to Python.
_LARGE_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "16", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def large_rows(spark: SparkSession) -> Iterator[None]:
    """Within it, tasks hold only a few rows at once."""
    before = {k: spark.conf.get(k, None) for k in _LARGE_ROWS}
    for k, v in _LARGE_ROWS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
