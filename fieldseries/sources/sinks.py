"""Writing run results: one partition per run, replaced as a whole on a rerun."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_runs(df: DataFrame, path: str, fmt: str = "parquet", run_id: str | None = None) -> None:
    """Write a result table partitioned by ``run_id``.

    Only the partitions present in ``df`` are replaced, so a retried run
    leaves the results of other runs alone.
    """
    table = df if run_id is None else df.withColumn("run_id", F.lit(run_id))
    writer = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def params_json(df: DataFrame, columns: list[str], output: str = "best_params") -> DataFrame:
    """Pack parameter columns into one JSON text column."""
    return df.withColumn(output, F.to_json(F.struct(*columns))).drop(*columns)


def write_experiment(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Write the tables of one experiment (predictions, metrics, report, split ...)."""
    for name, table in tables.items():
        write_runs(table, f"{path}/{name}", "parquet", run_id)


RUNS_FOLDER = "_runs"


def _fs(spark, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit_run(tables: dict[str, DataFrame], path: str, run_id: str, sort_by: dict[str, list[str]] | None = None) -> None:
    """Write the tables of one run so that readers see all of them or none.

    Each table is range-partitioned and sorted by its ``sort_by`` columns (its first column by
    default), written to a staging folder, then renamed to ``<path>/<name>/run_id=<run_id>``;
    the marker ``<path>/_runs/<run_id>`` is written last. A run written again replaces its
    tables; a run that stopped before its marker stays invisible to ``read_committed``.
    """
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    Path, fs = _fs(spark, path)
    marker = Path(f"{path}/{RUNS_FOLDER}/{run_id}")
    if fs.exists(marker):
        fs.delete(marker, False)
    stage = f"{path}/_staging/{uuid.uuid4().hex}"
    for name, table in tables.items():
        keys = (sort_by or {}).get(name) or [table.columns[0]]
        table.drop("run_id").repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{stage}/{name}")
    for name in tables:
        dst = Path(f"{path}/{name}/run_id={run_id}")
        if fs.exists(dst):
            fs.delete(dst, True)
        fs.mkdirs(dst.getParent())
        if not fs.rename(Path(f"{stage}/{name}"), dst):
            raise OSError(f"could not move a table of run {run_id} into {path}")
    fs.create(marker, True).close()
    fs.delete(Path(stage), True)


def committed_runs(spark, path: str) -> list[str]:
    """Ids of the runs whose marker is there (one small file per run)."""
    Path, fs = _fs(spark, path)
    folder = Path(f"{path}/{RUNS_FOLDER}")
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def read_committed(spark, path: str, name: str, schema: str | None = None) -> DataFrame:
    """Rows of table ``name`` of committed runs only, with ``run_id`` (the runs' partitions pruned)."""
    runs = committed_runs(spark, path)
    reader = spark.read.schema(f"{schema}, run_id string") if schema else spark.read
    return reader.parquet(f"{path}/{name}").where(F.col("run_id").isin(runs))
