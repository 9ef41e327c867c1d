"""A ledger of experiment runs that a broken grid resumes from.

Each run is keyed by a hash of its parameters. Its row and its score table are written
to a staging folder and then renamed into the ledger, and a marker file is written
last: a reader takes a run only when its marker is there, so a run that stopped half
way is invisible and is done again. A grid started again with the same parameters
finds its finished runs by key and computes only the rest.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

MARKER = "_COMMITTED"


def run_key(params: dict[str, Any]) -> str:
    """The hash of a run's parameters: the same parameters give the same key, in any order."""
    text = json.dumps(params, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


class Ledger:
    """Runs under ``path``: ``runs/key=<k>`` (one row) and ``scores/key=<k>`` (its score table)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _dir(self, part: str, key: str) -> str:
        return f"{self.path}/{part}/key={key}"

    def committed(self, key: str) -> bool:
        return self._fs.exists(self._path(f"{self._dir('runs', key)}/{MARKER}"))

    def append(self, key: str, row: DataFrame, scores: DataFrame | None) -> None:
        """Write one run: staged, renamed into place, then marked. A rerun of a committed key is a no-op."""
        if self.committed(key):
            return
        stage = f"{self.path}/_staging/{uuid.uuid4().hex}"
        row.write.parquet(f"{stage}/runs")
        if scores is not None:
            scores.write.parquet(f"{stage}/scores")
        for part in ("scores", "runs"):
            src, dst = self._path(f"{stage}/{part}"), self._path(self._dir(part, key))
            if not self._fs.exists(src):
                continue
            if self._fs.exists(dst):  # left by a run that stopped before its marker
                self._fs.delete(dst, True)
            self._fs.mkdirs(dst.getParent())
            if not self._fs.rename(src, dst):
                raise OSError(f"could not move {src} to {dst}")
        self._fs.create(self._path(f"{self._dir('runs', key)}/{MARKER}"), True).close()
        self._fs.delete(self._path(stage), True)

    def row(self, key: str) -> DataFrame:
        return self.spark.read.parquet(self._dir("runs", key))

    def scores(self, key: str) -> DataFrame | None:
        path = self._dir("scores", key)
        return self.spark.read.parquet(path) if self._fs.exists(self._path(path)) else None
