"""A grid that breaks half way and is started again: same table, only the rest computed."""

import tempfile

import pytest
from pyspark.sql import functions as F

from fieldseries.catalog.fixtures import SITE, site_panel
from fieldseries.operators.materialize import materialize
from fieldseries.plans import experiments
from fieldseries.sources.ledger import Ledger, run_key


class Broken(BaseException):
    """Not an Exception: the grid does not record it as a failed run but stops."""


def rows(table):
    return sorted(tuple(r) for r in table.drop("seconds").collect())


def test_run_key_ignores_order():
    assert run_key({"a": 1, "b": [2, 3]}) == run_key({"b": [2, 3], "a": 1}) != run_key({"a": 2, "b": [2, 3]})


def test_broken_grid_resumes(spark, sf_small, monkeypatch):
    panel = materialize(site_panel(spark, sf_small))
    grid = dict(models=["simcast"], variants=["baseline", "interaction_fe"], windows=[3, 7], fallback=True)
    fresh = experiments.disease_benchmark(panel, SITE, **grid)["runs"]
    folder = tempfile.mkdtemp(prefix="ledger-", dir="/tmp")
    real, calls = experiments.rule_scores, []

    def breaking(*args, **kw):
        calls.append(1)
        if len(calls) == 3:
            raise Broken()
        return real(*args, **kw)

    monkeypatch.setattr(experiments, "rule_scores", breaking)
    with pytest.raises(Broken):
        experiments.disease_benchmark(panel, SITE, ledger=folder, **grid)
    assert len(calls) == 3

    calls.clear()
    monkeypatch.setattr(experiments, "rule_scores", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    again = experiments.disease_benchmark(panel, SITE, ledger=folder, **grid)["runs"]
    assert len(calls) == 2  # two of four were in the ledger
    assert rows(again) == rows(fresh)

    calls.clear()
    third = experiments.disease_benchmark(panel, SITE, ledger=folder, **grid)["runs"]
    assert calls == [] and rows(third) == rows(fresh)


def test_half_written_run_is_invisible(spark):
    folder = tempfile.mkdtemp(prefix="ledger-", dir="/tmp")
    book = Ledger(spark, folder)
    one = spark.range(1).select(F.lit("x").alias("run_id"))
    one.write.parquet(f"{folder}/runs/key=abc")  # no marker: stopped before its commit
    assert not book.committed("abc")
    book.append("abc", one, spark.range(3))
    assert book.committed("abc") and book.scores("abc").count() == 3 and book.row("abc").count() == 1
