"""Moving-average terms: the two-stage regression against its SQL and the plain autoregression."""

import numpy as np
import pytest
from check_oracle import compare, duck

from fieldseries.catalog import ORACLES, QUERIES
from fieldseries.catalog.fixtures import split_panel
from fieldseries.operators.forecast import _solve, ar_forecast, arma_candidates, arma_forecast


def test_candidate_orders():
    assert arma_candidates(7) == [(1, 0), (1, 1), (1, 7), (7, 0), (7, 1), (7, 7)]
    assert arma_candidates(1) == [(1, 0), (1, 1)]


def test_singular_equations_give_none():
    assert _solve(np.array([[1.0, 2.0], [2.0, 4.0]]), np.array([1.0, 2.0])) is None
    assert np.allclose(_solve(np.array([[2.0, 1.0], [1.0, 3.0]]), np.array([1.0, 2.0])), [0.2, 0.6])


def test_without_moving_average_is_the_autoregression(spark, sf_small):
    panel = split_panel(spark, sf_small)
    a = sorted(tuple(r) for r in arma_forecast(panel, ["site"], ["year", "day"], "target_favorable", 7, 0).collect())
    b = sorted(tuple(r) for r in ar_forecast(panel, ["site"], ["year", "day"], "target_favorable", 7).collect())
    assert a == b


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_arma11_equals_its_sql(spark, sf):
    assert compare(QUERIES["arma11_forecast"](spark, sf), duck(sf), ORACLES["arma11_forecast"]) is None


def test_grid_has_every_order(spark, sf_small):
    got = QUERIES["arma_order_grid"](spark, sf_small)
    orders = {(r.ar_order, r.ma_order) for r in got.select("ar_order", "ma_order").distinct().collect()}
    assert orders == set(arma_candidates(7))
    assert got.where("y_score < 0 or y_score > 1 or y_score is null").count() == 0
