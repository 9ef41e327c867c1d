"""Registered queries and the plain SQL that has to give the same result."""

from fieldseries.catalog import features, forecasting, learning, metrics, selection, sources  # noqa: F401
from fieldseries.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
