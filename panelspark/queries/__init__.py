"""Registered queries, grouped by the operators they exercise."""

from panelspark.queries import contracts, errors, evaluation, features, models, normalize, quality, sources, splits, weather  # noqa: F401
from panelspark.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
