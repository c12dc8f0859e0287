"""Bindings of the operators to the star-schema tables, each with its SQL equivalent."""

from sitelens.catalog.registry import ORACLES, QUERIES

from sitelens.catalog import (  # noqa: E402,F401
    aggregating,
    cleaning,
    cohorts,
    features,
    joining,
    learning,
    ranking,
    scanning,
    scoring,
    statistics,
)

__all__ = ["ORACLES", "QUERIES"]
