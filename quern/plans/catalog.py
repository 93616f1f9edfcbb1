"""Imports every query module, so that all are registered."""

from quern.plans import product, relational, survey, texts  # noqa: F401
from quern.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
