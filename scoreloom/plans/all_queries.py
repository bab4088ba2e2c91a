"""Imports every query module so that the catalog is complete."""

from scoreloom.plans import (  # noqa: F401
    q_inventory,
    q_joins,
    q_keys,
    q_metrics,
    q_reports,
    q_sources,
    q_training,
)
from scoreloom.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
