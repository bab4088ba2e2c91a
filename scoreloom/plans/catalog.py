"""The table of runnable queries: a name, a Spark plan over the given tables, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        assert name not in QUERIES, name
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return add


def r9(value: Column | str) -> Column:
    """A double at nine decimals, so both engines' last bits agree."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c, 9) + F.lit(0.0)
