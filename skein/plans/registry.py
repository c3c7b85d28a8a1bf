"""Names of the queries, each with its plan and, where SQL can express it, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan (session, directory of the tables) under ``name``."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return register
