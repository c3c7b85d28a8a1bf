"""All queries of the engine by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from skein.plans.registry import PLANS, SQL

#: Modules that register queries when they are imported.
MODULES = ("filters", "vectors", "reads", "analytics", "fitted", "more", "rest", "appeal_runs", "topic_runs", "pipeline", "files")
for _name in MODULES:
    import_module(f"skein.plans.{_name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments by filter reason, most frequent first."""
    return PLANS["agg_01_reason_counts"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
