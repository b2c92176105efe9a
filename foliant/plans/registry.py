"""All registered queries of the library, by name, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.plans import billing_plans, operations_plans, record_plans, stream_plans, structure_plans, usage_plans

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (usage_plans, billing_plans, structure_plans, operations_plans, record_plans, stream_plans)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
