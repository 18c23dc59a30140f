"""Names of the queries, their plans and their SQL twins.

A query module calls `query` on a function of (spark, sf_dir) with the DuckDB SQL
that gives the same rows, or without where SQL can't express it.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    def put(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = plan
        if sql:
            ORACLE_SQL[plan.__name__] = sql
        return plan

    return put


for _name in ("scoring", "relational", "ordered", "texts", "edits", "expansion", "streams", "io", "checks", "marks", "dialogues"):
    import_module(f"textloom.plans.{_name}")
