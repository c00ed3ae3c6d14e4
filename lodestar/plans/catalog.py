"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import file_plans, graph_plans, ledger_plans, retrieval_plans, stream_plans
from .registry import ORACLES, QUERIES

__all__ = ["file_plans", "graph_plans", "ledger_plans", "oracle_sql", "queries", "retrieval_plans", "stream_plans"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
