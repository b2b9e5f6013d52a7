"""All queries over the driver's tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("journal_plans", "text_plans", "filter_plans", "vector_plans", "time_plans", "topic_plans", "stream_plans", "state_plans")
FLAGSHIP = "bm25_topk"


def _modules():
    return [import_module(f".{m}", __package__) for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in _modules() for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
