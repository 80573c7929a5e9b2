"""Registered queries: a name, a DataFrame function of (spark, folder of tables), and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES: tuple[str, ...] = (
    "operators.pair_queries", "operators.function_queries", "operators.evaluate_queries", "operators.sequence_queries", "operators.policy_queries",
    "operators.more_queries", "operators.extra_queries", "streaming.queries", "sources.queries",
)

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function; ``sql`` is its DuckDB twin where SQL can express it."""

    def add(function: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries named {name}")
        _queries[name] = function
        if sql:
            _oracles[name] = sql
        return function

    return add


def _load() -> None:
    for module in MODULES:
        import_module(f"skyledger.{module}")


def queries() -> dict[str, Query]:
    _load()
    return _queries


def oracle_sql() -> dict[str, str]:
    _load()
    return _oracles
