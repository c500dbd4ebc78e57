"""Every query of the engine under one name, with its SQL for the oracle.

Modules of ``tilewright.plans`` register a query with :func:`query`; the SQL is
written independently of the DataFrame plan and uses DuckDB's dialect.
"""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame."""

    def put(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return put


def _load() -> None:
    from tilewright import plans

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"tilewright.plans.{module.name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
