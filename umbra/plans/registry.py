"""Every query by name, and the DuckDB statement that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from umbra.plans.tables import filled

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("derived", "scalars", "paths", "catalogs", "shadows", "ephemerides", "solving", "globes", "accepting", "store", "recording", "comparing", "texts", "sinks", "resuming", "showing")
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; `oracle` is DuckDB SQL with derived tables in braces."""

    def register(f: Query) -> Query:
        assert name not in _queries, name
        _queries[name] = f
        if oracle:
            _oracles[name] = filled(oracle)
        return f

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"umbra.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
