"""Registry of runnable queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL twin, if any."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    import pkgutil

    import corpusmill.plans as plans

    for module in pkgutil.iter_modules(plans.__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"corpusmill.plans.{module.name}")
