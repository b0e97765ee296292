"""All queries of the core, and their SQL counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sutur.plans import corpus, nested, pages, references

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (nested, references, corpus, pages)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, query in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _MODULES if hasattr(module, "oracle_sql") for name, text in module.oracle_sql().items()}
