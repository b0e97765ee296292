"""Fail-closed checks. Each runs as an action, so no optimizer can prune it away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sutur.errors import SuturError


def require_empty(rows: DataFrame, error: type[SuturError], message: str) -> None:
    """Fail if there is any row; the first (in order of all columns) is named."""
    found = rows.orderBy(*rows.columns).limit(1).collect()
    if found:
        raise error(f"{message}: {found[0].asDict()}")


def require_unique(df: DataFrame, keys: list[str], error: type[SuturError], message: str) -> None:
    """Fail if a key repeats; nulls count as a key."""
    require_empty(df.groupBy(*keys).count().where("count > 1").select(*keys), error, message)


def require_all(df: DataFrame, condition: Column, show: list[str], error: type[SuturError], message: str) -> None:
    """Fail unless the condition holds on every row; null counts as not."""
    require_empty(df.where(~F.coalesce(condition, F.lit(False))).select(*show), error, message)
