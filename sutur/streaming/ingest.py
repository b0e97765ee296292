"""Streaming extension: row rules on arriving deliveries.

Only rules that look at one row can stream. Duplicates, splits and fingerprints need the whole
dataset and are refused here. The watermark bounds the state of the counts per window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutur.errors import SuturError
from sutur.operators.samples import contract_issues
from sutur.operators.validation import text_issue_codes


def require_streaming(df: DataFrame) -> None:
    if not df.isStreaming:
        raise SuturError("expected a streaming frame")


def refuse_streaming(df: DataFrame, operator: str) -> None:
    """For operators that need complete data."""
    if df.isStreaming:
        raise SuturError(f"{operator} needs complete data and cannot stream")


def checked_stream(deliveries: DataFrame) -> DataFrame:
    """Deliveries with the issues of their contract and text; stateless."""
    return text_issue_codes(deliveries).withColumn("contract", contract_issues())


def _timed(deliveries: DataFrame, time: str) -> DataFrame:
    """Watermarks need a timestamp with the session's zone."""
    return deliveries.withColumn(time, F.col(time).cast("timestamp"))


def issue_counts(deliveries: DataFrame, time: str = "loaded_at", late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Issues per window and code; deliveries later than ``late`` behind the newest are dropped from the counts."""
    issues = text_issue_codes(_timed(deliveries, time).withWatermark(time, late)).select(time, F.explode("codes").alias("code"))
    return issues.groupBy(F.window(time, window).alias("w"), "code").agg(F.count(F.lit(1)).alias("n")).select("w.start", "code", "n")


def fresh_deliveries(deliveries: DataFrame, time: str = "loaded_at", late: str = "1 day") -> DataFrame:
    """First delivery of every sample within the watermark; repeats that arrive later than that come through again."""
    return _timed(deliveries, time).withWatermark(time, late).dropDuplicatesWithinWatermark(["sample_id"])
