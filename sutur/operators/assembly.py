"""Recognised lines to page and document text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutur.errors import AssemblyError
from sutur.guards import require_empty

# Separators of lines and pages.
LINE_SEPARATOR = "\n"
PAGE_SEPARATOR = "\n\n"


def _joined(text: str, order: str, separator: str):
    """Ordered concatenation; null texts are skipped, empty ones are not."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text)))), lambda s: s[text]), separator)


def require_contiguous(lines: DataFrame, keys: list[str], order: str) -> None:
    """Fail unless the order numbers of every group are 0..n-1."""
    bad = lines.groupBy(*keys).agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count(order).alias("n"), F.countDistinct(order).alias("d"))
    require_empty(bad.where("not (lo = 0 and hi = n - 1 and n = d)").select(*keys), AssemblyError, "order numbers must be contiguous from 0")


def assemble_pages(lines: DataFrame, keys: list[str], order: str = "reading_order_index", text: str = "text") -> DataFrame:
    """(keys, page_text, lines, failed_lines): texts of a page in reading order, one per line.

    A line without text has failed: it is counted but adds nothing to the page.
    """
    return lines.groupBy(*keys).agg(
        _joined(text, order, LINE_SEPARATOR).alias("page_text"), F.count(F.lit(1)).alias("lines"), F.count_if(F.col(text).isNull()).alias("failed_lines")
    )


def assemble_documents(pages: DataFrame, key: str, order: str, text: str = "page_text") -> DataFrame:
    """(key, document_text, pages): pages joined by a blank line; a page without text keeps its separators."""
    filled = pages.withColumn(text, F.coalesce(text, F.lit("")))
    return filled.groupBy(key).agg(_joined(text, order, PAGE_SEPARATOR).alias("document_text"), F.count(F.lit(1)).alias("pages"))


def document_json(documents: DataFrame, pretty: bool = True) -> DataFrame:
    """One JSON string per row with sorted field names; nulls are left out."""
    columns = sorted(documents.columns)
    return documents.select(F.to_json(F.struct(*columns), {"pretty": str(pretty).lower()}).alias("value"))
