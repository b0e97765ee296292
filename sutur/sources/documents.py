"""Documents: bytes to pages, by content, with limits checked before anything is decoded."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sutur.errors import ConfigurationError
from sutur.functions.paths import path_below
from sutur.session import plain_strings
from sutur.functions.numbers import DEFAULT_DPI, MAX_BYTES, MAX_DOCUMENT_PIXELS, MAX_DPI, MAX_PAGE_PIXELS, MAX_PAGES, MIN_DPI, file_kind

PAGE_SCHEMA = "document string, page_index int, width int, height int, channels int, data binary, issue string"


class PageRenderer(Protocol):
    """Turns PDF bytes into pages. Not part of the library: plug one in."""

    def geometry(self, content: bytes) -> list[tuple[float, float]]:
        """Width and height of every page in points; raises on unreadable files."""

    def render(self, content: bytes, page_index: int, dpi: int) -> tuple[int, int, int, bytes]:
        """(width, height, channels, bytes in image-source order) of one page."""


def checked_dpi(dpi: int | None) -> int:
    if dpi is None:
        return DEFAULT_DPI
    if isinstance(dpi, bool) or not isinstance(dpi, int) or not MIN_DPI <= dpi <= MAX_DPI:
        raise ConfigurationError(f"dpi must be an integer in {MIN_DPI}..{MAX_DPI}")
    return dpi


def scan_documents(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(document, byte_size, input_sha256, kind, issue, content). Kind comes from the content, never from the name.

    A document is named by its path below the folder. The length is checked first; content of files beyond the limit is not looked at. Spark's file
    source skips files of length 0, so they have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = F.col("length") > max_bytes
    content = F.when(~large, F.col("content"))
    kind = file_kind(content)
    issue = F.when(large, "file_too_large").when(kind.isNull(), "unsupported_format")
    return files.select(
        path_below(F.col("path"), path).alias("document"), F.col("length").alias("byte_size"), F.sha2(content, 256).alias("input_sha256"),
        kind.alias("kind"), issue.alias("issue"), F.when(issue.isNull(), content).alias("content"),
    )


def pdf_pages(documents: DataFrame, renderer: PageRenderer, dpi: int | None = None) -> DataFrame:
    """One row per page of PDF documents.

    All page sizes of a document are known and summed before the first page is rendered; a document
    over a limit gives one row with an issue and no page.
    """
    resolution = checked_dpi(dpi)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split(" ")[0] for f in PAGE_SCHEMA.split(", ")]
        for batch in batches:
            for row in batch.itertuples(index=False):
                rows = []
                try:
                    sizes = [(-(-w * resolution // 72), -(-h * resolution // 72)) for w, h in renderer.geometry(row.content)]
                    pixels = [w * h for w, h in sizes]
                    issue = None
                    if not sizes or len(sizes) > MAX_PAGES:
                        issue = "page_count"
                    elif max(pixels) > MAX_PAGE_PIXELS:
                        issue = "page_too_large"
                    elif sum(pixels) > MAX_DOCUMENT_PIXELS:
                        issue = "document_too_large"
                    if issue:
                        rows.append((row.document, None, None, None, None, None, issue))
                    else:
                        for i in range(len(sizes)):
                            rows.append((row.document, i, *renderer.render(row.content, i, resolution), None))
                except Exception:  # a broken file must not end the job
                    rows = [(row.document, None, None, None, None, None, "unreadable_document")]
                out = pd.DataFrame(rows, columns=columns)
                for c in ("page_index", "width", "height", "channels"):
                    out[c] = out[c].astype("Int32")
                yield plain_strings(out)

    return documents.where("kind = 'pdf'").select("document", "content").mapInPandas(run, PAGE_SCHEMA)


def page_limits(pages: DataFrame) -> DataFrame:
    """Adds ``issue`` to (document, page_index, width, height) by the limits per page and per document."""
    from pyspark.sql import Window

    pixels = F.col("width").cast("bigint") * F.col("height")
    so_far = F.sum(pixels).over(Window.partitionBy("document").orderBy("page_index").rowsBetween(Window.unboundedPreceding, 0))
    issue = (
        F.when(F.col("page_index") >= MAX_PAGES, "page_count").when(pixels > MAX_PAGE_PIXELS, "page_too_large").when(so_far > MAX_DOCUMENT_PIXELS, "document_too_large")
    )
    return pages.withColumn("issue", issue)
