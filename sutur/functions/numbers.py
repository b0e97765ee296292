"""Integer rules: widths, timesteps, page pixels, seeds, file magic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Geometry of the line model and limits of documents.
MODEL_HEIGHT = 64
MIN_WIDTH, MAX_WIDTH = 4, 2048
MAX_BYTES = 100 * 1024 * 1024
MAX_PAGES = 100
MAX_PAGE_PIXELS, MAX_DOCUMENT_PIXELS = 50_000_000, 500_000_000
MIN_DPI, DEFAULT_DPI, MAX_DPI = 72, 200, 400
PNG_MAGIC = "89504E470D0A1A0A"
JPEG_MAGIC = "FFD8FF"
PDF_MAGIC = "255044462D"


def width_to_timesteps(width: Column) -> Column:
    """Frames of a line of some width after two halvings; null outside the model's widths."""
    return F.when(width.between(MIN_WIDTH, MAX_WIDTH), F.floor(F.floor(width / 2) / 2).cast("int"))


def resized_width(width: Column, height: Column, target: int = MODEL_HEIGHT) -> Column:
    """Width after scaling to the target height, halves rounded up; integers only."""
    w, h = width.cast("bigint"), height.cast("bigint")
    doubled = 2 * w * target + h
    return ((doubled - F.pmod(doubled, 2 * h)) / (2 * h)).cast("int")


def points_to_pixels(points: Column, dpi: Column) -> Column:
    return F.ceil(points * dpi / F.lit(72.0)).cast("int")


def derived_seed(master: Column, stable_id: Column) -> Column:
    """First 8 bytes of sha256(master NUL id) as an unsigned number (decimal: it exceeds bigint)."""
    digest = F.sha2(F.concat(master.cast("string"), F.lit("\u0000"), stable_id), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def tie_digest(seed: int, document_id: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}\u0000"), document_id), 256)


def file_kind(content: Column) -> Column:
    """``pdf``, ``png``, ``jpeg`` or null from the bytes alone.

    A PDF header may stand after NULs and blanks within the first 1024 bytes.
    """
    head = F.hex(F.substring(content, 1, 1024))
    pdf = F.regexp_replace(head, "^(?:00|09|0A|0C|0D|20)+", "")
    start = F.hex(F.substring(content, 1, 8))
    return (
        F.when(pdf.startswith(PDF_MAGIC), "pdf").when(start == PNG_MAGIC, "png").when(start.startswith(JPEG_MAGIC), "jpeg")
    )


def pixel_issue(width: Column, height: Column) -> Column:
    """Why a page is refused by size, or null."""
    pixels = width.cast("bigint") * height
    return F.when((width < 1) | (height < 1), "invalid_dimensions").when(pixels > MAX_PAGE_PIXELS, "page_too_large")
