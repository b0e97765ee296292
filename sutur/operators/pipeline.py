"""From page images and documents to text: the operators in a row, with checks that fail closed.

Pages are independent, so everything is grouped by page and nothing by document before the texts
are put together. What the steps hand on is written out once, as every step is read twice: by the
next one and by its check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sutur.config import InferenceConfig, InputLimitsConfig, PreprocessingConfig, SegmentationConfig
from sutur.errors import AssemblyError, DecodingError, DocumentError
from sutur.guards import require_empty, require_unique
from sutur.operators.assembly import assemble_documents, assemble_pages, require_contiguous
from sutur.operators.layout import segment_components
from sutur.operators.recognition import Recognizer, greedy_texts, line_crops, recognize_lines
from sutur.session import materialize
from sutur.sources.documents import PageRenderer, page_limits, pdf_pages, scan_documents
from sutur.sources.pixels import page_components, scan_images


def recognize_pages(
    pages: DataFrame,
    load: Callable[[], Recognizer],
    vocabulary: list[str],
    preprocessing: PreprocessingConfig = PreprocessingConfig(),
    segmentation: SegmentationConfig = SegmentationConfig(),
    inference: InferenceConfig = InferenceConfig(),
) -> tuple[DataFrame, DataFrame]:
    """Text of every page, and its lines.

    pages  page_id string (unique), page_index int, image struct<height, width, nChannels, data>

    Gives (page_id, page_index, page_text, lines, failed_lines) with one row per page - a page
    without lines has the empty text - and (page_id, region_id, x, y, width, height, column_index,
    reading_order_index, region_kind, text). Fails on repeated page_ids, on reading orders that are
    not 0..n-1, and if the recogniser leaves out a line or gives one twice.
    """
    require_unique(pages, ["page_id"], AssemblyError, "repeated page")
    found = page_components(pages, preprocessing).where("label is not null").drop("page_index")
    found = found.join(pages.select("page_id", "page_index").hint("merge"), "page_id")
    regions = materialize(segment_components(found, segmentation), "regions")
    require_contiguous(regions, ["page_id"], "reading_order_index")
    scored = recognize_lines(line_crops(pages, regions), load, inference.batch_size)
    texts = materialize(greedy_texts(scored, vocabulary).select(*regions.columns, "text"), "texts")
    require_unique(texts, ["page_id", "region_id"], DecodingError, "a line was recognised twice")
    missing = regions.select("page_id", "region_id").join(texts.select("page_id", "region_id").hint("merge"), ["page_id", "region_id"], "left_anti")
    require_empty(missing, DecodingError, "a line was not recognised")
    assembled = assemble_pages(texts, ["page_id"])
    zero = F.lit(0).cast("bigint")
    whole = pages.select("page_id", "page_index").join(assembled.hint("merge"), "page_id", "left")
    return whole.select(
        "page_id", "page_index", F.coalesce("page_text", F.lit("")).alias("page_text"),
        F.coalesce("lines", zero).alias("lines"), F.coalesce("failed_lines", zero).alias("failed_lines"),
    ), texts


def load_pages(spark: SparkSession, path: str, renderer: PageRenderer | None = None, limits: InputLimitsConfig = InputLimitsConfig(), dpi: int | None = None) -> DataFrame:
    """(document, page_id, page_index, image) of all documents below a folder; image files have one page.

    Fails on the first file that is too large, of no supported kind, undecodable, or beyond a limit of
    pages or pixels; PDF files need a renderer.
    """
    scanned = scan_documents(spark, path, limits.max_input_bytes)
    require_empty(scanned.where("issue is not null").select("document", "issue"), DocumentError, "document refused")
    kinds = materialize(scanned.select("document", "kind"), "documents")
    images = scan_images(spark, path).join(kinds.where("kind <> 'pdf'"), "document")
    require_empty(images.where("issue is not null").select("document", "issue"), DocumentError, "image does not decode")
    pages = images.select("document", F.lit(0).alias("page_index"), F.struct(*[F.col(f"image.{n}").alias(n) for n in ("height", "width", "nChannels", "data")]).alias("image"))
    if not kinds.where("kind = 'pdf'").isEmpty():
        if renderer is None:
            raise DocumentError("PDF documents need a renderer")
        rendered = materialize(pdf_pages(scanned, renderer, limits.default_pdf_dpi if dpi is None else dpi), "pages")
        require_empty(rendered.where("issue is not null").select("document", "issue"), DocumentError, "document refused")
        image = F.struct("height", "width", F.col("channels").alias("nChannels"), "data")
        pages = pages.unionByName(rendered.select("document", "page_index", image.alias("image")))
    sizes = pages.select("document", "page_index", "image.width", "image.height")
    require_empty(page_limits(sizes).where("issue is not null").select("document", "page_index", "issue"), DocumentError, "page beyond a limit")
    return pages.withColumn("page_id", F.concat_ws("#", "document", "page_index"))


def recognize_documents(
    spark: SparkSession,
    path: str,
    load: Callable[[], Recognizer],
    vocabulary: list[str],
    renderer: PageRenderer | None = None,
    limits: InputLimitsConfig = InputLimitsConfig(),
    preprocessing: PreprocessingConfig = PreprocessingConfig(),
    segmentation: SegmentationConfig = SegmentationConfig(),
    inference: InferenceConfig = InferenceConfig(),
) -> DataFrame:
    """(document, document_text, pages) of all documents below a folder."""
    pages = load_pages(spark, path, renderer, limits)
    texts, _ = recognize_pages(pages.select("page_id", "page_index", "image"), load, vocabulary, preprocessing, segmentation, inference)
    named = pages.select("page_id", "document").join(texts.hint("merge"), "page_id")
    require_contiguous(named, ["document"], "page_index")
    return assemble_documents(named, "document", "page_index")
