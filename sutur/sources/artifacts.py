"""Files with their sizes and hashes: building and verifying artifact manifests."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sutur.errors import BenchmarkError
from sutur.functions.numbers import MAX_BYTES, MAX_PAGE_PIXELS, file_kind
from sutur.functions.paths import path_below
from sutur.guards import require_empty


def scan_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path relative to root, size_bytes, content) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(path_below(F.col("path"), root).alias("path"), F.col("length").alias("size_bytes"), "content")


def artifact_manifest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, sha256) of all files, hashed where they are read."""
    return scan_files(spark, root, pattern).select("path", "size_bytes", F.sha2("content", 256).alias("sha256")).orderBy("path")


def inspect_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, size_bytes, kind, issue): kind by content; files over the limit are refused by length alone."""
    files = scan_files(spark, root)
    kind = F.when(F.col("size_bytes") <= max_bytes, file_kind(F.col("content")))
    issue = F.when(F.col("size_bytes") > max_bytes, "image_too_large").when(kind.isNull(), "unsupported_image_format")
    return files.select("path", "size_bytes", kind.alias("kind"), issue.alias("issue"))


def _png_size(content: bytes) -> tuple[int, int]:
    """Width and height of a PNG file whose chunks are whole; ValueError otherwise."""
    at, size, ended = 8, None, False
    while at + 12 <= len(content) and not ended:
        length, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 4 : at + 8 + length]
        if len(body) != length + 4 or zlib.crc32(body) != int.from_bytes(content[at + 8 + length : at + 12 + length], "big"):
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[4:12])
        ended = kind == b"IEND"
        at += 12 + length
    if size is None or not ended:
        raise ValueError("no header or no end")
    return size


def _jpeg_size(content: bytes) -> tuple[int, int]:
    """Width and height of a JPEG file by its frame header; ValueError without one or without an end."""
    at = 2
    while at + 9 < len(content) and content[at] == 0xFF:
        marker, length = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if marker == 0xFF:
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", content[at + 5 : at + 9])
            if b"\xff\xd9" not in content[-64:]:
                raise ValueError("no end")
            return width, height
        elif length < 2:
            break
        else:
            at += 2 + length
    raise ValueError("no frame header")


def image_facts(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, max_pixels: int = MAX_PAGE_PIXELS) -> DataFrame:
    """(path, image_width, image_height, digest, issue) of all files below a folder.

    The checks go by length, content kind, structure (chunks and their checksums, frame header and
    end) and pixels, in this order; the first that fails is the issue, and only sound files have a
    size. Content beyond the length limit is not looked at.
    """
    files = scan_files(spark, root).withColumn("content", F.when(F.col("size_bytes") <= max_bytes, F.col("content")))
    kinds = files.select("path", file_kind(F.col("content")).alias("kind"), F.sha2("content", 256).alias("digest"), "content")
    sizes = {"png": _png_size, "jpeg": _jpeg_size}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, content in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                width = height = None
                issue = "image_too_large" if content is None else None if kind in sizes else "unsupported_image_format"
                if issue is None:
                    try:
                        width, height = sizes[kind](content)
                        issue = "invalid_dimensions" if min(width, height) < 1 or width * height > max_pixels else None
                    except (ValueError, struct.error):
                        issue = "unreadable_image"
                rows.append((width, height, issue) if issue is None else (None, None, issue))
            w, h, issues = (list(c) for c in zip(*rows)) if rows else ([], [], [])
            columns = [batch.column(0), pa.array(w, pa.int32()), pa.array(h, pa.int32()), batch.column(2), pa.array(issues, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "image_width", "image_height", "digest", "issue"])

    return kinds.mapInArrow(run, "path string, image_width int, image_height int, digest string, issue string")


def manifest_differences(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, issue) where recorded and actual files differ: missing, extra, size or hash."""
    r = recorded.select("path", F.col("size_bytes").alias("_rs"), F.col("sha256").alias("_rh"), F.lit(True).alias("_r"))
    a = actual.select("path", F.col("size_bytes").alias("_as"), F.col("sha256").alias("_ah"), F.lit(True).alias("_a"))
    issue = (
        F.when(F.col("_a").isNull(), "missing").when(F.col("_r").isNull(), "extra")
        .when(F.col("_rs").isNotNull() & (F.col("_rs") != F.col("_as")), "size").when(F.col("_rh") != F.col("_ah"), "sha256")
    )
    return r.join(a, "path", "full_outer").select("path", issue.alias("issue")).where("issue is not null")


def verify_artifacts(spark: SparkSession, root: str, recorded: DataFrame, allow_extra: bool = True) -> int:
    """Number of verified files; fails on any difference."""
    found = manifest_differences(recorded, artifact_manifest(spark, root))
    require_empty(found.where("issue <> 'extra'") if allow_extra else found, BenchmarkError, "artifact differs from its record")
    return recorded.count()
