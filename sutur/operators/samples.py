"""Samples: one text line with its image, document and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sutur.errors import ManifestError
from sutur.functions.paths import portable_path
from sutur.functions.text import is_blank, normalize_transcription
from sutur.guards import require_all, require_unique


def contract_issues(columns: dict[str, Column] | None = None) -> Column:
    """Broken rules of the sample contract as an array of codes, in fixed order; empty if sound."""
    c = lambda n: (columns or {}).get(n, F.col(n))
    rules = [
        (c("schema_version").isNull() | (c("schema_version") != 1), "schema_version"),
        (is_blank(c("sample_id")), "sample_id"),
        (portable_path(c("image_path")).isNull(), "image_path"),
        (is_blank(c("text")), "text"),
        (is_blank(c("document_id")), "document_id"),
        (c("page_id").isNotNull() & is_blank(c("page_id")), "page_id"),
        (c("line_index") < 0, "line_index"),
        (F.exists(c("tags"), lambda t: is_blank(t)), "tags"),
    ]
    return F.filter(F.array(*[F.when(broken, F.lit(code)) for broken, code in rules]), lambda x: x.isNotNull())


def conform(samples: DataFrame) -> DataFrame:
    """Sound samples with portable path and sorted unique tags; broken ones are left out (see contract_issues)."""
    tags = F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))))
    sound = samples.where(F.size(contract_issues()) == 0)
    return sound.withColumns({"image_path": portable_path(F.col("image_path")), "tags": tags})


def require_sound(samples: DataFrame) -> None:
    """Fail on the first sample that breaks the contract, or on a repeated sample_id."""
    require_all(samples, F.size(contract_issues()) == 0, ["sample_id"], ManifestError, "sample breaks the contract")
    require_unique(samples, ["sample_id"], ManifestError, "duplicate sample_id")


def first_deliveries(manifest: DataFrame) -> DataFrame:
    """One row per sample_id: the earliest delivery (smallest record_id). Null ids are dropped."""
    columns = [c for c in manifest.columns if c not in ("sample_id", "record_id")]
    earliest = manifest.where("sample_id is not null").groupBy("sample_id").agg(F.min_by(F.struct(*columns), "record_id").alias("r"))
    return earliest.select("sample_id", "r.*")


def corpus_samples(manifest: DataFrame) -> DataFrame:
    """Sound samples of a manifest of deliveries, texts in canonical form; others are left out."""
    rows = first_deliveries(manifest.select("record_id", "schema_version", "sample_id", "image_path", "text", "document_id", "page_id", "line_index", "tags", "source"))
    canonical = rows.withColumn("text", normalize_transcription(F.col("text"))).where("text is not null")
    return conform(canonical)
