"""Review overlays: decisions about samples, applied without touching the samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sutur.errors import ReviewError
from sutur.functions.fingerprints import dataset_fingerprint
from sutur.functions.text import is_blank
from sutur.guards import require_all, require_empty, require_unique
from sutur.schemas import REVIEW_STATUSES

# Forms of decision fields.
FINGERPRINT_FORM = "^[0-9a-f]{64}$"
MOST_NOTE = 240


def decision_issues() -> Column:
    """Broken rules of the decision contract as codes, in fixed order."""
    c = F.col
    rules = [
        (c("schema_version").isNull() | (c("schema_version") != 1), "schema_version"),
        (is_blank(c("sample_id")), "sample_id"),
        (c("status").isNull() | ~c("status").isin(*REVIEW_STATUSES), "status"),
        (c("source_dataset_fingerprint").isNull() | ~F.lower("source_dataset_fingerprint").rlike(FINGERPRINT_FORM), "source_dataset_fingerprint"),
        (F.exists("tags", lambda t: is_blank(t)), "tags"),
        (c("note").isNotNull() & (is_blank(c("note")) | (F.char_length("note") > MOST_NOTE) | c("note").rlike("[\\r\\n]")), "note"),
        (c("reviewer").isNotNull() & is_blank(c("reviewer")), "reviewer"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for broken, code in rules]), lambda x: x.isNotNull())


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The latest sound decision of every sample (by decided_at, then decision_id)."""
    sound = decisions.where(F.size(decision_issues()) == 0)
    columns = [c for c in decisions.columns if c != "sample_id"]
    last = sound.groupBy("sample_id").agg(F.max_by(F.struct(*columns), F.struct("decided_at", "decision_id")).alias("d"))
    return last.select("sample_id", "d.*")


def unknown_decisions(samples: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions about samples that do not exist; null ids are unknown too."""
    return decisions.join(samples.select("sample_id").distinct(), "sample_id", "left_anti")


def merge_decisions(samples: DataFrame, decisions: DataFrame, include_needs_review: bool = False) -> DataFrame:
    """Samples without the invalid ones, and without those that need review unless included.

    Samples nobody decided on stay as they are; the tags of others are united, sorted and unique.
    Each side has unique sample_ids.
    """
    own = decisions.select("sample_id", "status", F.coalesce("tags", F.array().cast("array<string>")).alias("_tags"))
    joined = samples.join(own, "sample_id", "left")
    keep = F.col("status").isNull() | (F.col("status") == "valid")
    if include_needs_review:
        keep = keep | (F.col("status") == "needs_review")
    tags = F.when(F.col("status").isNull(), F.col("tags")).otherwise(
        F.array_sort(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.col("_tags")))
    )
    return joined.where(keep).withColumn("tags", tags).drop("status", "_tags")


def apply_review_overlay(samples: DataFrame, decisions: DataFrame, include_needs_review: bool = False) -> DataFrame:
    """As ``merge_decisions``, but fails on broken or repeated decisions, unknown samples and a stale fingerprint."""
    require_all(decisions, F.size(decision_issues()) == 0, ["sample_id"], ReviewError, "decision breaks the contract")
    require_unique(decisions, ["sample_id"], ReviewError, "duplicate decision")
    require_unique(samples, ["sample_id"], ReviewError, "duplicate sample_id")
    require_empty(unknown_decisions(samples, decisions).select("sample_id"), ReviewError, "unknown sample_id")
    if decisions.limit(1).count():
        expected = dataset_fingerprint(samples)
        require_all(
            decisions, F.lower("source_dataset_fingerprint") == expected, ["sample_id"], ReviewError, "stale source fingerprint"
        )
    return merge_decisions(samples, decisions, include_needs_review)
