"""Canonical JSON lines and content fingerprints that do not depend on row order."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of a canonical sample line, in the order they are written.
SAMPLE_FIELDS = ("document_id", "image_path", "line_index", "page_id", "sample_id", "schema_version", "tags", "text")
DECISION_FIELDS = ("note", "reviewer", "sample_id", "schema_version", "source_dataset_fingerprint", "status", "tags")


def canonical_json(value: Any, newline: bool = True) -> bytes:
    """Sorted keys, no blanks, non-ASCII kept; floats as Python prints them (driver side)."""
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    return (text + "\n" * newline).encode("utf-8")


def canonical_fingerprint(value: Any, newline: bool = True) -> str:
    return hashlib.sha256(canonical_json(value, newline)).hexdigest()


def _canonical_escapes(line: Column) -> Column:
    """Escapes of control characters with small hexadecimal letters, as canonical JSON writes them.

    Spark writes them with capital ones. Only U+000B, U+000E, U+000F and U+001A to U+001F have letters
    and no short form; an escape is told from an escaped backslash by the even number of backslashes before it.
    """
    plain = line
    for digits in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):
        line = F.regexp_replace(line, rf"(?<!\\)((?:\\\\)*)\\u00{digits}", rf"$1\\u00{digits.lower()}")
    return F.when(plain.contains("\\u00"), line).otherwise(plain)


def sample_line(columns: dict[str, Column] | None = None) -> Column:
    """One canonical JSON line of a sample; absent optional fields and empty tags vanish."""
    value = lambda n: (columns or {}).get(n, F.col(n))
    tags = F.array_sort(F.array_distinct(value("tags")))
    fields = [F.when(F.size(tags) > 0, tags).alias(n) if n == "tags" else value(n).alias(n) for n in SAMPLE_FIELDS]
    return _canonical_escapes(F.to_json(F.struct(*fields)))


def decision_line() -> Column:
    """One canonical JSON line of a review decision; tags are always written."""
    tags = F.coalesce(F.array_sort(F.array_distinct("tags")), F.array().cast("array<string>"))
    fields = [tags.alias(n) if n == "tags" else F.col(n).alias(n) for n in DECISION_FIELDS]
    return _canonical_escapes(F.to_json(F.struct(*fields)))


def ordered_fingerprint(lines: Iterable[str], ending: str = "\n") -> str:
    digest = hashlib.sha256()
    for line in lines:
        digest.update((line + ending).encode("utf-8"))
    return digest.hexdigest()


def dataset_fingerprint(samples: DataFrame) -> str:
    """SHA-256 over all canonical lines sorted by sample_id.

    One hash over one total order can't be parallel: the sort is distributed, the hash takes the
    sorted partitions one at a time, so the driver never holds more than one partition.
    """
    lines = samples.select("sample_id", sample_line().alias("line")).orderBy("sample_id", "line").select("line")
    return ordered_fingerprint(r.line for r in lines.toLocalIterator(prefetchPartitions=True))


def overlay_fingerprint(decisions: DataFrame) -> str:
    lines = decisions.select("sample_id", decision_line().alias("line")).orderBy("sample_id", "line").select("line")
    return ordered_fingerprint(r.line for r in lines.toLocalIterator(prefetchPartitions=True))


def group_fingerprints(samples: DataFrame, key: str) -> DataFrame:
    """The fingerprint of every group's samples: distributed, for change detection per document."""
    lines = samples.select(key, "sample_id", F.concat(sample_line(), F.lit("\n")).alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_id", "line"))), lambda s: s["line"]), "")
    return lines.groupBy(key).agg(F.sha2(joined, 256).alias("fingerprint"), F.count(F.lit(1)).alias("samples"))


def reference_fingerprint(references: DataFrame) -> str:
    """SHA-256 over the JSON list of [sample_id, text] sorted by sample_id."""
    digest = hashlib.sha256(b"[")
    first = True
    for row in references.select("sample_id", "text").orderBy("sample_id", "text").toLocalIterator(prefetchPartitions=True):
        digest.update((b"" if first else b",") + canonical_json([row.sample_id, row.text], newline=False))
        first = False
    digest.update(b"]")
    return digest.hexdigest()
