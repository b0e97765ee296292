"""Strict JSONL and JSON sources and canonical sinks.

Reading is distributed: lines are parsed in Arrow batches with a parser that sees repeated keys
and non-standard numbers, every record is checked against its contract, and broken lines come out
with a code instead of vanishing. ``read_*`` fails on the first of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sutur.errors import ManifestError, ReviewError, SuturError, VocabularyError
from sutur.functions.fingerprints import canonical_json, decision_line, sample_line
from sutur.guards import require_all, require_empty, require_unique
from sutur.operators.review import decision_issues
from sutur.operators.samples import contract_issues
from sutur.operators.vocabulary import vocabulary_record
from sutur.schemas import DECISION, SAMPLE

# Fields of the records.
SAMPLE_REQUIRED = ("schema_version", "sample_id", "image_path", "text", "document_id")
SAMPLE_OPTIONAL = ("page_id", "line_index", "tags")
DECISION_REQUIRED = ("schema_version", "sample_id", "status", "tags", "source_dataset_fingerprint")
DECISION_OPTIONAL = ("note", "reviewer")
_KINDS: dict[str, Callable[[Any], bool]] = {
    "int": lambda v: type(v) is int,
    "string": lambda v: isinstance(v, str),
    "array<string>": lambda v: isinstance(v, list) and all(isinstance(t, str) for t in v),
}


class _Refused(ValueError):
    pass


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    record = dict(pairs)
    if len(record) != len(pairs):
        raise _Refused("duplicate_key")
    return record


def _no_constant(name: str) -> None:
    raise _Refused("not_finite")


def parse_strict(text: str) -> Any:
    """JSON without repeated keys, NaN and infinities; raises ValueError otherwise."""
    return json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)


def _check(line: str, kinds: dict[str, str], required: tuple[str, ...]) -> tuple[str | None, dict[str, Any]]:
    try:
        record = parse_strict(line)
    except _Refused as error:
        return str(error), {}
    except (ValueError, RecursionError):
        return "malformed_json", {}
    if not isinstance(record, dict):
        return "not_an_object", {}
    if not set(required) <= record.keys():
        return "missing_field", {}
    if not record.keys() <= kinds.keys():
        return "unknown_field", {}
    for name, value in record.items():
        if not (value is None and name not in required) and not _KINDS[kinds[name]](value):
            return f"type_of_{name}", {}
    return None, record


def _records(spark: SparkSession, path: str, ddl: str, required: tuple[str, ...]) -> DataFrame:
    fields = dict(f.strip().split(" ", 1) for f in ddl.split(", "))
    arrow = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([("line", pa.int64()), ("issue", pa.string()), *[(n, arrow[k]) for n, k in fields.items()]])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                issue, record = _check(line, fields, required)
                rows.append({"line": number, "issue": issue, **{n: record.get(n) for n in fields}})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    numbered = _numbered_lines(spark, path).where(F.trim("value") != "")
    return numbered.mapInArrow(parse, f"line bigint, issue string, {ddl}")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): every line with its number in its file, from 1 on, blank lines counted.

    A task numbers the lines of a block of a file as they come; the lines of the blocks before it are
    added from one count per block.
    """
    spark_files = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            places = []
            for key in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen[key] = seen.get(key, 0) + 1
                places.append(seen[key])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=["value", "file", "start", "place"])

    placed = spark_files.mapInArrow(number, "value string, file string, start bigint, place bigint")
    blocks = spark_files.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("file", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return placed.join(before, ["file", "start"]).select((F.col("place") + F.col("before")).alias("line"), "value")


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Samples with the number of their line in its file and an issue code (null if sound); blank lines are skipped, not renumbered."""
    rows = _records(spark, path, SAMPLE, SAMPLE_REQUIRED)
    contract = F.get(contract_issues(), F.lit(0))
    return rows.withColumn("issue", F.coalesce("issue", contract))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a strict manifest; fails on any broken line and on repeated sample_ids."""
    rows = scan_manifest(spark, path)
    require_empty(rows.where("issue is not null").select("line", "issue"), ManifestError, "broken manifest line")
    samples = rows.drop("issue", "line")
    require_unique(samples, ["sample_id"], ManifestError, "duplicate sample_id")
    tags = F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))))
    return samples.withColumn("tags", tags)


def read_review_overlay(spark: SparkSession, path: str) -> DataFrame:
    """Decisions of a strict overlay; fails on any broken line and on repeated sample_ids."""
    rows = _records(spark, path, DECISION, DECISION_REQUIRED)
    require_empty(rows.where("issue is not null").select("line", "issue"), ReviewError, "broken overlay line")
    decisions = rows.drop("issue", "line")
    require_all(decisions, F.size(decision_issues()) == 0, ["sample_id"], ReviewError, "decision breaks the contract")
    require_unique(decisions, ["sample_id"], ReviewError, "duplicate decision")
    return decisions


def _write_lines(lines: DataFrame, path: str, overwrite: bool, single_file: bool) -> None:
    ordered = lines.orderBy("sample_id", "line").select(F.col("line").alias("value"))
    if single_file:
        ordered = ordered.coalesce(1)
    ordered.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_manifest(samples: DataFrame, path: str, overwrite: bool = False, single_file: bool = False) -> None:
    """Canonical JSONL sorted by sample_id, by default one file per range of ids. Refuses to overwrite unless asked."""
    require_unique(samples, ["sample_id"], ManifestError, "duplicate sample_id")
    _write_lines(samples.select("sample_id", sample_line().alias("line")), path, overwrite, single_file)


def write_review_overlay(decisions: DataFrame, path: str, overwrite: bool = False, single_file: bool = False) -> None:
    require_unique(decisions, ["sample_id"], ReviewError, "duplicate decision")
    _write_lines(decisions.select("sample_id", decision_line().alias("line")), path, overwrite, single_file)


def write_split_manifests(split: DataFrame, path: str, overwrite: bool = False) -> None:
    """Canonical JSONL under ``partition=...`` folders, one write for all partitions."""
    lines = split.select("partition", "sample_id", sample_line().alias("value"))
    ordered = lines.repartitionByRange("partition", "sample_id").sortWithinPartitions("partition", "sample_id", "value")
    ordered.drop("sample_id").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("partition").text(path)


def write_split_metadata(spark: SparkSession, metadata: dict[str, Any], path: str, overwrite: bool = False) -> None:
    """The record of a split (operators.splitting.split_metadata) as canonical JSON beside its manifests."""
    write_json_object(spark, metadata, path, overwrite)


def read_json_object(spark: SparkSession, path: str, error: type[SuturError] = SuturError) -> dict[str, Any]:
    """One small strict JSON object, read on the driver through Spark's file systems."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    try:
        record = parse_strict(rows[0].value) if len(rows) == 1 else None
    except ValueError as reason:
        raise error(f"malformed JSON: {reason}") from reason
    if not isinstance(record, dict):
        raise error("expected one JSON object")
    return record


def write_json_object(spark: SparkSession, value: dict[str, Any], path: str, overwrite: bool = False) -> None:
    """One small canonical JSON object as a text file."""
    text = canonical_json(value, newline=False).decode("utf-8")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def load_vocabulary(spark: SparkSession, path: str) -> list[str]:
    """Characters of a vocabulary file; fails unless order, policy and fingerprint hold."""
    record = read_json_object(spark, path, VocabularyError)
    characters = record.get("characters")
    if not isinstance(characters, list) or any(not isinstance(c, str) for c in characters):
        raise VocabularyError("vocabulary characters must be strings")
    if record != vocabulary_record(characters) or type(record["schema_version"]) is not int or type(record["blank_index"]) is not int:
        raise VocabularyError("vocabulary record does not hold what its fingerprint says")
    return characters


def save_vocabulary(spark: SparkSession, vocabulary: list[str], path: str, overwrite: bool = False) -> None:
    write_json_object(spark, vocabulary_record(vocabulary), path, overwrite)
