"""Greedy document split ``group-greedy-v1``.

Documents go in order of size (largest first), then of a seeded digest, to the partition that
brings the sample counts closest to their targets. The rule is sequential, but its state is three
counts and it looks at nothing of a document but its size. So documents are sorted into ranges,
the driver runs the rule over the size histogram of the ranges to know the state at the beginning
of each, and every range is then assigned by its own task from that state. The driver sees
numbers only, never documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutur.errors import ConfigurationError, SplitError
from sutur.functions.fingerprints import canonical_json, dataset_fingerprint
from sutur.functions.numbers import resized_width, tie_digest, width_to_timesteps
from sutur.functions.sequences import is_alignable
from sutur.functions.text import characters
from sutur.guards import require_empty, require_unique
from sutur.operators.vocabulary import NORMALIZATION_POLICY
from sutur.schemas import PARTITIONS
from sutur.session import materialize, plain_strings

ALGORITHM = "group-greedy-v1"


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.8
    validation: float = 0.1
    test: float = 0.1
    seed: int = 1337

    def __post_init__(self) -> None:
        if any(not 0 <= r <= 1 for r in self.ratios) or abs(sum(self.ratios) - 1) > 1e-12 or self.train <= 0:
            raise ConfigurationError("split ratios must lie within 0..1, sum to 1 and give train a part")

    @property
    def ratios(self) -> tuple[float, float, float]:
        return self.train, self.validation, self.test


class GreedyState:
    """The rule: counts so far and targets. Deviations are added in the order of the partitions."""

    def __init__(self, total: int, ratios: tuple[float, ...], counts: Iterable[int] = (0, 0, 0)) -> None:
        self.targets = [total * r for r in ratios]
        self.eligible = [i for i, r in enumerate(ratios) if r > 0]
        self.counts = list(counts)

    def take(self, size: int) -> int:
        best, chosen = None, -1
        for i in self.eligible:
            deviation = 0.0
            for j, target in enumerate(self.targets):
                deviation += abs(self.counts[j] + (size if i == j else 0) - target)
            if best is None or deviation < best:
                best, chosen = deviation, i
        self.counts[chosen] += size
        return chosen


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    pid = context.partitionId() if context else 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([pid] * batch.num_rows, pa.int32()), *batch.columns], names=["range", *batch.schema.names])


def assign_documents(samples: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """(document_id, samples, partition), one row per document; null document_ids have none.

    Every non-null document gets a partition; an empty input gives an empty result.
    """
    sizes = samples.where("document_id is not null").groupBy("document_id").agg(F.count(F.lit(1)).alias("samples"))
    keyed = sizes.select((-F.col("samples")).alias("neg"), tie_digest(config.seed, F.col("document_id")).alias("digest"), "document_id", "samples")
    order = ["neg", "digest", "document_id"]
    schema = "range int, neg bigint, digest string, document_id string, samples bigint"
    ranged = materialize(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_ranged, schema), "documents")
    histogram = ranged.groupBy("range", "samples").agg(F.count(F.lit(1)).alias("n")).orderBy("range", F.desc("samples"))
    steps = [(r.range, r.samples, r.n) for r in histogram.collect()]  # numbers only: sizes of documents per range
    total = sum(size * n for _, size, n in steps)
    state, starts = GreedyState(total, config.ratios), {}
    for number, size, n in steps:
        starts.setdefault(number, list(state.counts))
        for _ in range(n):
            state.take(size)

    def assign(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ignore_index=True)
        own = GreedyState(total, config.ratios, starts[key[0]])
        rows["partition"] = [PARTITIONS[own.take(int(size))] for size in rows["samples"]]
        return plain_strings(rows[["document_id", "samples", "partition"]])

    return ranged.groupBy("range").applyInPandas(assign, "document_id string, samples bigint, partition string")


def split_samples(samples: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """The samples with their partition. Fails on repeated sample_ids."""
    require_unique(samples, ["sample_id"], SplitError, "duplicate sample_id")
    return samples.join(assign_documents(samples, config).select("document_id", "partition"), "document_id")


def split_counts(assigned: DataFrame) -> DataFrame:
    """Per partition: documents, samples and achieved ratio; partitions without documents have zeros."""
    spark = assigned.sparkSession
    names = spark.createDataFrame([(n, i) for i, n in enumerate(PARTITIONS)], "partition string, place int")
    held = assigned.groupBy("partition").agg(F.count(F.lit(1)).alias("documents"), F.sum("samples").alias("samples"))
    zero = F.lit(0).cast("bigint")
    joined = names.join(held, "partition", "left").select("partition", "place", F.coalesce("documents", zero).alias("documents"), F.coalesce("samples", zero).alias("samples"))
    whole = joined.agg(F.sum("samples").alias("total"))
    ratio = F.coalesce(F.try_divide(F.col("samples").cast("double"), F.col("total")), F.lit(0.0))
    return joined.join(F.broadcast(whole)).orderBy("place").select("partition", "documents", "samples", ratio.alias("ratio"))


def split_fingerprint(assigned: DataFrame, dataset_fingerprint: str, config: SplitConfig = SplitConfig()) -> str:
    """SHA-256 of the canonical split record, streamed in order of document_id."""
    head, tail = canonical_json(
        {
            "algorithm": ALGORITHM,
            "dataset_fingerprint": dataset_fingerprint,
            "document_assignments": [],
            "ratios": dict(zip(PARTITIONS, config.ratios)),
            "seed": config.seed,
        },
        newline=False,
    ).split(b'"document_assignments":[]')
    digest = hashlib.sha256(head + b'"document_assignments":[')
    first = True
    for row in assigned.select("document_id", "partition").orderBy("document_id").toLocalIterator(prefetchPartitions=True):
        digest.update(b"" if first else b",")
        digest.update(canonical_json({"document_id": row.document_id, "partition": row.partition}, newline=False))
        first = False
    digest.update(b"]" + tail)
    return digest.hexdigest()


def broken_documents(split: DataFrame) -> DataFrame:
    """Documents whose samples lie in more than one partition; a sound split has none."""
    return split.groupBy("document_id").agg(F.min("partition").alias("lo"), F.max("partition").alias("hi")).where("lo <> hi").select("document_id")


def text_overlap(split: DataFrame) -> DataFrame:
    """(a, b, texts): number of distinct texts that two partitions share."""
    texts = split.select("partition", "text").distinct()
    left, right = texts.alias("l"), texts.alias("r")
    shared = left.join(right, F.col("l.text") == F.col("r.text")).where("l.partition < r.partition")
    return shared.groupBy(F.col("l.partition").alias("a"), F.col("r.partition").alias("b")).agg(F.count(F.lit(1)).alias("texts"))


def leakage(split: DataFrame, digest: str | None = None) -> DataFrame:
    """(kind, key) of what must not be shared between train and validation.

    shared_sample, shared_document, and with a digest column conflicting_label: an image with two
    texts anywhere in the split.
    """
    train, held = split.where("partition = 'train'"), split.where("partition = 'validation'")
    found = None
    for kind, key in (("shared_sample", "sample_id"), ("shared_document", "document_id")):
        both = train.select(key).intersect(held.select(key)).select(F.lit(kind).alias("kind"), F.col(key).alias("key"))
        found = both if found is None else found.unionByName(both)
    if digest is not None:
        labels = split.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
        found = found.unionByName(labels.where("lo <> hi").select(F.lit("conflicting_label").alias("kind"), F.col(digest).alias("key")))
    return found


def split_metadata(split: DataFrame, assigned: DataFrame, dataset_fingerprint_: str, config: SplitConfig = SplitConfig()) -> dict[str, object]:
    """The record of a split: request, result, every assignment, fingerprints, and the hash of every partition's manifest.

    The assignments of all documents are part of the record, so it is as long as there are documents.
    """
    counts = {r.partition: r for r in split_counts(assigned).collect()}
    named = assigned.select("document_id", "partition").orderBy("document_id").toLocalIterator(prefetchPartitions=True)
    return {
        "schema_version": 1,
        "normalization_policy_version": NORMALIZATION_POLICY,
        "algorithm": ALGORITHM,
        "seed": config.seed,
        "requested_ratios": dict(zip(PARTITIONS, config.ratios)),
        "achieved_ratios": {n: counts[n].ratio for n in PARTITIONS},
        "achieved_sample_counts": {n: counts[n].samples for n in PARTITIONS},
        "achieved_document_counts": {n: counts[n].documents for n in PARTITIONS},
        "document_assignments": [{"document_id": r.document_id, "partition": r.partition} for r in named],
        "dataset_fingerprint": dataset_fingerprint_,
        "split_fingerprint": split_fingerprint(assigned, dataset_fingerprint_, config),
        "output_sha256": {f"{n}.jsonl": dataset_fingerprint(split.where(F.col("partition") == n)) for n in PARTITIONS},
    }


def training_preflight(split: DataFrame, vocabulary: DataFrame, width: str = "image_width", height: str = "image_height", digest: str = "digest") -> dict[str, object]:
    """Fail unless train and validation can be trained on; gives their counts and fingerprints.

    Both must hold samples and share no sample, no document; an image may have one text only; every
    character must be in the vocabulary (idx, ch); and a line must have as many frames as its text
    needs. An image without a known or usable size fails.
    """
    rows = materialize(split.where("partition in ('train', 'validation')"), "preflight")
    sizes = {r.partition: r.n for r in rows.groupBy("partition").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(sizes.get(n, 0) for n in ("train", "validation")) == 0:
        raise SplitError("train and validation must hold samples")
    require_empty(leakage(rows, digest), SplitError, "train and validation are not apart")
    unknown = rows.select("sample_id", F.explode(F.array_distinct(characters(F.col("text")))).alias("ch")).join(F.broadcast(vocabulary.select("ch")), "ch", "left_anti")
    require_empty(unknown.select("sample_id", "ch"), SplitError, "a character is not in the vocabulary")
    frames = width_to_timesteps(resized_width(F.col(width), F.col(height)))
    short = rows.where(~F.coalesce(is_alignable(characters(F.col("text")), frames), F.lit(False)))
    require_empty(short.select("partition", "sample_id"), SplitError, "a text does not fit the frames of its line")
    part = lambda n: rows.where(F.col("partition") == n)
    return {n: {"samples": sizes[n], "fingerprint": dataset_fingerprint(part(n))} for n in ("train", "validation")}


def batches(samples: DataFrame, size: int, seed: int | None = None) -> DataFrame:
    """Adds ``batch bigint``: rows in order of sample_id, or of a seeded digest of it, in runs of ``size``; the last may be short.

    The place of a row comes from counts of the ranges before it, so no task sees more than its own range.
    """
    key = F.col("sample_id") if seed is None else tie_digest(seed, F.col("sample_id"))
    keyed = samples.withColumn("_order", key).repartitionByRange("_order", "sample_id").sortWithinPartitions("_order", "sample_id")
    numbered = materialize(keyed.withColumn("_place", F.monotonically_increasing_id()), "ordered").withColumn("_range", F.shiftright("_place", 33))
    sizes = sorted((r._range, r.n) for r in numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for number, n in sizes:
        starts.append((number, before))
        before += n
    spark = samples.sparkSession
    offsets = spark.createDataFrame(starts, "_range bigint, _start bigint")  # one row per task
    place = F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(F.broadcast(offsets), "_range").withColumn("batch", F.floor(place / size).cast("bigint")).drop("_order", "_place", "_range", "_start")
