"""How often every distinct term occurs, and in how many records.

Heavy-light aggregation. A few terms make up most occurrences of natural text; shuffling them is
waste and skews the aggregation. They are found first on a bounded sample of records, broadcast,
and counted by every task in exact local arrays, of which one row per task and term leaves the
task. Only the remaining, light terms are shuffled, counted per batch beforehand. The union of
both tables is exact whatever the sample found: a heavy term that was missed is a light one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the heavy part: terms broadcast at most, records of the detection sample, least share of what those terms add up to.
HEAVY_TERMS = 2048
SAMPLE_RECORDS = 100_000
HEAVY_SHARE = 0.0005
_COUNTS = "term string, occurrences bigint, records bigint, heavy boolean"


def nfc_terms(text: str | None) -> list[str]:
    """Pieces of the NFC text between blanks, as of ``str.isspace``."""
    if not text:
        return []
    return (text if text.isascii() else unicodedata.normalize("NFC", text)).split()


def _parts(batch: pa.RecordBatch, tokenize: Callable[[str | None], list[str]] | None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Flat terms of a batch with their row, weight and whether the row counts as a record."""
    if tokenize is not None:  # whole texts, however long
        lists = [tokenize(t) for t in batch.column("term").to_pylist()]
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        terms = pa.array([t for one in lists for t in one], type=pa.string())
        rows = np.repeat(np.arange(len(lists)), sizes)
    else:
        terms = batch.column("term").cast(pa.string())
        rows = np.arange(batch.num_rows)
    weight = batch.column("weight").to_numpy(zero_copy_only=False)[rows]
    counted = batch.column("counted").to_numpy(zero_copy_only=False)[rows]
    return terms, rows, weight, counted


def _tally(terms: pa.Array, rows: np.ndarray, weight: np.ndarray, counted: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    encoded = terms.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(encoded.dictionary)
    occurrences = np.zeros(n, dtype=np.int64)
    np.add.at(occurrences, codes, weight)
    pairs = np.unique(rows[counted] * n + codes[counted]) if n else rows
    return encoded.dictionary, occurrences, np.bincount(pairs % max(n, 1), minlength=n).astype(np.int64)


def term_frequencies(
    df: DataFrame,
    term: Column,
    tokenize: Callable[[str | None], list[str]] | None = None,
    weight: Column | None = None,
    counted: Column | None = None,
    detect_in: DataFrame | None = None,
    heavy_terms: int = HEAVY_TERMS,
) -> DataFrame:
    """(term, occurrences, records) over all rows of ``df``.

    term      the term of a row, or the text that ``tokenize`` cuts into terms
    weight    occurrences that each term of the row stands for (default 1)
    counted   whether the row counts as a record (default true); one row is one record
    detect_in a cheaper frame with the same columns to find the heavy terms in (default ``df``)
    Null terms and null texts count for nothing; an empty table gives an empty result. Only the
    named columns are read, so clashing extra columns do no harm.
    """

    def shaped(frame: DataFrame) -> DataFrame:
        return frame.select(
            term.alias("term"),
            (F.lit(1) if weight is None else weight).cast("bigint").alias("weight"),
            (F.lit(True) if counted is None else counted).alias("counted"),
        ).where(F.col("term").isNotNull())

    def count(heavy: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pa.array(heavy.value, type=pa.string())
            occurred, held = np.zeros(len(known), dtype=np.int64), np.zeros(len(known), dtype=np.int64)
            for batch in batches:
                found, occurrences, records = _tally(*_parts(batch, tokenize))
                place = pc.index_in(found, value_set=known)
                light = place.is_null().to_numpy(zero_copy_only=False)
                at = place.fill_null(0).to_numpy(zero_copy_only=False)[~light]
                occurred[at] += occurrences[~light]
                held[at] += records[~light]
                keep = pa.array(np.flatnonzero(light))
                yield pa.RecordBatch.from_arrays(
                    [found.take(keep), pa.array(occurrences[light]), pa.array(records[light]), pa.array(np.zeros(len(keep), dtype=bool))],
                    names=["term", "occurrences", "records", "heavy"],
                )
            used = np.flatnonzero(occurred)
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [known.take(pa.array(used)), pa.array(occurred[used]), pa.array(held[used]), pa.array(np.ones(len(used), dtype=bool))],
                    names=["term", "occurrences", "records", "heavy"],
                )

        return run

    share = df.sparkSession.sparkContext.broadcast
    detect = df if detect_in is None else detect_in
    fraction = min(1.0, SAMPLE_RECORDS / max(detect.count(), 1))
    sample = shaped(detect.sample(fraction=fraction, seed=17) if fraction < 1 else detect)
    seen = sample.mapInArrow(count(share([])), _COUNTS).groupBy("term").agg(F.sum("occurrences").alias("n"))
    top = seen.orderBy(F.desc("n"), "term").limit(heavy_terms).collect()
    least = HEAVY_SHARE * sum(r.n for r in top)
    heavy = [r.term for r in top if r.n >= least]
    counts = shaped(df).mapInArrow(count(share(heavy)), _COUNTS)
    return counts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def manifest_terms(manifest: DataFrame) -> DataFrame:
    """Words of the manifest's texts, every sample_id taken once (its earliest row; a null id is none)."""
    once = manifest.where("sample_id is not null").groupBy("sample_id").agg(F.min_by("text", "record_id").alias("text"))
    return term_frequencies(once, F.col("text"), tokenize=nfc_terms, detect_in=manifest)


def error_terms(errors: DataFrame) -> DataFrame:
    """Characters of error reports, weighted by their count.

    Rows with a null or empty character or a count null or below 1 do not count; rows equal in
    report_id, op, character and count count once. A null report_id is no report.
    """
    usable = errors.where("character is not null and character <> '' and count >= 1")
    once = usable.select("report_id", "op", "character", "count").distinct()
    per_report = once.groupBy("report_id", "character").agg(F.sum("count").alias("n"))
    return term_frequencies(per_report, F.col("character"), weight=F.col("n"), counted=F.col("report_id").isNotNull())


def marked_terms(manifest: DataFrame, errors: DataFrame) -> DataFrame:
    """All terms of both fields with their counts and a mark: rare, common or null.

    manifest.text             rare in at most 2 samples, common in more than 5 % of all sample_ids
    error_analysis.character  rare if the counts sum to less than 5, else common in more than half
                              of all report_ids of the table
    """
    samples = manifest.agg(F.countDistinct("sample_id")).head()[0]
    reports = errors.agg(F.countDistinct("report_id")).head()[0]
    few, often = F.col("records") <= 2, F.col("records") * 20 > F.lit(samples)
    text = manifest_terms(manifest).select(
        F.lit("manifest.text").alias("field"), "*", F.when(few, "rare").when(often, "common").alias("mark")
    )
    few, often = F.col("occurrences") < 5, F.col("records") * 2 > F.lit(reports)
    character = error_terms(errors).select(
        F.lit("error_analysis.character").alias("field"), "*", F.when(few, "rare").when(often, "common").alias("mark")
    )
    return text.unionByName(character)
