"""Dataset validation: rules per row, rules per group, statistics, one ordered report."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sutur.functions.fingerprints import dataset_fingerprint
from sutur.functions.paths import portable_path
from sutur.functions.text import characters, code_point_label, is_blank, issue_codes, nfc, words
from sutur.session import materialize

# Thresholds that make a sample worth a look, and messages of the issue codes.
UNUSUAL_TEXT_LENGTH = 512
UNUSUAL_WIDTH = 4096
UNUSUAL_ASPECT = 50.0
MINIMUM_DIMENSION = 4
MESSAGES = {
    "empty_text": "transcription must not be empty",
    "invalid_text_control": "transcription contains a forbidden control character",
    "non_nfc_text": "transcription is not Unicode NFC",
    "leading_or_trailing_whitespace": "transcription has leading or trailing whitespace",
    "noncanonical_whitespace": "transcription whitespace is not canonical single ASCII space",
    "unusually_long_text": "transcription exceeds the review-length threshold",
    "duplicate_sample_id": "sample_id must be unique",
    "duplicate_image_path": "image_path is referenced by more than one sample",
    "duplicate_image": "image bytes duplicate another sample",
    "duplicate_pair": "image and transcription duplicate another sample",
    "conflicting_image_text": "identical image bytes have conflicting transcriptions",
    "unusual_dimensions": "line image dimensions deserve manual review",
    "missing_image": "image file is missing",
    "unsupported_image_format": "line image must decode as PNG or JPEG",
    "image_too_large": "line image exceeds the supported byte-size bound",
    "invalid_dimensions": "line image dimensions exceed the supported bounds",
    "unreadable_image": "line image could not be decoded safely",
    "invalid_path": "image path resolves outside the dataset root",
}
ERRORS = (
    "empty_text", "invalid_text_control", "non_nfc_text", "leading_or_trailing_whitespace", "noncanonical_whitespace",
    "duplicate_sample_id", "conflicting_image_text", "missing_image", "unsupported_image_format", "image_too_large",
    "invalid_dimensions", "unreadable_image", "invalid_path",
)
IMAGE_ERRORS = (
    "invalid_path", "missing_image", "not_regular_file", "unreadable_image", "unsupported_image_format", "image_too_large", "invalid_dimensions",
)
_BY_IMAGE = ("duplicate_image", "duplicate_pair")
_IDENTITY = ("sample_id", "image_path", "document_id", "text")


def text_issue_codes(samples: DataFrame) -> DataFrame:
    """Adds ``codes``: the text policy's issue codes and ``unusually_long_text``."""
    text = F.col("text")
    long = F.when(F.char_length(text) > UNUSUAL_TEXT_LENGTH, F.array(F.lit("unusually_long_text"))).otherwise(F.array().cast("array<string>"))
    return samples.withColumn("_nfc", nfc(text)).withColumn("codes", F.concat(issue_codes(text, F.col("_nfc")), long)).drop("_nfc")


def text_issues(samples: DataFrame) -> DataFrame:
    """(code, sample_id): one row per issue of a text."""
    return text_issue_codes(samples).select(F.explode("codes").alias("code"), "sample_id")


def unsupported_characters(samples: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(code, sample_id, message) of texts with characters outside the vocabulary, named by code point."""
    per_text = samples.select("sample_id", *[c for c in _IDENTITY if c != "sample_id"]).distinct()
    found = per_text.select("sample_id", "text", F.explode(F.array_distinct(characters(F.col("text")))).alias("ch"))
    outside = found.join(F.broadcast(vocabulary.select("ch")), "ch", "left_anti")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ch", code_point_label(F.col("ch")).alias("name")))), lambda s: s["name"]), ",")
    message = F.concat(F.lit("transcription contains characters outside the vocabulary: "), names)
    return outside.groupBy("sample_id", "text").agg(message.alias("message")).select(F.lit("unsupported_character").alias("code"), "sample_id", "message")


def duplicate_issues(samples: DataFrame, digest: str | None = "digest") -> DataFrame:
    """(code, sample_id) of repeated ids, paths, images and pairs, and of images with conflicting texts.

    Of every key, all rows but the first in identity order are duplicates; rows that agree in all of
    the identity count each. Only rows with a digest take part in the image rules. Conflicts flag
    every row of the digest. The rows are written out once; a key that holds many of them is only
    ever counted, as all its rows less its smallest identity, never ranked.
    """
    hashed = F.col(digest) if digest is not None else F.lit(None).cast("string")
    rows = materialize(samples.select(*_IDENTITY, hashed.alias("digest")), "identities")
    keys = [("duplicate_sample_id", F.col("sample_id"), None), ("duplicate_image_path", F.col("image_path"), None)]
    if digest is not None:
        keys += [("duplicate_image", F.col("digest"), None), ("duplicate_pair", F.col("digest"), F.col("text"))]
    none = F.lit(None).cast("string")
    taking_part = F.filter(
        F.array(*[
            F.struct(F.lit(code).alias("code"), one.alias("one"), (none if two is None else two).alias("two"), (F.lit(code not in _BY_IMAGE) | F.col("digest").isNotNull()).alias("counts"))
            for code, one, two in keys
        ]),
        lambda k: k["counts"],
    )
    keyed = rows.select(F.explode(taking_part).alias("k"), F.struct(*_IDENTITY).alias("identity"))
    firsts = keyed.groupBy("k").agg(F.min("identity").alias("identity"))
    counted = keyed.select("k.code", "identity.sample_id", F.lit(1).alias("n")).unionByName(firsts.select("k.code", "identity.sample_id", F.lit(-1).alias("n")))
    later = counted.groupBy("code", "sample_id").agg(F.sum("n").cast("int").alias("n")).where("n > 0")
    found = later.select("code", "sample_id", F.explode(F.array_repeat(F.lit(True), F.col("n")))).select("code", "sample_id")
    if digest is None:
        return found
    several = rows.where("digest is not null").groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("digest")
    conflicts = rows.join(several, "digest", "left_semi").select(F.lit("conflicting_image_text").alias("code"), "sample_id")
    return found.unionByName(conflicts)


def dimension_issues(samples: DataFrame) -> DataFrame:
    """(code, sample_id) of image sizes worth a look; rows without a size have none."""
    w, h = F.col("image_width"), F.col("image_height")
    odd = (F.least(w, h) < MINIMUM_DIMENSION) | (w > UNUSUAL_WIDTH) | (F.greatest(F.try_divide(w, h), F.try_divide(h, w)) > UNUSUAL_ASPECT)
    return samples.where(odd).select(F.lit("unusual_dimensions").alias("code"), "sample_id")


def with_images(samples: DataFrame, files: DataFrame) -> DataFrame:
    """Samples with what is known of their image: (image_width, image_height, digest, image_issue).

    files  path, image_width, image_height, digest, issue - one row per file below the dataset root

    A path without a portable form leads outside the root or nowhere (``invalid_path``); a portable
    one without a file is ``missing_image``. Only sound images have a size and a digest.
    """
    path = portable_path(F.col("image_path"))
    known = files.select(F.col("path").alias("_path"), "image_width", "image_height", F.when(F.col("issue").isNull(), F.col("digest")).alias("digest"), "issue", F.lit(True).alias("_there"))
    joined = samples.drop("image_width", "image_height", "digest", "image_issue").withColumn("_path", path).join(known.hint("merge"), "_path", "left")
    issue = F.when(F.col("_path").isNull(), "invalid_path").when(F.col("_there").isNull(), "missing_image").otherwise(F.col("issue"))
    return joined.withColumn("image_issue", issue).drop("_path", "_there", "issue")


def image_issues(samples: DataFrame) -> DataFrame:
    """(code, sample_id) of images that are missing, misplaced, too large, of another kind, of no size or broken."""
    return samples.where("image_issue is not null").select(F.col("image_issue").alias("code"), "sample_id")


def image_statistics(samples: DataFrame) -> DataFrame:
    """One row: summaries of width and height of the sound images, and samples whose image fails."""
    return samples.agg(*summary(F.col("image_width"), "width"), *summary(F.col("image_height"), "height"), F.countDistinct(F.when(F.col("image_issue").isin(*IMAGE_ERRORS), F.col("sample_id"))).alias("failing_images"))


def validate_dataset(samples: DataFrame, files: DataFrame | None = None, vocabulary: DataFrame | None = None) -> dict[str, DataFrame | str | bool]:
    """The whole report: issues, statistics, character frequencies, dataset fingerprint, and whether there is no error.

    With ``files`` (see with_images) the images are looked at too.
    """
    placed = materialize(samples if files is None else with_images(samples, files), "validated")
    issues = validation_report(placed, vocabulary, None if files is None else "digest")
    statistics = dataset_statistics(placed)
    if files is not None:
        issues = issues.unionByName(with_messages(image_issues(placed))).orderBy("severity", "code", "sample_id", "message")
        statistics = statistics.join(F.broadcast(image_statistics(placed)))
    issues = materialize(issues, "issues").orderBy("severity", "code", "sample_id", "message")
    return {
        "issues": issues,
        "statistics": statistics,
        "character_frequency": character_frequency(placed),
        "fingerprint": dataset_fingerprint(placed),
        "valid": issues.where("severity = 'error'").isEmpty(),
    }


def with_messages(issues: DataFrame) -> DataFrame:
    """Adds severity and message to (code, sample_id) rows."""
    table = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    message = F.element_at(table, F.col("code")) if "message" not in issues.columns else F.col("message")
    severity = F.when(F.col("code").isin(*ERRORS), "error").otherwise("warning")
    return issues.select("code", severity.alias("severity"), message.alias("message"), "sample_id")


def validation_report(samples: DataFrame, vocabulary: DataFrame | None = None, digest: str | None = "digest") -> DataFrame:
    """All issues (code, severity, message, sample_id), ordered by severity, code, sample_id, message."""
    issues = with_messages(text_issues(samples).unionByName(duplicate_issues(samples, digest)))
    if {"image_width", "image_height"} <= set(samples.columns):
        issues = issues.unionByName(with_messages(dimension_issues(samples)))
    if vocabulary is not None:
        issues = issues.unionByName(with_messages(unsupported_characters(samples, vocabulary)))
    return issues.orderBy("severity", "code", "sample_id", "message")


def summary(value: Column, name: str) -> list[Column]:
    """(min, exact median, max) of a column; all null over nothing."""
    return [F.min(value).alias(f"{name}_min"), F.median(value).alias(f"{name}_median"), F.max(value).alias(f"{name}_max")]


def dataset_statistics(samples: DataFrame) -> DataFrame:
    """One row of corpus statistics; an empty corpus gives zero counts and null summaries."""
    text = F.col("text")
    flat = samples.agg(
        F.count(F.lit(1)).alias("samples"),
        F.countDistinct("document_id").alias("documents"),
        F.count_if(is_blank(text)).alias("empty_texts"),
        *summary(F.char_length(text), "characters"),
        *summary(F.size(words(text)), "words"),
    )
    per_document = samples.groupBy("document_id").count().agg(*summary(F.col("count"), "samples_per_document"))
    distinct = samples.select(F.explode(characters(text)).alias("ch")).distinct().agg(F.count(F.lit(1)).alias("distinct_characters"))
    return flat.join(F.broadcast(per_document)).join(F.broadcast(distinct))


def character_frequency(texts: DataFrame, column: str = "text") -> DataFrame:
    """(ch, n) of all code points; counted before the shuffle, at most one row per code point comes out."""
    return texts.select(F.explode(characters(F.col(column))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


def text_source_report(sources: DataFrame) -> tuple[dict[str, object], DataFrame]:
    """({phrase_count, all_nfc, unique_character_count, source_set_fingerprint}, character frequency with code points).

    sources  any columns with ``text``; the fingerprint is over the canonical JSON list of the rows in
    order of their lines. Null texts count as empty.
    """
    text = F.coalesce("text", F.lit(""))
    frequency = character_frequency(sources.select(text.alias("text"))).select("ch", code_point_label(F.col("ch")).alias("code_point"), "n")
    flat = sources.select(text.alias("text"), nfc(text).alias("_nfc")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("text") == F.col("_nfc")).alias("nfc")).head()
    lines = sources.select(F.to_json(F.struct(*sorted(sources.columns))).alias("line")).orderBy("line")
    digest = hashlib.sha256(b"[")
    for number, row in enumerate(lines.toLocalIterator(prefetchPartitions=True)):
        digest.update((b"," if number else b"") + row.line.encode("utf-8"))
    digest.update(b"]")
    report = {"phrase_count": flat.n, "all_nfc": bool(flat.nfc) if flat.n else True, "unique_character_count": frequency.count(), "source_set_fingerprint": digest.hexdigest()}
    return report, frequency
