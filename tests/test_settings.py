"""Configurations, padded numbers, escapes of canonical lines, and what file sources do with odd files."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sutur import config
from sutur.errors import ConfigurationError, DocumentError
from sutur.functions.fingerprints import sample_line
from sutur.functions.text import urdu_number
from sutur.sources import documents, pixels, synthetic


def test_settings_are_checked():
    for kind, values in (
        (config.SegmentationConfig, {"padding_scale": -5.0}), (config.SegmentationConfig, {"line_merge_gap_scale": 1.0}), (config.SegmentationConfig, {"minimum_column_lines": 1}),
        (config.SegmentationConfig, {"component_overlap": 0.3}), (config.SegmentationConfig, {"padding_scale": True}), (config.SegmentationConfig, {"padding_scale": float("nan")}),
        (config.PreprocessingConfig, {"median_kernel_size": 4}), (config.PreprocessingConfig, {"threshold_method": "adaptive"}), (config.PreprocessingConfig, {"deskew_max_angle_degrees": 0.1}),
        (config.InputLimitsConfig, {"default_pdf_dpi": 50}), (config.InputLimitsConfig, {"max_document_pixels": 10}), (config.DatasetSplitConfig, {"train_ratio": 0.9}),
        (config.RecognizerConfig, {"blank_index": 1}), (config.InferenceConfig, {"batch_size": 0}), (config.SyntheticDataConfig, {"font_size_max": 20}), (config.SyntheticDataConfig, {"page_margin": 450}),
    ):
        with pytest.raises(ConfigurationError):
            kind.from_mapping(values)
    assert config.SegmentationConfig.from_mapping({"padding_scale": 1}).padding_scale == 1


def test_config_fingerprints():
    settings = config.SegmentationConfig()
    assert len(settings.to_dict()) == 18 and len(config.PreprocessingConfig().to_dict()) == 19
    payload = json.dumps(settings.to_dict(), sort_keys=True, separators=(",", ":")).encode()
    assert settings.fingerprint == hashlib.sha256(payload).hexdigest() and not payload.endswith(b"\n")
    assert payload.startswith(b'{"component_min_area_fraction":1e-06,"component_min_area_pixels":2,"core_min_height_scale":0.4,')
    assert settings.fingerprint != config.SegmentationConfig.from_mapping({"padding_scale": 0.3}).fingerprint


def test_escapes_of_canonical_lines(spark):
    names = [chr(c) for c in range(1, 32)] + ["\x7f", "\\u001F", "\\\x1f\x1f", "\\\\\x0b", "a\"b\\c/d"]
    rows = [(i, f"id{n}x", "a.png", n, None, None, 1, []) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "i int, sample_id string, image_path string, text string, page_id string, line_index int, schema_version int, tags array<string>")
    df = df.withColumn("document_id", F.lit("d"))
    for r in df.select("i", sample_line().alias("line")).collect():
        want = {"document_id": "d", "image_path": "a.png", "sample_id": f"id{names[r.i]}x", "schema_version": 1, "text": names[r.i]}
        assert r.line == json.dumps(want, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def test_numbers_are_never_cut(spark):
    found = spark.createDataFrame([(7,), (12345,), (-3,), (None,)], "n int").select(urdu_number(F.col("n"), 4).alias("t")).collect()
    assert [r.t for r in found] == ["۰۰۰۷", "۱۲۳۴۵", "-۰۰۰۳", None]
    lines = synthetic.synthetic_lines(spark, 50_000, ["x"])
    assert lines.select("document_id").distinct().count() == 12_500
    assert lines.groupBy("document_id").count().where("count <> 4").count() == 0
    assert synthetic.composed_texts(spark, 5000, ["a {number}", "b {number}", "c {number}"]).select("text").distinct().count() == 15_000


def test_files_of_equal_name_and_broken_images(spark, tmp_path):
    for folder in ("one", "two"):
        (tmp_path / "pdf" / folder).mkdir(parents=True)
        (tmp_path / "pdf" / folder / "scan.pdf").write_bytes(b"%PDF-1.4 " + folder.encode())
    assert {r.document for r in documents.scan_documents(spark, str(tmp_path / "pdf")).collect()} == {"one/scan.pdf", "two/scan.pdf"}
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nno image")
    assert [(r.page_id, r.issue) for r in pixels.scan_images(spark, str(tmp_path / "images")).select("page_id", "issue").collect()] == [("broken", "unreadable_image")]
    with pytest.raises(DocumentError):
        pixels.read_images(spark, str(tmp_path / "images"))


def test_line_numbers_are_those_of_the_file(spark, tmp_path):
    from sutur.sources import jsonl

    good = '{"schema_version":1,"sample_id":"s%d","image_path":"a.png","text":"t","document_id":"d"}'
    (tmp_path / "m.jsonl").write_text("\n".join(["", good % 1, "", "no json", good % 2, *[good % i for i in range(3, 400)]]) + "\n", encoding="utf-8")
    whole = {r.line: (r.sample_id, r.issue) for r in jsonl.scan_manifest(spark, str(tmp_path / "m.jsonl")).collect()}
    assert whole[2] == ("s1", None) and whole[4] == (None, "malformed_json") and whole[5] == ("s2", None) and whole[402] == ("s399", None) and 1 not in whole
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        cut = {r.line: (r.sample_id, r.issue) for r in jsonl.scan_manifest(spark, str(tmp_path / "m.jsonl")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert cut == whole


def test_sql_counterparts_without_known_differences(spark, sf_dir):
    """As test_sql_counterparts, for all queries but the three whose SQL is known to do less (see README)."""
    import os
    from collections import Counter

    import duckdb
    from test_sources import _plain

    from sutur.plans import catalogue

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view \"{name.split('.')[0]}\" as select * from '{sf_dir}/{name}'")
    queries, sql = catalogue.queries(), catalogue.oracle_sql()
    for name in sorted(set(sql) - {"q28_corpus_result", "q28b_page_results", "q30_text_scale"}):
        df = queries[name](spark, sf_dir)
        columns = sorted(df.columns)
        rows = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
        found = con.sql(sql[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns, name
        assert rows == Counter(tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), name
