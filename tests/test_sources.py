"""JSONL, artifacts, documents, generators, streaming, and all SQL counterparts on the smallest data."""

import json

import duckdb
import pytest
from pyspark.errors import AnalysisException

from sutur.errors import BenchmarkError, ConfigurationError, ManifestError, ReviewError, SuturError, VocabularyError
from sutur.operators.splitting import split_samples
from sutur.plans import catalogue
from sutur.sources import artifacts, documents, jsonl, results, synthetic
from sutur.streaming import ingest

GOOD = {"schema_version": 1, "sample_id": "b", "image_path": "a.png", "text": "متن", "document_id": "d", "tags": ["x"]}


def _file(tmp_path, *lines):
    path = tmp_path / "m.jsonl"
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines), encoding="utf-8")
    return str(path)


def test_manifest_round_trip(spark, tmp_path):
    path = _file(tmp_path, GOOD, "", GOOD | {"sample_id": "a", "line_index": 3, "tags": []})
    samples = jsonl.read_manifest(spark, path)
    assert samples.count() == 2
    out = str(tmp_path / "out")
    jsonl.write_manifest(samples, out, single_file=True)
    assert [r.value for r in spark.read.text(out).collect()][0] == '{"document_id":"d","image_path":"a.png","line_index":3,"sample_id":"a","schema_version":1,"text":"متن"}'
    with pytest.raises(AnalysisException):
        jsonl.write_manifest(samples, out)
    jsonl.write_manifest(jsonl.read_manifest(spark, out), str(tmp_path / "again"), overwrite=True)
    jsonl.write_split_manifests(split_samples(samples), str(tmp_path / "split"))
    assert spark.read.text(str(tmp_path / "split")).count() == 2


@pytest.mark.parametrize(
    ("line", "code"),
    [("{", "malformed_json"), ("[1]", "not_an_object"), ('{"schema_version":1,"schema_version":1}', "duplicate_key"), ('{"a":NaN}', "not_finite"), ({"schema_version": 1}, "missing_field"),
     (GOOD | {"odd": 1}, "unknown_field"), (GOOD | {"schema_version": True}, "type_of_schema_version"), (GOOD | {"tags": [1]}, "type_of_tags"), (GOOD | {"image_path": "/x"}, "image_path"),
     (GOOD | {"schema_version": 2}, "schema_version"), (GOOD | {"line_index": -1}, "line_index")],
)
def test_broken_lines(spark, tmp_path, line, code):
    path = _file(tmp_path, GOOD, line)
    assert [r.issue for r in jsonl.scan_manifest(spark, path).where("issue is not null").collect()] == [code]
    with pytest.raises(ManifestError):
        jsonl.read_manifest(spark, path)


def test_duplicate_ids_fail(spark, tmp_path):
    with pytest.raises(ManifestError):
        jsonl.read_manifest(spark, _file(tmp_path, GOOD, GOOD))


def test_overlay(spark, tmp_path):
    good = {"schema_version": 1, "sample_id": "a", "status": "valid", "tags": [], "source_dataset_fingerprint": "0" * 64}
    decisions = jsonl.read_review_overlay(spark, _file(tmp_path, good))
    jsonl.write_review_overlay(decisions, str(tmp_path / "o"))
    assert json.loads(spark.read.text(str(tmp_path / "o")).head().value) == good
    with pytest.raises(ReviewError):
        jsonl.read_review_overlay(spark, _file(tmp_path, good | {"status": "odd"}))


def test_vocabulary_file(spark, tmp_path):
    jsonl.save_vocabulary(spark, ["a", "ب"], str(tmp_path / "v"))
    assert jsonl.load_vocabulary(spark, str(tmp_path / "v")) == ["a", "ب"]
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"schema_version": 1, "normalization_policy_version": "nfc-v1", "blank_index": 0, "characters": ["a"], "fingerprint": "0"}))
    with pytest.raises(VocabularyError):
        jsonl.load_vocabulary(spark, str(bad))


def test_artifacts(spark, tmp_path):
    root = tmp_path / "files"
    (root / "sub").mkdir(parents=True)
    (root / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n123")
    (root / "sub" / "b.txt").write_bytes(b"text")
    recorded = spark.createDataFrame(artifacts.artifact_manifest(spark, str(root)).collect())
    assert [(r.path, r.size_bytes) for r in recorded.collect()] == [("a.png", 11), ("sub/b.txt", 4)]
    assert artifacts.verify_artifacts(spark, str(root), recorded) == 2
    assert {r.path: (r.kind, r.issue) for r in artifacts.inspect_files(spark, str(root)).collect()} == {"a.png": ("png", None), "sub/b.txt": (None, "unsupported_image_format")}
    (root / "a.png").write_bytes(b"changed")
    with pytest.raises(BenchmarkError):
        artifacts.verify_artifacts(spark, str(root), recorded)


def _renderer():
    # A local class travels to the workers by value.
    class Renderer:
        def geometry(self, content):
            if b"broken" in content:
                raise ValueError
            return [(72.0, 36.0)] * (200 if b"many" in content else 2)

        def render(self, content, page_index, dpi):
            return 2, 1, 1, bytes([page_index, 0])

    return Renderer()


def test_documents(spark, tmp_path):
    for name, data in {"a.bin": b"\0 %PDF-1.7", "b.pdf": b"%PDF- broken", "c.png": b"%PDF- many", "d.pdf": b"no", "e.pdf": b""}.items():
        (tmp_path / name).write_bytes(data)
    scanned = documents.scan_documents(spark, str(tmp_path))
    assert {r.document: r.issue for r in scanned.collect()} == {"a.bin": None, "b.pdf": None, "c.png": None, "d.pdf": "unsupported_format"}
    pages = documents.pdf_pages(scanned, _renderer())
    assert sorted((r.document, r.page_index, r.issue) for r in pages.collect() if r.issue is None) == [("a.bin", 0, None), ("a.bin", 1, None)]
    assert {r.document: r.issue for r in pages.collect() if r.issue} == {"b.pdf": "unreadable_document", "c.png": "page_count"}
    with pytest.raises(ConfigurationError):
        documents.checked_dpi(10)
    results.write_json_results(spark.createDataFrame([("x", 1)], "b string, a int"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).head().value == '{"a":1,"b":"x"}'


def test_generators(spark):
    rows = synthetic.synthetic_lines(spark, 6, ["x", "y"]).orderBy("sample_id").collect()
    assert [(r.text, r.document_id, r.line_index) for r in rows][3:5] == [("y", "document-0001", 3), ("x", "document-0002", 0)]
    assert synthetic.composed_texts(spark, 3, ["a {number}", "b {number}"]).select("text").distinct().count() == 6
    runs = spark.createDataFrame([("اب12ج",), (None,)], "t string").select(synthetic.directional_runs("t").alias("r")).collect()
    assert [(x.direction, x.text) for x in runs[0].r] == [("rtl", "ج"), ("ltr", "12"), ("rtl", "اب")] and runs[1].r == []
    assert synthetic.column_placements(spark, 2, 4, 2).count() == 8


def test_streaming(spark, sf_dir, tmp_path):
    manifest = spark.read.parquet(f"{sf_dir}/manifest.parquet")
    source = tmp_path / "in"
    manifest.write.parquet(str(source))
    stream = spark.readStream.schema(manifest.schema).parquet(str(source))
    ingest.require_streaming(stream)
    with pytest.raises(SuturError):
        ingest.refuse_streaming(stream, "split")
    query = ingest.issue_counts(stream).writeStream.outputMode("update").format("memory").queryName("issues").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    from sutur.operators.validation import text_issues

    want = {r.code: r["count"] for r in text_issues(manifest).groupBy("code").count().collect()}
    assert {r.code: r.n for r in spark.sql("select code, sum(n) as n from issues group by code").collect()} == want
    assert ingest.fresh_deliveries(stream).isStreaming and ingest.checked_stream(stream).isStreaming


def _plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return tuple(map(_plain, value)) if isinstance(value, (list, tuple)) else value


def test_sql_counterparts(spark, sf_dir):
    import os
    from collections import Counter

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view \"{name.split('.')[0]}\" as select * from '{sf_dir}/{name}'")
    queries, sql = catalogue.queries(), catalogue.oracle_sql()
    assert set(sql) <= set(queries)
    for name in sorted(queries):
        df = queries[name](spark, sf_dir)
        columns = sorted(df.columns)
        rows = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
        if name in sql:
            found = con.sql(sql[name])
            names = [d[0] for d in found.description]
            assert sorted(names) == columns, name
            want = Counter(tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
            assert rows == want, name
