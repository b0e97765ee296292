"""Generated pages and texts, logical cases, recorded scores, frame alignment, text sources."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sutur.errors import BenchmarkError, EvaluationError
from sutur.functions.sequences import alignment_issue
from sutur.operators import evaluation, regions, validation
from sutur.sources import synthetic


def test_page_placements(spark):
    pages = spark.createDataFrame([(f, f) for f in synthetic.PLACEMENTS], "layout_family string, page string")
    found = synthetic.page_placements(pages).orderBy("page", "reading_order_index").collect()
    sizes = {f: sum(r.page == f for r in found) for f in synthetic.PLACEMENTS}
    assert sizes == {"one_column": 5, "mild_skew": 5, "one_column_wide": 4, "balanced_two_column": 8, "uneven_two_column": 7, "spanning_top": 7, "spanning_middle": 9, "spanning_footer": 7, "blank": 0, "near_blank": 0}
    middle = [(r.left, r.right, r.y, r.region_kind, r.column_index) for r in found if r.page == "spanning_middle"]
    assert middle[0] == (550, 936, 70, "line", 0) and middle[2] == (64, 450, 70, "line", 1) and middle[4] == (64, 936, 485, "spanning", None)
    with pytest.raises(BenchmarkError):
        synthetic.page_placements(pages.limit(1).withColumn("layout_family", F.lit("three_column")))


def test_names_and_numbers_of_generated_rows(spark):
    lines = synthetic.synthetic_lines(spark, 5, ["x"], line_prefix="syn-line-", document_prefix="synthetic-document-", document_digits=6).orderBy("sample_id").collect()
    assert (lines[4].sample_id, lines[4].document_id) == ("syn-line-000005", "synthetic-document-000002")
    texts = synthetic.composed_texts(spark, 1, ["a {ascii_number}", "b {urdu_number}"], width=3).orderBy("template").collect()
    assert [r.text for r in texts] == ["a 001", "b ۰۰۲"]


def test_logical_cases(spark):
    box = "struct<x:int,y:int,width:int,height:int>"
    ddl = f"page_id string, case_family string, layout_family string, expected_layout string, expected_blank boolean, generator_seed bigint, image_sha256 string, regions array<struct<region_id:string,bounding_box:{box},column_index:int,reading_order_index:int,region_kind:string>>"
    rows = [("p1", "c", "l", "e", False, 7, "h", [("r", (1, 2, 3, 4), None, 0, "line"), None, ("s", None, 1, 1, None)]), ("p2", None, "l", "e", True, None, None, None)]
    found = {r.page_id: r.value for r in regions.logical_cases(spark.createDataFrame(rows, ddl)).collect()}
    want = {
        "case_family": "c", "expected_blank": False, "expected_layout": "e", "expected_line_count": 2, "generator_seed": 7, "image_sha256": "h", "layout_family": "l", "page_id": "p1",
        "regions": [{"bounding_box": {"height": 4, "width": 3, "x": 1, "y": 2}, "column_index": None, "reading_order_index": 0, "region_id": "r", "region_kind": "line"},
                    {"bounding_box": None, "column_index": 1, "reading_order_index": 1, "region_id": "s", "region_kind": None}],
    }
    assert found["p1"] == json.dumps(want, separators=(",", ":"), sort_keys=True)
    assert json.loads(found["p2"])["regions"] == [] and json.loads(found["p2"])["expected_line_count"] == 0


def test_recorded_scores(spark):
    pairs = spark.createDataFrame([("a", "abc", "abd"), ("b", "x y", "x"), ("c", "", "z"), ("d", None, None)], "sample_id string, reference string, hypothesis string")
    recorded = evaluation.score(pairs)
    assert evaluation.verify_scores(recorded) == 4
    wrong = recorded.withColumn("word_error_rate", F.when(F.col("sample_id") == "b", 0.25).otherwise(F.col("word_error_rate")))
    assert [tuple(r) for r in evaluation.changed_scores(wrong).collect()] == [("b", "word_error_rate")]
    with pytest.raises(EvaluationError):
        evaluation.verify_scores(wrong)


def test_alignment_issues(spark):
    rows = [([1, 1], 3), ([1, 1], 2), ([], 5), (None, 5), ([1], 0), ([1], None), ([1, 0], 5), ([1, None], 5), ([9], 5), ([1], 50), ([1, 2], 2)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, target array<int>, frames int")
    found = [r.issue for r in df.orderBy("i").select(alignment_issue(F.col("target"), F.col("frames"), 5, 40).alias("issue")).collect()]
    assert found == [None, "too_few_frames", "empty_target", "empty_target", "no_frames", "no_frames", "blank_in_target", "blank_in_target", "unknown_class", "too_many_frames", None]
    assert df.where("i = 9").select(alignment_issue(F.col("target"), F.col("frames"), 5)).head()[0] is None


def test_text_sources(spark):
    report, frequency = validation.text_source_report(spark.createDataFrame([("s1", "ab"), ("s2", "é"), ("s3", None)], "id string, text string"))
    assert (report["phrase_count"], report["all_nfc"], report["unique_character_count"]) == (3, False, 4)
    assert {(r.ch, r.code_point, r.n) for r in frequency.collect()} == {("a", "U+0061", 1), ("b", "U+0062", 1), ("e", "U+0065", 1), ("́", "U+0301", 1)}
    again, _ = validation.text_source_report(spark.createDataFrame([("s3", None), ("s2", "é"), ("s1", "ab")], "id string, text string"))
    assert again["source_set_fingerprint"] == report["source_set_fingerprint"]
