"""Text policy, paths, samples, splits, vocabularies, validation, review."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sutur.config import SegmentationConfig
from sutur.errors import ConfigurationError, EvaluationError, ManifestError, ReviewError
from sutur.functions.fingerprints import dataset_fingerprint, group_fingerprints, reference_fingerprint
from sutur.functions.paths import portable_path
from sutur.functions.text import alike, has_forbidden_control, is_blank, issue_codes, nfc, normalize_transcription, strip_blanks
from sutur.operators import review, splitting, validation, vocabulary
from sutur.operators.samples import conform, contract_issues, first_deliveries, require_sound
from sutur.schemas import SAMPLE


def _column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


TEXTS = [None, "", " ", "a", " a", "a ", "a  b", "a\tb", "a\n", "é", "é", "ک‌ت", "a​b", " ", "a\x00", "\x85x", "x y", "😀"]


def test_text_policy_equals_python(spark):
    control = lambda t: any(c != "‌" and unicodedata.category(c) in {"Cc", "Cf", "Cs", "Zl", "Zp"} for c in t)
    assert _column(spark, TEXTS, is_blank) == [t is None or not t.strip() for t in TEXTS]
    assert _column(spark, TEXTS, has_forbidden_control) == [None if t is None else control(t) for t in TEXTS]
    assert _column(spark, TEXTS, nfc) == [None if t is None else unicodedata.normalize("NFC", t) for t in TEXTS]
    assert _column(spark, TEXTS, strip_blanks) == [None if t is None else t.strip() for t in TEXTS]
    want = [None if t is None or control(t) or not t.split() else " ".join(unicodedata.normalize("NFC", t).split()) for t in TEXTS]
    assert _column(spark, TEXTS, normalize_transcription) == want
    codes = _column(spark, TEXTS, lambda v: issue_codes(v, nfc(v)))
    assert codes[0] == codes[1] == codes[2] == ["empty_text"]
    assert codes[4] == ["leading_or_trailing_whitespace"] and codes[6] == ["noncanonical_whitespace"]
    assert codes[8] == ["invalid_text_control", "leading_or_trailing_whitespace", "noncanonical_whitespace"] and codes[10] == ["non_nfc_text"]


def test_paths(spark):
    cases = {
        "a/b.png": "a/b.png", "a\\b": "a/b", "./a//b/./c/": "a/b/c", "/a": None, "\\a": None, "c:x": None, "a/../b": None, "..": None, ".": None,
        "./": None, "": None, "  ": None, "a\x00": None, "http://x": None, " a": " a", "..a/b": "..a/b",
    }
    assert _column(spark, list(cases), portable_path) == list(cases.values())
    assert _column(spark, [None], portable_path) == [None]


def test_alike(spark):
    assert _column(spark, ["Doc-۰۱ ", " doc-01", None], alike) == ["doc-01", "doc-01", None]


def _samples(spark, rows):
    return spark.createDataFrame([(1, i, f"images/{i}.png", t, d, None, n, ["b", "a"]) for n, (i, t, d) in enumerate(rows)], SAMPLE)


def test_locked_greedy_split(spark):
    sizes = {"a": 4, "b": 3, "c": 2, "d": 1, "e": 1, "f": 1}
    rows = [(f"{d}{i}", "x", d) for d, n in sizes.items() for i in range(n)]
    assigned = splitting.assign_documents(_samples(spark, rows))
    assert {r.document_id: r.partition for r in assigned.collect()} == {"a": "train", "b": "train", "c": "train", "d": "train", "e": "validation", "f": "test"}
    assert [r.samples for r in splitting.split_counts(assigned).collect()] == [10, 1, 1]


@pytest.mark.parametrize("sizes", [[5], [1, 1], [20, 1, 1, 1], [2] * 10, []])
def test_split_sizes(spark, sizes):
    rows = [(f"{d}-{i}", "x", f"d{d}") for d, n in enumerate(sizes) for i in range(n)]
    split = splitting.split_samples(_samples(spark, rows))
    assert split.count() == sum(sizes)
    assert splitting.broken_documents(split).count() == 0


def test_split_equals_sequential_rule_and_ignores_order(spark):
    rng = random.Random(5)
    rows = [(f"s{i}", "x", f"d{min(rng.randint(0, 60), rng.randint(0, 60))}") for i in range(400)]
    sizes = {}
    for _, _, d in rows:
        sizes[d] = sizes.get(d, 0) + 1
    import hashlib

    order = sorted(sizes, key=lambda d: (-sizes[d], hashlib.sha256(f"1337\0{d}".encode()).digest(), d))
    state = splitting.GreedyState(len(rows), (0.8, 0.1, 0.1))
    want = {d: ("train", "validation", "test")[state.take(sizes[d])] for d in order}
    for shuffled in (rows, rows[::-1]):
        found = splitting.assign_documents(_samples(spark, shuffled).repartition(7))
        assert {r.document_id: r.partition for r in found.collect()} == want
    a = splitting.split_fingerprint(found, "f")
    assert a == splitting.split_fingerprint(found.orderBy("document_id"), "f") and len(a) == 64
    with pytest.raises(ConfigurationError):
        splitting.SplitConfig(0.5, 0.1, 0.1)


def test_large_ranges(spark):
    rows = spark.range(30_000).select(F.concat(F.lit("s"), "id").alias("sample_id"), F.concat(F.lit("d"), "id").alias("document_id")).coalesce(1)
    assigned = splitting.assign_documents(rows)
    assert {r.partition: r.samples for r in splitting.split_counts(assigned).collect()} == {"train": 24_000, "validation": 3_000, "test": 3_000}


def test_leakage(spark):
    split = spark.createDataFrame([("s1", "d1", "train", "t", "h"), ("s1", "d2", "validation", "u", "h"), ("s3", "d1", "validation", "t", None)], "sample_id string, document_id string, partition string, text string, h string")
    assert {tuple(r) for r in splitting.leakage(split, "h").collect()} == {("shared_sample", "s1"), ("shared_document", "d1"), ("conflicting_label", "h")}
    assert [tuple(r) for r in splitting.text_overlap(split).collect()] == [("train", "validation", 1)]


def test_contract(spark):
    rows = [(1, "a", "p.png", "t", "d", None, 0, ["b", "a", "b"]), (2, "", "/p", " ", None, " ", -1, [""]), (None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SAMPLE)
    found = [r.c for r in df.select(contract_issues().alias("c")).collect()]
    assert found[0] == []
    assert found[1] == ["schema_version", "sample_id", "image_path", "text", "document_id", "page_id", "line_index", "tags"]
    assert found[2][:5] == found[1][:5]
    assert conform(df).head().tags == ["a", "b"]
    with pytest.raises(ManifestError):
        require_sound(df)
    manifest = spark.createDataFrame([(2, "a", "late"), (1, "a", "early"), (3, None, "x")], "record_id bigint, sample_id string, text string")
    assert [tuple(r) for r in first_deliveries(manifest).collect()] == [("a", "early")]


def test_vocabulary(spark):
    df = _samples(spark, [("a", "بابا", "d"), ("b", "😀b", "d")])
    built = vocabulary.build_vocabulary(df)
    characters = vocabulary.vocabulary_list(built)
    assert characters == sorted(set("بابا😀b"))
    assert [r.ch for r in vocabulary.unseen_characters(_samples(spark, [("c", "abz", "d")]), built).collect()] == ["a", "z"]
    encoded = vocabulary.encode_texts(df, characters)
    assert {r.sample_id: r.indices for r in encoded.collect()}["b"] == [3 if characters[2] == "😀" else characters.index("😀") + 1, characters.index("b") + 1]
    assert vocabulary.encode_texts(_samples(spark, [("c", "z", "d")]), characters, strict=False).head().indices is None
    assert vocabulary.build_vocabulary(df.limit(0)).count() == 0


def test_duplicates_and_report(spark):
    rows = [("a", "t", "d", "p", "h"), ("a", "t", "d", "p", "h"), ("b", "u", "d", "q", "h"), ("c", "", None, None, None), ("e", "x", "d", None, None)]
    df = spark.createDataFrame(rows, "sample_id string, text string, document_id string, image_path string, digest string")
    found = sorted(tuple(r) for r in validation.duplicate_issues(df).collect())
    assert found == sorted([
        ("duplicate_sample_id", "a"), ("duplicate_image_path", "a"), ("duplicate_image_path", "e"), ("duplicate_image", "a"), ("duplicate_image", "b"),
        ("duplicate_pair", "a"), ("conflicting_image_text", "a"), ("conflicting_image_text", "a"), ("conflicting_image_text", "b"),
    ])
    report = validation.validation_report(df, vocabulary=spark.createDataFrame([("t",)], "ch string"))
    kinds = [r.code for r in report.collect()]
    assert kinds[0] == "conflicting_image_text" and "unsupported_character" in kinds and "empty_text" in kinds
    assert validation.dataset_statistics(df).head().distinct_characters == 3
    empty = validation.dataset_statistics(df.limit(0)).head()
    assert empty.samples == 0 and empty.characters_median is None


def test_review(spark):
    df = _samples(spark, [("a", "t", "d"), ("b", "u", "d"), ("c", "v", "d")])
    fingerprint = dataset_fingerprint(df)
    assert fingerprint == dataset_fingerprint(df.orderBy(F.desc("sample_id")))
    schema = "schema_version int, sample_id string, status string, tags array<string>, source_dataset_fingerprint string, note string, reviewer string"
    decide = lambda *rows: spark.createDataFrame([(1, i, s, t, f, None, None) for i, s, t, f in rows], schema)
    overlay = decide(("a", "valid", ["z", "a"], fingerprint), ("b", "invalid", [], fingerprint), ("c", "needs_review", None, fingerprint))
    assert {r.sample_id: r.tags for r in review.apply_review_overlay(df, overlay).collect()} == {"a": ["a", "b", "z"]}
    assert {r.sample_id for r in review.apply_review_overlay(df, overlay, True).collect()} == {"a", "c"}
    for bad in (decide(("x", "valid", [], fingerprint)), decide(("a", "valid", [], "0" * 64)), decide(("a", "odd", [], fingerprint)), decide(("a", "valid", [], fingerprint), ("a", "valid", [], fingerprint))):
        with pytest.raises(ReviewError):
            review.apply_review_overlay(df, bad)
    assert review.apply_review_overlay(df, overlay.limit(0)).count() == 3


def test_fingerprints(spark):
    df = _samples(spark, [("b", 'q"\\', "d"), ("a", "ا", "d")])
    import hashlib
    import json

    records = [dict(document_id="d", image_path=f"images/{i}.png", line_index=n, sample_id=i, schema_version=1, tags=["a", "b"], text=t) for i, t, n in (("a", "ا", 1), ("b", 'q"\\', 0))]
    text = "".join(json.dumps(r, ensure_ascii=False, separators=(",", ":"), sort_keys=True) + "\n" for r in records)
    assert dataset_fingerprint(df) == hashlib.sha256(text.encode()).hexdigest()
    assert group_fingerprints(df, "document_id").head().fingerprint == dataset_fingerprint(df)
    pairs = json.dumps([["a", "ا"], ["b", 'q"\\']], ensure_ascii=False, separators=(",", ":"))
    assert reference_fingerprint(df) == hashlib.sha256(pairs.encode()).hexdigest()


def test_config():
    assert SegmentationConfig.from_mapping({"padding_scale": 1}).padding_scale == 1
    for bad in ({"nope": 1}, {"minimum_column_lines": True}, {"padding_scale": "1"}):
        with pytest.raises(ConfigurationError):
            SegmentationConfig.from_mapping(bad)
    assert EvaluationError("m").code == "evaluation_error"


def test_validation_report_has_image_issues(spark, sf_dir):
    from collections import Counter

    from sutur.plans import corpus

    queries = corpus.queries()
    count = lambda n: Counter(r.code for r in queries[n](spark, sf_dir).select("code").collect())
    image = {"duplicate_image", "duplicate_pair", "conflicting_image_text"}
    whole, text = count("q14b_validation_report_with_images"), count("q14_validation_report")
    assert {c: n for c, n in whole.items() if c not in image} == text and not image & set(text)
    from sutur.functions.paths import portable_path

    files = {}
    for r in spark.read.parquet(f"{sf_dir}/artifact_manifest.parquet").where("path is not null and added_at is not null and sha256 is not null").collect():
        files[r.path] = max(files.get(r.path, (r.added_at, r.sha256)), (r.added_at, r.sha256))
    manifest = spark.read.parquet(f"{sf_dir}/manifest.parquet").select(portable_path(F.col("image_path")).alias("p"), "text").collect()
    digests = [(files[r.p][1], r.text) for r in manifest if r.p in files]
    texts = {}
    for d, t in digests:
        texts.setdefault(d, set()).add(t)
    assert whole["duplicate_image"] == len(digests) - len(texts) > 0
    assert whole["duplicate_pair"] == len(digests) - len(set(digests))
    assert whole["conflicting_image_text"] == sum(len(texts[d] - {None}) > 1 for d, _ in digests)
