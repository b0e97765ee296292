"""Geometry, matching, grouping, layout, pixels, assembly, recognition."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sutur.config import PreprocessingConfig, SegmentationConfig
from sutur.errors import AssemblyError
from sutur.functions import geometry as g
from sutur.operators import assembly, layout, recognition, regions
from sutur.plans import pages as plans
from sutur.sources import pixels

BOX = "struct<x:int,y:int,width:int,height:int>"


def test_box_measures_equal_pixel_sets(spark):
    rng = random.Random(2)
    boxes = [tuple(rng.randint(0, 6) if i < 2 else rng.randint(1, 6) for i in range(4)) for _ in range(60)]
    df = spark.createDataFrame([(i, boxes[i], boxes[-i]) for i in range(60)], f"i int, a {BOX}, b {BOX}")
    a, b = F.col("a"), F.col("b")
    cells = lambda x, y, w, h: {(i, j) for i in range(x, x + w) for j in range(y, y + h)}
    for r in df.select("a", "b", g.intersection(a, b).alias("c"), g.intersection_over_union(a, b).alias("iou"), g.clipped(a, F.lit(5), F.lit(5)).alias("k"), g.padded(a, F.lit(1), F.lit(9), F.lit(9)).alias("p")).collect():
        one, two = cells(*r.a), cells(*r.b)
        assert (cells(*r.c) if r.c else set()) == one & two
        assert r.iou == pytest.approx(len(one & two) / len(one | two))
        assert (cells(*r.k) if r.k else set()) == {c for c in one if c[0] < 5 and c[1] < 5}
        assert cells(*r.p) == {(x + i, y + j) for x, y in one for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= x + i < 9 and 0 <= y + j < 9}
    union = df.agg(g.union_box(a).alias("u")).head().u
    assert union.x == min(v[0] for v in boxes) and union.x + union.width == max(v[0] + v[2] for v in boxes)
    assert df.limit(0).agg(g.union_box(a).alias("u")).head().u is None


def test_touching_boxes(spark):
    box = lambda *v: g.box(*map(F.lit, v))
    a, b = box(0, 0, 10, 10), box(10, 0, 10, 10)
    row = spark.range(1).select(g.intersection(a, b).alias("i"), g.horizontal_gap(a, b).alias("h"), g.intersection_over_union(a, b).alias("o"), g.contains(a, F.lit(10), F.lit(0)).alias("c")).head()
    assert (row.i, row.h, row.o, row.c) == (None, 0, 0.0, False)


def _regions(spark, rows):
    return spark.createDataFrame([(p, i, b, k, c) for p, i, b, k, c in rows], f"page string, index int, box {BOX}, region_kind string, column_index int")


def test_greedy_matching(spark):
    b1, b2 = (0, 0, 10, 10), (0, 50, 10, 10)
    expected = _regions(spark, [("p", 0, b1, "line", None), ("p", 1, b2, "line", None)])
    crossed = _regions(spark, [("p", 0, b2, "line", None), ("p", 1, b1, "line", None)])
    match = lambda e, d: sorted((r.expected_index, r.detected_index, r.iou) for r in regions.greedy_matches(regions.overlapping_pairs(e, d, "page"), "page").collect())
    assert match(expected, crossed) == [(0, 1, 1.0), (1, 0, 1.0)]
    twins = _regions(spark, [("p", 0, b1, "line", None), ("p", 1, b1, "line", None)])
    assert match(expected.where("index = 0"), twins) == [(0, 0, 1.0)]
    cases = spark.createDataFrame([("p", False, False, "one_column"), ("q", True, True, "blank")], "page string, expected_blank boolean, detected_blank boolean, expected_layout string")
    pages = regions.page_results(cases, expected, crossed, "page")
    rows = {r.page: r for r in pages.collect()}
    assert rows["p"].failures == ["reading_order"] and rows["q"].failures == []
    total = regions.corpus_result(pages).head()
    assert (total.precision, total.recall, total.f1, total.failure_pages) == (1.0, 1.0, 1.0, 1)
    assert regions.corpus_result(pages.limit(0)).head().precision is None


def _order(boxes, scale=20.0):
    rows = np.array([[x, y, x + w, y + h] for x, y, w, h in boxes])
    return layout.reading_order(rows, scale, SegmentationConfig())


def test_reading_order():
    two = [(600, y, 350, 30) for y in (100, 200, 300)] + [(50, y, 350, 30) for y in (105, 205, 305)]
    assert [i for i, _, _ in _order(two)] == [0, 1, 2, 3, 4, 5]
    assert [c for _, c, _ in _order(two)] == [0, 0, 0, 1, 1, 1]
    spanning = [*two, (50, 250, 900, 20)]
    assert [(i, k) for i, _, k in _order(spanning)] == [(0, "line"), (1, "line"), (3, "line"), (4, "line"), (6, "spanning"), (2, "line"), (5, "line")]
    assert [i for i, _, _ in _order([(100, 50, 300, 20), (500, 52, 300, 20), (100, 100, 300, 20)])] == [1, 0, 2]
    chain = [(300, 0, 10, 10), (200, 4, 10, 10), (400, 8, 10, 10)]  # bands are anchored: tolerance 5 from the first top
    assert [i for i, _, _ in _order(chain)] == [0, 1, 2]
    assert _order([]) == []


def test_segmentation_of_components(spark):
    rows = []
    for page in ("p1", "p2"):
        label = 0
        for y in (100, 200):
            for x in range(100, 500, 30):
                label += 1
                rows.append((page, 0, 1000, 600, label, x, y, 20, 40, 400))
        rows.append((page, 0, 1000, 600, label + 1, 150, 92, 5, 5, 20))  # a mark above the first line
    df = spark.createDataFrame(rows, "page_id string, page_index int, page_width int, page_height int, label int, x int, y int, width int, height int, area bigint")
    found = layout.segment_components(df).orderBy("page_id", "reading_order_index").collect()
    assert [(r.page_id, r.reading_order_index, r.column_index, r.region_kind) for r in found] == [(p, i, None, "line") for p in ("p1", "p2") for i in (0, 1)]
    assert (found[0].x, found[0].y) == (92, 84)
    assert layout.segment_components(df.limit(0)).count() == 0


def test_components_equal_flood_fill():
    rng = np.random.default_rng(1)
    for _ in range(30):
        mask = rng.random((12, 15)) < 0.4
        seen, want = np.zeros_like(mask), []
        for sy, sx in zip(*np.nonzero(mask)):
            if seen[sy, sx]:
                continue
            stack, cells = [(sy, sx)], []
            seen[sy, sx] = True
            while stack:
                y, x = stack.pop()
                cells.append((y, x))
                for ny in range(max(0, y - 1), min(12, y + 2)):
                    for nx in range(max(0, x - 1), min(15, x + 2)):
                        if mask[ny, nx] and not seen[ny, nx]:
                            seen[ny, nx] = True
                            stack.append((ny, nx))
            ys, xs = zip(*cells)
            want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(cells)))
        got = pixels.components(mask)
        assert sorted(map(tuple, got[["x", "y", "width", "height", "area"]].values.tolist())) == sorted(want)


def test_pixel_kernels():
    page = np.full((60, 80), 250, dtype=np.uint8)
    page[20:30, 10:70] = 5
    gray, mask, blank, angle = pixels.preprocess(page)
    assert mask.sum() == 600 and not blank and angle == 0.0
    assert pixels.preprocess(255 - page)[1].sum() == 600  # dark background
    assert pixels.preprocess(np.full((60, 80), 250, dtype=np.uint8))[2]
    assert pixels.preprocess(page, PreprocessingConfig(threshold_method="sauvola", sauvola_window_size=25))[1][20:30, 10:70].mean() > 0.5
    dotted = mask.copy()
    dotted[5, 5] = True
    assert pixels.morphology(dotted, "open", 3).sum() == 600
    holed = mask.copy()
    holed[25, 40] = False
    assert pixels.morphology(holed, "close", 3).sum() == 600
    lines = np.zeros((120, 160), dtype=bool)
    lines[20:100:20, 20:140] = True
    tilted = pixels.rotate(lines, 3.0, 0, False)
    assert abs(pixels.estimate_deskew(tilted, PreprocessingConfig()) + 3.0) <= 0.5
    assert pixels.equalize_tiles(page, 2.0, 8).shape == page.shape and pixels.median_filter(page, 3).shape == page.shape
    batch, widths = pixels.pad_lines([pixels.line_input(page), pixels.line_input(page[:, :40])])
    assert batch.shape[2] % 4 == 0 and widths.tolist() == [85, 43]


def _png(path, array):
    raw = b"".join(b"\0" + row.tobytes() for row in array)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", array.shape[1], array.shape[0], 8, 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_to_text(spark, tmp_path):
    page = np.full((120, 300), 255, dtype=np.uint8)
    for y in (20, 70):
        for x in range(20, 260, 20):
            page[y : y + 20, x : x + 12] = 0
    _png(tmp_path / "page-a.png", page)
    _png(tmp_path / "page-b.png", np.full((50, 50), 255, dtype=np.uint8))
    images = pixels.read_images(spark, str(tmp_path))
    found = pixels.page_components(images)
    assert {r.page_id: r.n for r in found.groupBy("page_id").agg(F.count("label").alias("n")).collect()} == {"page-a": 24, "page-b": 0}
    lines = layout.segment_components(found.where("label is not null"))
    assert lines.count() == 2
    crops = recognition.line_crops(images, lines)

    def load():
        def model(batch, widths):
            scores = np.zeros((len(batch), 4, 3), dtype=np.float32)
            scores[:, [0, 2], 1] = 1
            scores[:, 1, 0] = 1
            scores[:, 3, 2] = 1
            return scores, np.full(len(batch), 4)

        return model

    texts = recognition.greedy_texts(recognition.recognize_lines(crops, load, batch_size=1), ["a", "b"])
    assert [r.text for r in texts.orderBy("reading_order_index").collect()] == ["aab", "aab"]


def test_assembly(spark):
    lines = spark.createDataFrame([("d", 0, 0, "a"), ("d", 0, 1, None), ("d", 0, 2, "c"), ("d", 1, 0, None), ("d", 2, 0, "b")], "doc string, page int, reading_order_index int, text string")
    pages = assembly.assemble_pages(lines, ["doc", "page"])
    assert {r.page: (r.page_text, r.lines, r.failed_lines) for r in pages.collect()} == {0: ("a\nc", 3, 1), 1: ("", 1, 1), 2: ("b", 1, 0)}
    assert assembly.assemble_documents(pages, "doc", "page").head().document_text == "a\nc\n\n\n\nb"
    assert assembly.document_json(pages.where("page = 2"), pretty=False).head().value == '{"doc":"d","failed_lines":0,"lines":1,"page":2,"page_text":"b"}'
    assembly.require_contiguous(lines, ["doc", "page"], "reading_order_index")
    with pytest.raises(AssemblyError):
        assembly.require_contiguous(lines.where("reading_order_index <> 1"), ["doc", "page"], "reading_order_index")


def test_scale_marks_and_gaps(spark):
    df = spark.createDataFrame([("p", 1, (0, 0, 10, 10), 100), ("p", 2, (20, 0, 10, 30), 300), ("p", 3, (50, 0, 900, 900), 810000)], f"page string, label int, box {BOX}, area bigint")
    assert regions.text_scale(df, "page", F.lit(1_000_000)).head().text_scale == 30.0
    assert {(r.start, r.end) for r in regions.free_runs(df, "page").collect()} == {(10, 20), (30, 50)}
    marks = spark.createDataFrame([("p", 7, (22, 33, 2, 2)), ("p", 8, (0, 5000, 2, 2))], f"page string, mark int, box {BOX}")
    groups = df.select("page", F.col("label").alias("group"), "box").where("label < 3")
    assert [tuple(r) for r in regions.nearest_groups(marks, groups, "page", F.lit(10)).collect()] == [("p", 7, 2)]


def test_page_with_specks_only(spark):
    df = spark.createDataFrame([("p", 0, 1000, 600, 1, 5, 5, 1, 1, 1)], "page_id string, page_index int, page_width int, page_height int, label int, x int, y int, width int, height int, area bigint")
    assert layout.segment_components(df).count() == 0


_LINE = f"struct<line_id:string,text:string,text_sha256:string,composition_box:{BOX},output_box:{BOX},region_kind:string,column_index:int,reading_order_index:int>"


def _page_ground(spark, folder, pages):
    """Test table of pages (record_id, dimensions, [(composition_box, output_box)])."""
    rows = [(i, f"page-{i}", d, False, [(None, None, None, a, b, "line", None, k) for k, (a, b) in enumerate(boxes)]) for i, d, boxes in pages]
    kind = f"record_id bigint, page_id string, dimensions struct<width:int,height:int>, expected_blank boolean, lines array<{_LINE}>"
    spark.createDataFrame(rows, kind).write.parquet(str(folder / "page_ground.parquet"))
    return str(folder)


def test_missed_and_extra_lines_count(spark, tmp_path):
    a, b, c = (0, 0, 100, 20), (0, 50, 100, 20), (0, 100, 100, 20)
    missed = [(a, a), (b, None), (c, (0, 100, 0, 20))]  # one without an output box, one with an empty one
    extra = [(a, a), (None, b)]
    folder = _page_ground(spark, tmp_path, [(1, (1000, 1500), missed), (2, (1000, 1500), extra), (3, (1000, 1500), [(a, a), (b, b)])])
    queries = plans.queries()
    rows = {r.record_id: (r.expected, r.detected, r.matched, r.exact_order, r.failures) for r in queries["q28b_page_results"](spark, folder).collect()}
    wrong = "line_count,region_matching,reading_order"
    assert rows == {1: (3, 1, 1, False, wrong), 2: (1, 2, 1, False, wrong), 3: (2, 2, 2, True, "")}
    total = queries["q28_corpus_result"](spark, folder).head()
    assert (total.expected, total.detected, total.matched, total.exact_count_pages) == (6, 5, 4, 1)
    assert (total.precision, total.recall) == (pytest.approx(4 / 5), pytest.approx(4 / 6))


def test_text_scale_uses_the_page_size(spark, tmp_path):
    small, large = (0, 0, 100, 20), (0, 100, 550, 100)  # 2,000 and 55,000 pixels
    lower = (300, 20, 100, 20)
    pages = [(1, (1000, 1000)), (2, (1000, 1200)), (3, None), (4, (0, 1000))]
    folder = _page_ground(spark, tmp_path, [(i, d, [(b, b) for b in (small, lower, large)]) for i, d in pages])
    queries = plans.queries()
    scale = {r.record_id: r.text_scale for r in queries["q30_text_scale"](spark, folder).collect()}
    assert scale == {1: 20.0, 2: 100.0, 3: 100.0, 4: 100.0}  # 5 % are 50,000 and 60,000 pixels; unknown sizes drop nothing
    order = {(r.page_id, r.candidate): r.reading_order_index for r in queries["q33_reading_order"](spark, folder).collect()}
    tops = lambda p: [order[p, k] for k in (0, 1)]
    assert tops("1") == [0, 1] and tops("2") == [1, 0]  # the wider band of page 2 holds both, right before left
