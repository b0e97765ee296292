"""Regions of pages: union, matching of expected and detected boxes, page and corpus results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sutur.errors import BenchmarkError
from sutur.functions.geometry import intersection_over_union, union_box

#: Least overlap of a match.
IOU = 0.75
# What can be wrong with a page, in the order it is told.
FAILURES = ("blank_state", "line_count", "region_matching", "region_kind", "column_assignment", "reading_order", "layout")


def page_unions(regions: DataFrame, keys: list[str], box: str = "box") -> DataFrame:
    """The box around all boxes of every page."""
    return regions.groupBy(*keys).agg(union_box(F.col(box)).alias("box"), F.count(F.lit(1)).alias("regions"))


def overlapping_pairs(expected: DataFrame, detected: DataFrame, key: str, threshold: float = IOU) -> DataFrame:
    """(key, expected_index, detected_index, iou) of pairs on one page that overlap enough.

    expected, detected  key, index int, box. The page is the equi key; a page holds tens of lines.
    """
    if not 0 < threshold <= 1:
        raise BenchmarkError("the threshold must lie in (0, 1]")
    e = expected.select(key, F.col("index").alias("expected_index"), F.col("box").alias("_e"))
    d = detected.select(key, F.col("index").alias("detected_index"), F.col("box").alias("_d"))
    pairs = e.join(d, key).select(key, "expected_index", "detected_index", intersection_over_union(F.col("_e"), F.col("_d")).alias("iou"))
    return pairs.where(F.col("iou") >= threshold)


def greedy_matches(pairs: DataFrame, key: str) -> DataFrame:
    """One-to-one matches per page: best overlap first, ties by expected, then detected index.

    The fold runs over the sorted pairs of a page inside the JVM and keeps the indexes in use.
    """
    ordered = pairs.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("neg"), "expected_index", "detected_index"))).alias("p")
    )
    kind = "struct<expected_index:int,detected_index:int,iou:double>"
    start = F.array().cast(f"array<{kind}>")

    def step(taken: Column, x: Column) -> Column:
        clash = F.exists(taken, lambda t: (t["expected_index"] == x["expected_index"]) | (t["detected_index"] == x["detected_index"]))
        row = F.struct(x["expected_index"].cast("int").alias("expected_index"), x["detected_index"].cast("int").alias("detected_index"), (-x["neg"]).alias("iou"))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(row.cast(kind))))

    return ordered.select(key, F.inline(F.aggregate("p", start, step)))


def layout_label(columns: Column, regions: Column, is_blank: Column) -> Column:
    """``blank``, ``two_column`` or ``one_column`` from the set of columns that a page's regions have."""
    return F.when(is_blank & (regions == 0), "blank").when(F.array_sort(columns) == F.array(F.lit(0), F.lit(1)), "two_column").otherwise("one_column")


def page_results(cases: DataFrame, expected: DataFrame, detected: DataFrame, key: str, threshold: float = IOU) -> DataFrame:
    """Per page: counts, matches, what is exact, and failures in fixed order.

    cases     key, expected_blank, detected_blank, expected_layout
    expected, detected  key, index, box, region_kind, column_index; index is the reading order
    """
    matches = greedy_matches(overlapping_pairs(expected, detected, key, threshold), key)
    named = matches.join(expected.select(key, F.col("index").alias("expected_index"), F.col("region_kind").alias("_ek"), F.col("column_index").alias("_ec")), [key, "expected_index"])
    named = named.join(detected.select(key, F.col("index").alias("detected_index"), F.col("region_kind").alias("_dk"), F.col("column_index").alias("_dc")), [key, "detected_index"])
    per_page = named.groupBy(key).agg(
        F.count(F.lit(1)).alias("matched"),
        F.avg("iou").alias("mean_iou"),
        F.sum("iou").alias("iou_sum"),
        F.count_if(F.col("_ek").eqNullSafe(F.col("_dk"))).alias("exact_kinds"),
        F.count_if(F.col("_ec").eqNullSafe(F.col("_dc"))).alias("exact_columns"),
        F.count_if(F.col("expected_index") == F.col("detected_index")).alias("in_order"),
    )
    e = expected.groupBy(key).agg(F.count(F.lit(1)).alias("expected"))
    d = detected.groupBy(key).agg(F.count(F.lit(1)).alias("detected"), F.collect_set("column_index").alias("columns"))
    zero = F.lit(0).cast("bigint")
    page = cases.join(e, key, "left").join(d, key, "left").join(per_page, key, "left")
    page = page.withColumns({n: F.coalesce(n, zero) for n in ("expected", "detected", "matched", "exact_kinds", "exact_columns", "in_order")})
    layout = layout_label(F.coalesce("columns", F.array().cast("array<int>")), F.col("detected"), F.col("detected_blank"))
    page = page.withColumn("detected_layout", layout)
    c = F.col
    exact_order = (c("expected") == c("detected")) & (c("in_order") == c("expected"))
    checks = [
        ~c("expected_blank").eqNullSafe(c("detected_blank")), c("expected") != c("detected"), (c("matched") != c("expected")) | (c("matched") != c("detected")),
        c("exact_kinds") != c("matched"), c("exact_columns") != c("matched"), ~exact_order, ~c("expected_layout").eqNullSafe(c("detected_layout")),
    ]
    failures = F.filter(F.array(*[F.when(bad, F.lit(code)) for bad, code in zip(checks, FAILURES)]), lambda x: x.isNotNull())
    return page.select(
        key, "expected", "detected", "matched", "mean_iou", "iou_sum", "exact_kinds", "exact_columns", exact_order.alias("exact_order"),
        c("expected_blank").eqNullSafe(c("detected_blank")).alias("exact_blank"), (c("expected") == c("detected")).alias("exact_count"),
        c("expected_layout").eqNullSafe(c("detected_layout")).alias("exact_layout"), "detected_layout", failures.alias("failures"),
    )


def corpus_result(pages: DataFrame) -> DataFrame:
    """One row: summed counts, precision, recall, F1 and mean overlap; null where a denominator is 0."""
    whole = pages.agg(
        F.count(F.lit(1)).alias("pages"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("expected", "detected", "matched", "exact_kinds", "exact_columns")],
        *[F.count_if(n).alias(f"{n}_pages") for n in ("exact_blank", "exact_count", "exact_order", "exact_layout")],
        F.count_if(F.size("failures") > 0).alias("failure_pages"),
        F.sum("iou_sum").alias("_iou"),
    )
    d = lambda n: F.col(n).cast("double")
    precision, recall = F.try_divide(d("matched"), F.col("detected")), F.try_divide(d("matched"), F.col("expected"))
    return whole.select(
        *[c for c in whole.columns if c != "_iou"], precision.alias("precision"), recall.alias("recall"),
        F.try_divide(2 * precision * recall, precision + recall).alias("f1"), F.try_divide(F.col("_iou"), F.col("matched")).alias("mean_iou"),
    )


def text_scale(components: DataFrame, key: str, page_area: Column, max_fraction: float = 0.05) -> DataFrame:
    """Area-weighted median height per page over (height, label); oversized components only count where all are.

    components  key, label, box, area, and what ``page_area`` is made of; where that is null, none is oversized
    """
    sized = components.withColumn("_large", F.coalesce(F.col("area") > page_area * max_fraction, F.lit(False)))
    page = Window.partitionBy(key)
    usable = sized.withColumn("_all_large", F.min(F.col("_large").cast("int")).over(page) == 1).where("_all_large or not _large")
    running = F.sum("area").over(page.orderBy(F.col("box.height"), "label").rowsBetween(Window.unboundedPreceding, 0))
    half = F.sum("area").over(page) / 2.0
    return usable.select(key, F.col("box.height").alias("h"), running.alias("run"), half.alias("half")).where("run >= half").groupBy(key).agg(
        F.min_by("h", "run").cast("double").alias("text_scale")
    )


def nearest_groups(marks: DataFrame, groups: DataFrame, key: str, limit: Column) -> DataFrame:
    """(key, mark, group): the group that each mark belongs to, for marks within ``limit`` of one.

    Nearest by vertical gap, horizontal gap, centre distance, then top, right edge and number.
    """
    from sutur.functions.geometry import horizontal_gap, right, vertical_center_distance, vertical_gap

    m = marks.select(key, "mark", F.col("box").alias("_m"))
    g = groups.select(key, "group", F.col("box").alias("_g"))
    vertical, across = vertical_gap(F.col("_m"), F.col("_g")), horizontal_gap(F.col("_m"), F.col("_g"))
    near = m.join(g, key).where((vertical <= limit) & (across <= limit))
    order = F.struct(
        vertical.alias("v"), across.alias("h"), vertical_center_distance(F.col("_m"), F.col("_g")).alias("c"),
        F.col("_g.y").alias("y"), (-right(F.col("_g"))).alias("r"), F.col("group").alias("g"),
    )
    return near.groupBy(key, "mark").agg(F.min_by("group", order).alias("group"))


def free_runs(boxes: DataFrame, key: str) -> DataFrame:
    """(key, start, end): maximal stretches in x between the first and the last box that no box covers."""
    before = Window.partitionBy(key).orderBy(F.col("box.x"), F.col("box.x") + F.col("box.width")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("box.x") + F.col("box.width")).over(before)
    return boxes.select(key, reach.alias("start"), F.col("box.x").alias("end")).where("end > start")


def logical_cases(cases: DataFrame) -> DataFrame:
    """(page_id, value): every benchmark case as canonical JSON, names sorted, nulls written.

    cases  page_id, case_family, layout_family, expected_layout, expected_blank, generator_seed, image_sha256, regions

    The number of lines is that of the regions; a null list counts as empty, null elements are left out. In
    order of page_id the rows are the list of cases of a logical manifest; images are no part of it.
    """
    kept = F.filter(F.coalesce("regions", F.array().cast(cases.schema["regions"].dataType)), lambda r: r.isNotNull())
    box = lambda b: F.when(b.isNotNull(), F.struct(b["height"].alias("height"), b["width"].alias("width"), b["x"].alias("x"), b["y"].alias("y")))
    regions = F.transform(
        kept,
        lambda r: F.struct(
            box(r["bounding_box"]).alias("bounding_box"), r["column_index"].alias("column_index"), r["reading_order_index"].alias("reading_order_index"),
            r["region_id"].alias("region_id"), r["region_kind"].alias("region_kind"),
        ),
    )
    record = F.struct(
        "case_family", "expected_blank", "expected_layout", F.size(regions).alias("expected_line_count"), "generator_seed", "image_sha256", "layout_family", "page_id",
        regions.alias("regions"),
    )
    return cases.select("page_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))
