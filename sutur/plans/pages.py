"""Queries over page geometry, matching, layout, assembly and frame paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sutur.functions.geometry import (
    area,
    center_y,
    clipped,
    contains,
    horizontal_gap,
    intersection,
    intersection_over_union,
    is_box,
    padded,
    rotated,
    vertical_center_distance,
    vertical_gap,
    vertical_overlap_ratio,
)
from sutur.functions.sequences import collapse_path, first_argmax, minimum_timesteps
from sutur.operators import assembly, layout, regions
from sutur.session import table
from sutur.sources import synthetic

# Event types as classes of frames, 0 is blank.
_CLASSES = ("view", "click", "signup", "purchase")


def _placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of pages, with the place in their page."""
    rows = table(spark, sf_dir, "page_ground").select("record_id", "page_id", "dimensions", F.posexplode("lines").alias("pos", "l"))
    return rows.select("record_id", "page_id", "dimensions", "pos", "l.*")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages whose both boxes are sound, with the place in their page."""
    return _placed_lines(spark, sf_dir).where(is_box(F.col("composition_box")) & is_box(F.col("output_box")))


def _sides(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expected and detected lines; each side holds the lines whose own box is sound."""
    side = lambda b: found.where(is_box(F.col(b))).select("record_id", F.col("pos").alias("index"), F.col(b).alias("box"), "region_kind", "column_index")
    return side("composition_box"), side("output_box")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, detected = _sides(_placed_lines(spark, sf_dir))
    pages = table(spark, sf_dir, "page_ground")
    has_columns = F.exists("lines", lambda x: x["column_index"] == 0) & F.exists("lines", lambda x: x["column_index"] == 1)
    label = F.when(F.coalesce(F.size("lines"), F.lit(0)) <= 0, "blank").when(F.coalesce(has_columns, F.lit(False)), "two_column").otherwise("one_column")
    cases = pages.select("record_id", F.coalesce("expected_blank", F.lit(False)).alias("expected_blank"), (F.coalesce(F.size("lines"), F.lit(0)) <= 0).alias("detected_blank"), label.alias("expected_layout"))
    return regions.page_results(cases, expected, detected, "record_id")


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line boxes taken as components of their page, with the page's area; null where its size isn't known."""
    found = lines(spark, sf_dir)
    size = F.when((F.col("dimensions.width") > 0) & (F.col("dimensions.height") > 0), F.col("dimensions.width").cast("bigint") * F.col("dimensions.height"))
    return found.select("record_id", F.col("pos").alias("label"), F.col("output_box").alias("box"), area(F.col("output_box")).alias("area"), size.alias("page_area"))


def q26(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = regions.overlapping_pairs(*_sides(lines(spark, sf_dir)), "record_id", 0.5)
    return pairs.withColumn("iou", F.round("iou", 9))


def q27(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = regions.overlapping_pairs(*_sides(lines(spark, sf_dir)), "record_id", 0.1)
    return regions.greedy_matches(pairs, "record_id").withColumn("iou", F.round("iou", 9))


def q28(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regions.corpus_result(_results(spark, sf_dir))
    return found.withColumns({n: F.round(n, 9) for n in ("precision", "recall", "f1", "mean_iou")})


def q29(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines(spark, sf_dir).select("record_id", F.col("output_box").alias("box"))
    return regions.page_unions(found, ["record_id"]).select("record_id", "box.x", "box.y", "box.width", "box.height", "regions")


def q30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.text_scale(_components(spark, sf_dir), "record_id", F.col("page_area"))


def q30b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text scale beside the page's area and the lines it leaves out as too large."""
    found = _components(spark, sf_dir)
    sizes = found.groupBy("record_id").agg(F.max("page_area").alias("page_area"), F.count_if(F.col("area") > F.col("page_area") * 0.05).alias("oversized"))
    return regions.text_scale(found, "record_id", F.col("page_area")).join(sizes, "record_id").select("record_id", "text_scale", "page_area", "oversized")


def q31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low boxes attach to the nearest tall one of their page."""
    found = _components(spark, sf_dir)
    marks = found.where("box.height < 50").select("record_id", F.col("label").alias("mark"), "box")
    groups = found.where("box.height >= 50").select("record_id", F.col("label").alias("group"), "box")
    return regions.nearest_groups(marks, groups, "record_id", F.lit(80))


def q33(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _components(spark, sf_dir)
    scale = regions.text_scale(found, "record_id", F.col("page_area"))
    boxes = found.join(scale, "record_id").select(F.col("record_id").cast("string").alias("page_id"), F.col("label").alias("candidate"), "box.*", "text_scale")
    return layout.order_boxes(boxes)


def q33b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order of the lines of every page as if it had one column: anchored bands, right to left inside."""
    found = _components(spark, sf_dir)
    boxes = found.select(F.col("record_id").cast("string").alias("page_id"), F.col("label").alias("candidate"), "box.*", F.lit(80.0).alias("text_scale"))
    return layout.order_boxes(boxes, columns=False).select("page_id", "candidate", "reading_order_index")


def q34(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines(spark, sf_dir)
    page = found.select(
        F.col("record_id").cast("string").alias("page_id"), F.lit(0).alias("page_index"), F.col("dimensions.width").alias("page_width"),
        F.col("dimensions.height").alias("page_height"), F.col("pos").alias("label"), "output_box.*", area(F.col("output_box")).alias("area"),
    )
    return layout.segment_components(page.where("page_width > 0 and page_height > 0"))


def q35(spark: SparkSession, sf_dir: str, whole: bool) -> DataFrame:
    """Page texts, or document texts by the page's place among the captures of its document."""
    found = table(spark, sf_dir, "page_ground").select("record_id", "page_id", F.explode("lines").alias("l"))
    ordered = found.select("record_id", "page_id", F.col("l.reading_order_index").alias("o"), F.col("l.line_id").alias("line_id"), F.col("l.text").alias("text")).where("o is not null")
    pages = assembly.assemble_pages(ordered.withColumn("key", F.struct("o", "line_id", "text")), ["record_id", "page_id"], "key")
    if not whole:
        return pages.select("record_id", "page_text", "lines", "failed_lines")
    documents = pages.where("page_id is not null").withColumn("document", F.regexp_replace("page_id", "-p[0-9]+$", ""))
    return assembly.assemble_documents(documents.withColumn("k", F.struct("page_id", "record_id")), "document", "k")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame paths: the classes of a user's events in order, as arrays."""
    classes = F.create_map(*[F.lit(x) for i, n in enumerate(_CLASSES, 1) for x in (n, i)])
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(F.try_element_at(classes, F.col("event_type")), F.lit(0)).alias("c"))
    return events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "c"))), lambda s: s["c"]).alias("path"))


def q36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("user_id", F.array_join(F.transform(collapse_path(F.col("path")), lambda i: i.cast("string")), " ").alias("indices"))


def q44(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("composition_box"), F.col("output_box")
    r = lambda c: F.round(c, 9)
    return lines(spark, sf_dir).select(
        "record_id", "pos", area(a).alias("area"), intersection(a, b)["width"].alias("common_width"), r(intersection_over_union(a, b)).alias("iou"),
        horizontal_gap(a, b).alias("gap_x"), vertical_gap(a, b).alias("gap_y"), r(vertical_overlap_ratio(a, b)).alias("overlap_y"),
        r(vertical_center_distance(a, b)).alias("center_distance"), contains(b, a["x"], a["y"]).alias("holds_corner"),
    )


def q45(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w, h = F.col("output_box"), F.col("dimensions.width"), F.col("dimensions.height")
    found = lines(spark, sf_dir).where("dimensions.width > 0 and dimensions.height > 0")
    grown, cut = padded(b, F.lit(25), w, h), clipped(b, F.floor(w / 2).cast("int"), F.floor(h / 2).cast("int"))
    turned = rotated(b, [[0.0, -1.0, 1000.0], [1.0, 0.0, 0.0]], w, h)
    return found.select(
        "record_id", "pos", grown["x"].alias("px"), grown["width"].alias("pw"), grown["height"].alias("ph"), cut["width"].alias("cw"), cut["height"].alias("ch"),
        turned["x"].alias("rx"), turned["y"].alias("ry"), turned["width"].alias("rw"), turned["height"].alias("rh"),
    )


def q57(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a generated page of the case's family has, for every case of a family that is generated."""
    cases = table(spark, sf_dir, "vision_cases").select("record_id", F.lower(F.translate("layout_family", "-", "_")).alias("layout_family"))
    return synthetic.page_placements(cases.where(F.col("layout_family").isin(*synthetic.PLACEMENTS))).drop("layout_family")


def queries() -> dict:
    return {
        "q26_iou_join": q26,
        "q27_greedy_matches": q27,
        "q28_corpus_result": q28,
        "q28b_page_results": lambda s, d: _results(s, d).select("record_id", "expected", "detected", "matched", "exact_order", "exact_layout", F.array_join("failures", ",").alias("failures")),
        "q28c_page_counts": lambda s, d: _results(s, d).select("record_id", "expected", "detected", "matched", F.array_contains("failures", "line_count").alias("miscounted")),
        "q29_page_unions": q29,
        "q30_text_scale": q30,
        "q30b_text_scale_and_area": q30b,
        "q31_nearest_groups": q31,
        "q32_free_runs": lambda s, d: regions.free_runs(_components(s, d), "record_id"),
        "q33_reading_order": q33,
        "q33b_band_order": q33b,
        "q34_line_groups": q34,
        "q35_page_texts": lambda s, d: q35(s, d, False),
        "q35b_document_texts": lambda s, d: q35(s, d, True),
        "q36_ctc_decode": q36,
        "q37_ctc_timesteps": lambda s, d: _paths(s, d).select("user_id", minimum_timesteps(F.col("path")).alias("frames")),
        "q38_argmax": lambda s, d: table(s, d, "embeddings").select("vec_id", first_argmax(F.col("embedding")).alias("best")),
        "q44b_box_measures": q44,
        "q45_box_changes": q45,
        "q55_logical_cases": lambda s, d: regions.logical_cases(table(s, d, "vision_cases")),
        "q57_page_placements": q57,
        "q46_line_centers": lambda s, d: lines(s, d).select("record_id", "pos", center_y(F.col("output_box")).alias("center")),
    }


_SOUND = "{0}.x >= 0 and {0}.y >= 0 and {0}.width >= 1 and {0}.height >= 1"
_LINES = f"""lines as (
  select record_id, page_id, dimensions, (pos - 1)::int as pos, l.composition_box as a, l.output_box as b, l.region_kind, l.column_index from (
    select record_id, page_id, dimensions, unnest(lines) as l, generate_subscripts(lines, 1) as pos from page_ground)
  where {_SOUND.format("l.composition_box")} and {_SOUND.format("l.output_box")}
)"""


def _overlap(a: str, b: str, at: str, size: str) -> str:
    return f"greatest(0, least({a}.{at} + {a}.{size}, {b}.{at} + {b}.{size}) - greatest({a}.{at}, {b}.{at}))"


def _gap(a: str, b: str, at: str, size: str) -> str:
    return f"greatest(0, {b}.{at} - {a}.{at} - {a}.{size}, {a}.{at} - {b}.{at} - {b}.{size})"


def _iou(a: str, b: str) -> str:
    common = f"({_overlap(a, b, 'x', 'width')}::bigint * {_overlap(a, b, 'y', 'height')})"
    return f"({common}::double / ({a}.width::bigint * {a}.height + {b}.width::bigint * {b}.height - {common}))"


_PAIRS = f"""{_LINES}, pairs as (
  select e.record_id, e.pos as ei, d.pos as di, {_iou("e.a", "d.b")} as iou from lines e join lines d on e.record_id = d.record_id
)"""
_PLACED = "select record_id, (pos - 1)::int as pos, l from (select record_id, unnest(lines) as l, generate_subscripts(lines, 1) as pos from page_ground)"
_EACH_SIDE = f"""e as (select record_id, pos, l.composition_box as a from ({_PLACED}) where {_SOUND.format("l.composition_box")}
), d as (select record_id, pos, l.output_box as b from ({_PLACED}) where {_SOUND.format("l.output_box")}
), pairs as (select e.record_id, e.pos as ei, d.pos as di, {_iou("e.a", "d.b")} as iou from e join d on e.record_id = d.record_id)"""
_GREEDY = """{pairs}, good as (
  select record_id, ei, di, iou, row_number() over (partition by record_id order by iou desc, ei, di) as k from pairs where iou >= {threshold}
), fold(record_id, k, used_e, used_d, taken, ei, di, iou) as (
  select distinct record_id, 0::bigint, []::int[], []::int[], false, null::int, null::int, null::double from good
  union all
  select g.record_id, g.k, case when free then list_append(used_e, g.ei) else used_e end, case when free then list_append(used_d, g.di) else used_d end, free, g.ei, g.di, g.iou
  from fold f join good g on g.record_id = f.record_id and g.k = f.k + 1,
    lateral (select not list_contains(f.used_e, g.ei) and not list_contains(f.used_d, g.di) as free)
), matches as (select record_id, ei, di, iou from fold where taken)"""


def oracle_sql() -> dict:
    greedy = lambda t: "with recursive " + _GREEDY.format(pairs=_PAIRS, threshold=t)
    comps = f"{_LINES}, comps as (select record_id, pos as label, b as box, b.width::bigint * b.height as area from lines)"
    classes = " ".join(f"when '{n}' then {i}" for i, n in enumerate(_CLASSES, 1))
    page = (
        greedy(0.75)
        + """, cases as (
  select record_id, coalesce(expected_blank, false) as eb, coalesce(len(lines), 0) = 0 as db,
         case when coalesce(len(lines), 0) = 0 then 'blank' when len(list_filter(lines, lambda x: x.column_index = 0)) > 0
              and len(list_filter(lines, lambda x: x.column_index = 1)) > 0 then 'two_column' else 'one_column' end as el from page_ground
), e as (select record_id, count(*) as n, list_sort(list_distinct(list(column_index) filter (column_index is not null))) as cols from lines group by 1
), m as (
  select m.record_id, count(*) as n, sum(m.iou) as s, count(*) filter (x.region_kind is not distinct from y.region_kind) as kinds,
         count(*) filter (x.column_index is not distinct from y.column_index) as cols, count(*) filter (m.ei = m.di) as ordered
  from matches m join lines x on x.record_id = m.record_id and x.pos = m.ei join lines y on y.record_id = m.record_id and y.pos = m.di group by 1
), flat as (
  select c.record_id, c.eb, c.db, c.el, coalesce(e.n, 0) as n, coalesce(m.n, 0) as matched, coalesce(m.s, 0) as s, coalesce(kinds, 0) as kinds, coalesce(m.cols, 0) as cols,
         coalesce(ordered, 0) as ordered, case when c.db and coalesce(e.n, 0) = 0 then 'blank' when coalesce(e.cols, []) = [0, 1] then 'two_column' else 'one_column' end as dl
  from cases c left join e using (record_id) left join m using (record_id)
), pages as (
  select *, n = ordered as exact_order, el = dl as exact_layout, list_filter([case when eb <> db then 'blank_state' end, case when matched <> n then 'region_matching' end,
    case when kinds <> matched then 'region_kind' end, case when cols <> matched then 'column_assignment' end, case when n <> ordered then 'reading_order' end,
    case when el <> dl then 'layout' end], lambda f: f is not null) as failures from flat
)"""
    )
    return {
        "q26_iou_join": f"with {_PAIRS} select record_id, ei as expected_index, di as detected_index, round(iou, 9) as iou from pairs where iou >= 0.5",
        "q27_greedy_matches": greedy(0.1) + " select record_id, ei as expected_index, di as detected_index, round(iou, 9) as iou from matches",
        "q28b_page_results": page
        + " select record_id, n as expected, n as detected, matched, exact_order, exact_layout, array_to_string(failures, ',') as failures from pages",
        "q28_corpus_result": page
        + """ select count(*) as pages, sum(n)::bigint as expected, sum(n)::bigint as detected, sum(matched)::bigint as matched, sum(kinds)::bigint as exact_kinds,
               sum(cols)::bigint as exact_columns, count(*) filter (eb = db) as exact_blank_pages, count(*) as exact_count_pages,
               count(*) filter (exact_order) as exact_order_pages, count(*) filter (exact_layout) as exact_layout_pages, count(*) filter (len(failures) > 0) as failure_pages,
               round(sum(matched)::double / nullif(sum(n), 0), 9) as precision, round(sum(matched)::double / nullif(sum(n), 0), 9) as recall,
               round(2 * (sum(matched)::double / nullif(sum(n), 0)) * (sum(matched)::double / nullif(sum(n), 0)) / nullif(2 * sum(matched)::double / nullif(sum(n), 0), 0), 9) as f1,
               round(sum(s) / nullif(sum(matched), 0), 9) as mean_iou from pages""",
        "q28c_page_counts": "with recursive " + _GREEDY.format(pairs=_EACH_SIDE, threshold=0.75) + """
            select p.record_id, coalesce(e.n, 0)::bigint as expected, coalesce(d.n, 0)::bigint as detected, coalesce(m.n, 0)::bigint as matched, coalesce(e.n, 0) <> coalesce(d.n, 0) as miscounted
            from page_ground p left join (select record_id, count(*) as n from e group by 1) e using (record_id) left join (select record_id, count(*) as n from d group by 1) d using (record_id)
              left join (select record_id, count(*) as n from matches group by 1) m using (record_id)""",
        "q30b_text_scale_and_area": f"""with {_LINES}, comps as (
              select record_id, pos as label, b as box, b.width::bigint * b.height as area, case when dimensions.width > 0 and dimensions.height > 0 then dimensions.width::bigint * dimensions.height end as page from lines
            ), usable as (select * from (select *, min(coalesce(area > page * 0.05, false)::int) over (partition by record_id) = 1 as all_large from comps) where all_large or not coalesce(area > page * 0.05, false)
            ), run as (select record_id, box.height as h, sum(area) over (partition by record_id order by box.height, label) as r, sum(area) over (partition by record_id) / 2.0 as half from usable
            ), scale as (select record_id, arg_min(h, r)::double as text_scale from run where r >= half group by 1)
            select record_id, text_scale, page_area, oversized from scale join (
              select record_id, max(page) as page_area, count(*) filter (area > page * 0.05) as oversized from comps group by 1) using (record_id)""",
        "q33b_band_order": f"""with recursive {_LINES}, c as (
              select record_id, pos, b, row_number() over (partition by record_id order by b.y, -(b.x + b.width), pos) as k from lines
            ), band(record_id, k, anchor, number) as (
              select record_id, 1::bigint, b.y, 0 from c where k = 1
              union all
              select c.record_id, c.k, case when c.b.y > f.anchor + 20 then c.b.y else f.anchor end, f.number + (c.b.y > f.anchor + 20)::int from band f join c on c.record_id = f.record_id and c.k = f.k + 1
            ) select record_id::varchar as page_id, pos as candidate, (row_number() over (partition by record_id order by number, -(b.x + b.width), b.y, b.x, pos) - 1)::int as reading_order_index
            from c join band using (record_id, k)""",
        "q45_box_changes": f"""with {_LINES}, p as (select record_id, pos, b, dimensions.width as w, dimensions.height as h from lines where dimensions.width > 0 and dimensions.height > 0
            ), g as (select record_id, pos, greatest(b.x - 25, 0) as px, greatest(b.y - 25, 0) as py, least(b.x + b.width + 25, w) as pr, least(b.y + b.height + 25, h) as pb,
              b.x as cx, b.y as cy, least(b.x + b.width, w // 2) as cr, least(b.y + b.height, h // 2) as cb,
              greatest(0, 1000 - b.y - b.height) as rx, greatest(0, b.x) as ry, least(w, 1000 - b.y) as rr, least(h, b.x + b.width) as rb from p)
            select record_id, pos, case when pr > px and pb > py then px end as px, case when pr > px and pb > py then pr - px end as pw, case when pr > px and pb > py then pb - py end as ph,
              case when cr > cx and cb > cy then cr - cx end as cw, case when cr > cx and cb > cy then cb - cy end as ch,
              case when rr > rx and rb > ry then rx end as rx, case when rr > rx and rb > ry then ry end as ry, case when rr > rx and rb > ry then rr - rx end as rw, case when rr > rx and rb > ry then rb - ry end as rh from g""",
        "q29_page_unions": f"""with {_LINES} select record_id, min(b.x) as x, min(b.y) as y, max(b.x + b.width) - min(b.x) as width, max(b.y + b.height) - min(b.y) as height,
              count(*) as regions from lines group by 1""",
        "q30_text_scale": f"""with {comps}, usable as (select * from (select *, min((area > 50000)::int) over (partition by record_id) = 1 as all_large from comps) where all_large or area <= 50000
            ), run as (select record_id, box.height as h, sum(area) over (partition by record_id order by box.height, label) as r, sum(area) over (partition by record_id) / 2.0 as half from usable)
            select record_id, arg_min(h, r)::double as text_scale from run where r >= half group by 1""",
        "q31_nearest_groups": f"""with {comps}, near as (
              select m.record_id, m.label as mark, g.label as grp, row_number() over (partition by m.record_id, m.label order by {_gap("m.box", "g.box", "y", "height")},
                {_gap("m.box", "g.box", "x", "width")}, abs(m.box.y + m.box.height / 2.0 - g.box.y - g.box.height / 2.0), g.box.y, -(g.box.x + g.box.width), g.label) as k
              from comps m join comps g on m.record_id = g.record_id and m.box.height < 50 and g.box.height >= 50
              where {_gap("m.box", "g.box", "y", "height")} <= 80 and {_gap("m.box", "g.box", "x", "width")} <= 80)
            select record_id, mark, grp as "group" from near where k = 1""",
        "q32_free_runs": f"""with {comps}, run as (select record_id, box.x as x, max(box.x + box.width) over (partition by record_id order by box.x, box.x + box.width
              rows between unbounded preceding and 1 preceding) as r from comps) select record_id, r as "start", x as "end" from run where x > r""",
        "q35_page_texts": """with l as (select record_id, x.reading_order_index as o, x.line_id as i, x.text as t from (select record_id, unnest(lines) as x from page_ground))
            select record_id, coalesce(string_agg(t, chr(10) order by o, i nulls first, t), '') as page_text, count(*) as lines, count(*) filter (t is null) as failed_lines
            from l where o is not null group by 1""",
        "q35b_document_texts": """with l as (select record_id, page_id, x.reading_order_index as o, x.line_id as i, x.text as t from (select record_id, page_id, unnest(lines) as x from page_ground)
            ), p as (select record_id, page_id, coalesce(string_agg(t, chr(10) order by o, i nulls first, t), '') as page_text from l where o is not null group by all)
            select regexp_replace(page_id, '-p[0-9]+$', '') as document, string_agg(page_text, chr(10) || chr(10) order by page_id, record_id) as document_text, count(*) as pages
            from p where page_id is not null group by 1""",
        "q36_ctc_decode": f"""with f as (select user_id, event_id, case event_type {classes} else 0 end as c, lag(case event_type {classes} else 0 end) over (partition by user_id order by event_id) as p from events)
            select user_id, coalesce(string_agg(c::varchar, ' ' order by event_id) filter (c <> 0 and (p is null or p <> c)), '') as indices from f group by 1""",
        "q37_ctc_timesteps": f"""with f as (select user_id, event_id, case event_type {classes} else 0 end as c, lag(case event_type {classes} else 0 end) over (partition by user_id order by event_id) as p from events)
            select user_id, (count(*) + count(*) filter (p = c))::int as frames from f group by 1""",
        "q38_argmax": "select vec_id, list_position(embedding, list_max(embedding)) - 1 as best from embeddings",
        "q44b_box_measures": f"""with {_LINES} select record_id, pos, a.width::bigint * a.height as area,
              case when {_overlap("a", "b", "x", "width")} > 0 and {_overlap("a", "b", "y", "height")} > 0 then {_overlap("a", "b", "x", "width")} end as common_width,
              round({_iou("a", "b")}, 9) as iou, {_gap("a", "b", "x", "width")} as gap_x, {_gap("a", "b", "y", "height")} as gap_y,
              round({_overlap("a", "b", "y", "height")} / least(a.height, b.height)::double, 9) as overlap_y,
              round(abs(a.y + a.height / 2.0 - b.y - b.height / 2.0), 9)::double as center_distance,
              a.x >= b.x and a.x < b.x + b.width and a.y >= b.y and a.y < b.y + b.height as holds_corner from lines""",
        "q55_logical_cases": """select page_id, to_json(struct_pack(case_family := case_family, expected_blank := expected_blank, expected_layout := expected_layout,
              expected_line_count := len(list_filter(coalesce(regions, []), lambda r: r is not null)), generator_seed := generator_seed, image_sha256 := image_sha256,
              layout_family := layout_family, page_id := page_id, regions := list_transform(list_filter(coalesce(regions, []), lambda r: r is not null), lambda r: struct_pack(
                bounding_box := case when r.bounding_box is not null then struct_pack(height := r.bounding_box.height, width := r.bounding_box.width, x := r.bounding_box.x, y := r.bounding_box.y) end,
                column_index := r.column_index, reading_order_index := r.reading_order_index, region_id := r.region_id, region_kind := r.region_kind))))::varchar as value from vision_cases""",
        "q57_page_placements": """with p(f, l, r, kind, col, tops, first) as (values
              ('one_column', 144, 936, 'line', null::int, [90, 290, 490, 690, 890], 0), ('mild_skew', 144, 936, 'line', null, [90, 290, 490, 690, 890], 0),
              ('one_column_wide', 64, 936, 'line', null, [100], 0), ('one_column_wide', 164, 936, 'line', null, [350, 600, 850], 1),
              ('balanced_two_column', 550, 936, 'line', 0, [90, 350, 610, 870], 0), ('balanced_two_column', 64, 450, 'line', 1, [90, 350, 610, 870], 4),
              ('uneven_two_column', 550, 936, 'line', 0, [90, 350, 610, 870], 0), ('uneven_two_column', 64, 450, 'line', 1, [90, 350, 610], 4),
              ('spanning_top', 64, 936, 'spanning', null, [55], 0), ('spanning_top', 550, 936, 'line', 0, [330, 590, 850], 1), ('spanning_top', 64, 450, 'line', 1, [330, 590, 850], 4),
              ('spanning_middle', 550, 936, 'line', 0, [70, 260], 0), ('spanning_middle', 64, 450, 'line', 1, [70, 260], 2), ('spanning_middle', 64, 936, 'spanning', null, [485], 4),
              ('spanning_middle', 550, 936, 'line', 0, [720, 940], 5), ('spanning_middle', 64, 450, 'line', 1, [720, 940], 7),
              ('spanning_footer', 550, 936, 'line', 0, [90, 350, 610], 0), ('spanning_footer', 64, 450, 'line', 1, [90, 350, 610], 3), ('spanning_footer', 64, 936, 'spanning', null, [950], 6)
            ), flat as (select f, l, r, kind, col, unnest(tops) as y, first + generate_subscripts(tops, 1) - 1 as o from p)
            select record_id, o::int as reading_order_index, l as "left", r as "right", y, kind as region_kind, col as column_index
            from vision_cases join flat on f = lower(replace(layout_family, '-', '_'))""",
        "q46_line_centers": f"with {_LINES} select record_id, pos, (b.y + b.height / 2.0)::double as center from lines",
    }
