"""Problem 1: pages and vision cases as flat tables of parents and children.

``page_ground.lines`` and ``vision_cases.regions`` are shredded as they are, ``raw_records.payload``
after a strict parse. Children carry the key of the record and their place, so that parents and
children join on (tbl, record_id, parent_pos).
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from sutur.operators.shredding import shred_tables
from sutur.session import table
from sutur.sources.payloads import parse_payloads

_BOX = ("x", "y", "width", "height")
_CHILD_SCHEMA = (
    "tbl string, record_id bigint, parent_pos int, child_pos int, child_id string, text string, region_kind string, "
    "column_index bigint, reading_order_index bigint, x bigint, y bigint, width bigint, height bigint"
)
_PARENT_SCHEMA = (
    "tbl string, record_id bigint, parent_pos int, page_id string, layout_family string, image_path string, "
    "expected_blank boolean, expected_line_count bigint"
)


def _complete(flat: pa.Table) -> pa.Array:
    ok = pc.is_valid(flat["x"])
    for name in _BOX[1:]:
        ok = pc.and_(ok, pc.is_valid(flat[name]))
    return ok


def _whole(flat: pa.Table) -> pa.Array:
    """Boxes of whole numbers, whether or not they fit bigint."""
    return pc.fill_null(flat["whole"], False)


def _typed_children(df: DataFrame, tbl: str, column: str, child_id: str, box: str, text: str | None) -> DataFrame:
    base = ("[]",)
    outputs = {"child_id": (*base, child_id), "region_kind": (*base, "region_kind")}
    outputs |= {n: (*base, n) for n in ("column_index", "reading_order_index")} | {n: (*base, box, n) for n in _BOX}
    if text:
        outputs["text"] = (*base, text)
    fields = ["record_id bigint", "child_pos int"] + [
        f"{n} {'int' if n in (*_BOX, 'column_index', 'reading_order_index') else 'string'}" for n in outputs
    ]
    flat = shred_tables(df, ["record_id"], column, base, _parse_datatype_string(", ".join(fields)), outputs, ["child_pos"])
    if not text:
        flat = flat.withColumn("text", F.lit(None).cast("string"))
    flat = flat.withColumn("tbl", F.lit(tbl)).withColumn("parent_pos", F.lit(0))
    return _as(flat, _CHILD_SCHEMA)


def _as(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in _parse_datatype_string(schema)])


def _typed_boxes(df: DataFrame, tbl: str, column: str, box: str) -> DataFrame:
    """Children with a full box only; the scan reads nothing but the box of the list."""
    schema = _parse_datatype_string("record_id bigint, child_pos int, x int, y int, width int, height int")
    pruned = df.select("record_id", F.col(f"{column}.{box}").alias("boxes"))
    flat = shred_tables(pruned, ["record_id"], "boxes", ("[]",), schema, {n: ("[]", n) for n in _BOX}, ["child_pos"], keep=_complete)
    return flat.select(F.lit(tbl).alias("tbl"), "record_id", F.lit(0).alias("parent_pos"), "child_pos")


def _payload_children(df: DataFrame, full_only: bool) -> DataFrame:
    base = ("[]", "children", "[]")
    names = () if full_only else ("child_id", "text", "region_kind", "column_index", "reading_order_index")
    columns = {"parent_pos": ("[]", "place")} | {n: (*base, n) for n in names} | {n: (*base, "box", n) for n in (("whole",) if full_only else _BOX)}
    kinds = {"parent_pos": "int", "whole": "boolean", "child_id": "string", "text": "string", "region_kind": "string"}
    fields = ["record_id bigint", "parent_row int", "child_pos int"] + [f"{n} {kinds.get(n, 'bigint')}" for n in columns]
    flat = shred_tables(
        df, ["record_id"], "payload", base, _parse_datatype_string(", ".join(fields)), columns, ["parent_row", "child_pos"],
        prepare=parse_payloads, keep=_whole if full_only else None,
    )
    return flat.withColumn("tbl", F.lit("raw_records"))


def nested_children(pages: DataFrame, cases: DataFrame, payloads: DataFrame) -> DataFrame:
    """Flat table of lines and regions of all three tables, with box and reading order.

    Null lists and records, empty lists and payloads that are no JSON object give no rows; a null
    element gives a row of nulls at its place. Repeated records give repeated rows. Extra columns
    are never read.
    """
    typed = _typed_children(pages, "page_ground", "lines", "line_id", "output_box", "text")
    typed = typed.unionByName(_typed_children(cases, "vision_cases", "regions", "region_id", "bounding_box", None))
    return typed.unionByName(_as(_payload_children(payloads, False), _CHILD_SCHEMA))


def nested_parents(pages: DataFrame, cases: DataFrame, payloads: DataFrame) -> DataFrame:
    """Flat table of pages and cases; a payload gives one row per page or case it holds."""
    own = [
        _as(pages.withColumns({"tbl": F.lit("page_ground"), "parent_pos": F.lit(0)}), _PARENT_SCHEMA),
        _as(
            cases.withColumns({"tbl": F.lit("vision_cases"), "parent_pos": F.lit(0), "image_path": F.lit(None).cast("string")}),
            _PARENT_SCHEMA,
        ),
    ]
    base = ("[]",)
    outputs = {"parent_pos": (*base, "place")}
    outputs |= {n: (*base, n) for n in ("page_id", "layout_family", "image_path", "expected_blank", "expected_line_count")}
    schema = _parse_datatype_string(
        "record_id bigint, parent_pos int, page_id string, layout_family string, image_path string, "
        "expected_blank boolean, expected_line_count bigint"
    )
    flat = shred_tables(payloads, ["record_id"], "payload", base, schema, outputs, ["parent_row"], prepare=parse_payloads)
    own.append(_as(flat.withColumn("tbl", F.lit("raw_records")), _PARENT_SCHEMA))
    return own[0].unionByName(own[1]).unionByName(own[2])


def boxed_children(pages: DataFrame, cases: DataFrame, payloads: DataFrame) -> DataFrame:
    """(tbl, record_id, parent_pos, child_pos) of every line or region whose box is whole."""
    typed = _typed_boxes(pages, "page_ground", "lines", "output_box")
    typed = typed.unionByName(_typed_boxes(cases, "vision_cases", "regions", "bounding_box"))
    return typed.unionByName(_payload_children(payloads, True).select("tbl", "record_id", "parent_pos", "child_pos"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, sf_dir, n) for n in ("page_ground", "vision_cases", "raw_records"))  # type: ignore[return-value]


def queries() -> dict:
    return {
        "p1_found": lambda spark, sf_dir: boxed_children(*_tables(spark, sf_dir)),
        "p1_children": lambda spark, sf_dir: nested_children(*_tables(spark, sf_dir)),
        "p1_parents": lambda spark, sf_dir: nested_parents(*_tables(spark, sf_dir)),
        "p1_children_of_tables": lambda spark, sf_dir: nested_children(*_tables(spark, sf_dir)).where("tbl <> 'raw_records'"),
        "p1_parents_of_tables": lambda spark, sf_dir: nested_parents(*_tables(spark, sf_dir)).where("tbl <> 'raw_records'"),
    }


def oracle_sql() -> dict:
    """The two typed tables; payloads in many forms of JSON are beyond SQL and tested against counted cases."""
    def children(tbl: str, column: str, child: str, box: str, text: str) -> str:
        numbers = ", ".join(f"l.{n}::bigint as {n}" for n in ("column_index", "reading_order_index"))
        sides = ", ".join(f"l.{box}.{n}::bigint as {n}" for n in _BOX)
        return f"""select '{tbl}' as tbl, record_id, 0 as parent_pos, (pos - 1)::int as child_pos, l.{child} as child_id, {text} as text, l.region_kind as region_kind, {numbers}, {sides}
          from (select record_id, unnest({column}) as l, generate_subscripts({column}, 1) as pos from {tbl})"""

    parents = "0 as parent_pos, page_id, layout_family, {} as image_path, expected_blank, expected_line_count::bigint as expected_line_count"
    return {
        "p1_children_of_tables": children("page_ground", "lines", "line_id", "output_box", "l.text")
        + " union all " + children("vision_cases", "regions", "region_id", "bounding_box", "null::varchar"),
        "p1_parents_of_tables": f"""select 'page_ground' as tbl, record_id, {parents.format("image_path")} from page_ground
          union all select 'vision_cases', record_id, {parents.format("null::varchar")} from vision_cases""",
    }
