"""Shredding: exact round trips, places, payload forms."""

import json
import random

import pyarrow as pa

from sutur.operators.shredding import assemble, leaves, rebuild, shred_all
from sutur.plans.nested import boxed_children, nested_children, nested_parents
from sutur.sources.payloads import parse_payload

BOX = pa.struct([("x", pa.int32()), ("y", pa.int32())])
KIND = pa.list_(pa.struct([("id", pa.string()), ("box", BOX), ("words", pa.list_(pa.struct([("w", pa.string()), ("n", pa.int32())])))]))


def _value(kind, rng):
    if rng.random() < 0.2:
        return None
    if pa.types.is_list(kind):
        return [_value(kind.value_type, rng) for _ in range(rng.randint(0, 3))]
    if pa.types.is_struct(kind):
        return {f.name: _value(f.type, rng) for f in kind}
    return "a" if pa.types.is_string(kind) else rng.randint(0, 9)


def test_round_trip_of_random_records_also_when_sliced():
    rng = random.Random(7)
    for _ in range(300):
        whole = pa.array([_value(KIND, rng) for _ in range(rng.randint(0, 8))], type=KIND)
        for array in (whole, whole.slice(len(whole) // 3, len(whole) // 2)):
            assert rebuild(KIND, shred_all(array)).to_pylist() == array.to_pylist()


def test_leaves_have_levels():
    found = {leaf.path: (leaf.max_rep, leaf.max_def) for leaf in leaves(KIND)}
    assert found[("[]", "id")] == (1, 4)
    assert found[("[]", "words", "[]", "n")] == (2, 7)


def test_places_count_null_elements():
    array = pa.array([[{"id": "p"}, None, {"id": "q"}], None, [], [{"id": "z"}]], type=pa.list_(pa.struct([("id", pa.string())])))
    record, places, columns = assemble(shred_all(array), ("[]",))
    assert record.tolist() == [0, 0, 0, 3]
    assert places[0].tolist() == [0, 1, 2, 0]
    assert columns[("[]", "id")].to_pylist() == ["p", None, "q", "z"]


def _boxes(payload):
    return [
        (p["place"], i) for p in parse_payload(payload) or [] for i, c in enumerate(p["children"] or [])
        if c and c["box"] and None not in c["box"].values()
    ]


def test_payload_forms():
    full = {"x": 1, "y": 2, "width": 3, "height": 4}
    assert _boxes(json.dumps({"lines": [{"output_box": full}, None, {"output_box": [1, 2, 3, 4]}, {"output_box": [1, 2, 3]}]})) == [(0, 0), (0, 2)]
    assert _boxes(json.dumps({"pages": [{"lines": None}, {"lines": {"output_box": full}}]})) == [(1, 0)]
    assert _boxes(json.dumps({"cases": [{"regions": json.dumps([{"bounding_box": json.dumps(full)}])}]})) == [(0, 0)]
    assert _boxes(json.dumps(json.dumps({"regions": [{"bounding_box": {k: str(v) for k, v in full.items()}}]}))) == [(0, 0)]
    for bad in (True, 1.5, "wide", "", "1 ", None, [], "-1", "+1", "1.0"):
        assert _boxes(json.dumps({"lines": [{"output_box": full | {"x": bad}}]})) == []
    assert _boxes(json.dumps({"lines": [{"output_box": full | {"x": 2.0}}]})) == [(0, 0)]
    assert _boxes(json.dumps({"lines": [{"words": [{"output_box": [1, 2, 3, 4]}]}]})) == []
    for broken in (None, "", "{", "[1]", "3", '{"lines":[{"output_box":[1,2,3,NaN]}]}', "null"):
        assert _boxes(broken) == []


def test_tables_and_empty_tables(spark):
    line = "struct<line_id:string,text:string,output_box:struct<x:int,y:int,width:int,height:int>,region_kind:string,column_index:int,reading_order_index:int>"
    region = "struct<region_id:string,bounding_box:struct<x:int,y:int,width:int,height:int>,column_index:int,reading_order_index:int,region_kind:string>"
    head = "page_id string, layout_family string, expected_blank boolean, expected_line_count int"
    pages = spark.createDataFrame(
        [(1, [("a", "t", (1, 2, 3, 4), "line", 0, 0), None, ("b", "u", (1, None, 3, 4), "line", 0, 1)], "p", "f", False, 2, "i", "clash"), (1, None, "p", "f", False, 0, "i", "x")],
        f"record_id bigint, lines array<{line}>, {head}, image_path string, child_pos string",
    )
    cases = spark.createDataFrame([], f"record_id bigint, regions array<{region}>, {head}")
    payloads = spark.createDataFrame([(5, '{"lines":[{"output_box":[1,2,3,4],"line_id":"k"}]}'), (6, None), (6, "x")], "record_id bigint, payload string")
    found = {tuple(r) for r in boxed_children(pages, cases, payloads).collect()}
    assert found == {("page_ground", 1, 0, 0), ("raw_records", 5, 0, 0)}
    children = nested_children(pages, cases, payloads).collect()
    assert sorted((r.tbl, r.child_pos, r.child_id) for r in children if r.tbl == "page_ground" and r.child_id) == [("page_ground", 0, "a"), ("page_ground", 2, "b")]
    assert len(children) == 4
    assert nested_parents(pages, cases, payloads).count() == 3
    none = spark.createDataFrame([], pages.schema)
    assert boxed_children(none, cases, payloads.limit(0)).count() == 0


def test_whole_numbers_of_any_length(spark):
    forms = ['"%s7"' % ("0" * 30), '"9000000000000000000"', '"%s"' % ("9" * 5000), "9" * 5000, "7.5", '"7x"', "true"]
    payloads = spark.createDataFrame([(i, '{"lines":[{"output_box":[1,2,3,%s]}]}' % f) for i, f in enumerate(forms)], "record_id bigint, payload string")
    wrapped = '{"lines":[{"output_box":[1,2,3,4]}]}'
    for _ in range(10):
        wrapped = json.dumps(wrapped)
    payloads = payloads.union(spark.createDataFrame([(9, wrapped)], payloads.schema))
    line = "struct<line_id:string,text:string,output_box:struct<x:int,y:int,width:int,height:int>,region_kind:string,column_index:int,reading_order_index:int>"
    region = "struct<region_id:string,bounding_box:struct<x:int,y:int,width:int,height:int>,region_kind:string,column_index:int,reading_order_index:int>"
    pages = spark.createDataFrame([], f"record_id bigint, lines array<{line}>")
    cases = spark.createDataFrame([], f"record_id bigint, regions array<{region}>")
    assert sorted(r.record_id for r in boxed_children(pages, cases, payloads).collect()) == [0, 1, 2, 3, 9]
    heights = {r.record_id: r.height for r in nested_children(pages, cases, payloads).collect()}
    assert heights == {0: 7, 1: 9 * 10**18, 2: None, 3: None, 4: None, 5: None, 6: None, 9: 4}
