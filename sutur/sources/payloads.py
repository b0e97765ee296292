"""JSON payloads as received: pages and vision cases in uneven forms, read into one nested type."""

from __future__ import annotations

import json
import re
from typing import Any

import pyarrow as pa

BOX = pa.struct([(n, pa.int64()) for n in ("x", "y", "width", "height")] + [("whole", pa.bool_())])
CHILD = pa.struct(
    [
        ("child_id", pa.string()),
        ("text", pa.string()),
        ("region_kind", pa.string()),
        ("column_index", pa.int64()),
        ("reading_order_index", pa.int64()),
        ("box", BOX),
    ]
)
PARENT = pa.struct(
    [
        ("kind", pa.string()),
        ("place", pa.int32()),
        ("page_id", pa.string()),
        ("layout_family", pa.string()),
        ("image_path", pa.string()),
        ("expected_blank", pa.bool_()),
        ("expected_line_count", pa.int64()),
        ("children", pa.list_(CHILD)),
    ]
)
RECORD = pa.list_(PARENT)

_DIGITS = re.compile(r"[0-9]+\Z")
_INT64 = 1 << 63


def _refuse(_: str) -> None:
    raise ValueError("not a JSON number")


def _loads(text: str) -> Any:
    """Strict JSON, or None: NaN and Infinity are no JSON."""
    try:
        return json.loads(text, parse_constant=_refuse, parse_int=lambda n: int(n) if len(n) < 100 else _INT64)
    except (ValueError, RecursionError):
        return None


def _open(value: Any) -> Any:
    """A string that holds JSON counts as that JSON, also when wrapped several times."""
    while isinstance(value, str):
        value = _loads(value)
    return value


def _number(value: Any) -> int | None:
    """A whole number from a JSON number or a string of ASCII digits, of any size; booleans are none. What is too long is told by its size only."""
    if isinstance(value, bool):
        return None
    if isinstance(value, str):
        if not _DIGITS.match(value):
            return None
        digits = value.lstrip("0") or "0"
        return int(digits) if len(digits) < 100 else _INT64
    if isinstance(value, float):
        value = int(value) if value.is_integer() else None
    return value if isinstance(value, int) else None


def _whole(value: Any) -> int | None:
    """A whole number that fits bigint."""
    value = _number(value)
    return value if value is not None and -_INT64 <= value < _INT64 else None


def _text(value: Any) -> str | None:
    return value if isinstance(value, str) else None


def _box(value: Any) -> dict[str, int | None] | None:
    value = _open(value)
    if isinstance(value, list):
        value = dict(zip(("x", "y", "width", "height"), value)) if len(value) == 4 else None
    if not isinstance(value, dict):
        return None
    names = ("x", "y", "width", "height")
    return {n: _whole(value.get(n)) for n in names} | {"whole": all(_number(value.get(n)) is not None for n in names)}


def _full(box: dict[str, int | None] | None) -> bool:
    return box is not None and bool(box["whole"])


def _child(value: Any) -> dict[str, Any] | None:
    value = _open(value)
    if not isinstance(value, dict):
        return None
    box = _box(value.get("output_box"))
    other = box if _full(box) else _box(value.get("bounding_box"))
    return {
        "child_id": _text(value.get("line_id")) or _text(value.get("region_id")),
        "text": _text(value.get("text")),
        "region_kind": _text(value.get("region_kind")),
        "column_index": _whole(value.get("column_index")),
        "reading_order_index": _whole(value.get("reading_order_index")),
        "box": other if other is not None else box,
    }


def _elements(value: Any) -> list[Any] | None:
    """A list as it is; a lone object is a list of one; anything else is missing."""
    value = _open(value)
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else None


def _parent(value: Any, kind: str | None, place: int) -> list[dict[str, Any]]:
    value = _open(value)
    if not isinstance(value, dict):
        return []
    rows = []
    for name, own in (("lines", "page"), ("regions", "case")):
        if name in value or (kind == own and not ({"lines", "regions"} & value.keys())):
            found = _elements(value.get(name))
            rows.append(
                {
                    "kind": own,
                    "place": place,
                    "page_id": _text(value.get("page_id")),
                    "layout_family": _text(value.get("layout_family")),
                    "image_path": _text(value.get("image_path")),
                    "expected_blank": value.get("expected_blank") if isinstance(value.get("expected_blank"), bool) else None,
                    "expected_line_count": _whole(value.get("expected_line_count")),
                    "children": None if found is None else [_child(x) for x in found],
                }
            )
    return rows


def parse_payload(payload: str | None) -> list[dict[str, Any]] | None:
    """Parents of one payload with their children, null for what is no JSON object.

    A parent keeps its place in ``pages`` or ``cases`` (0 for a payload that is one itself). Null
    and foreign elements of ``lines`` and ``regions`` stay as null children, so places count them.
    Objects nested deeper than lines and regions are not looked at.
    """
    record = _open(payload) if payload is not None else None
    if not isinstance(record, dict):
        return None
    rows = []
    for name, kind in (("pages", "page"), ("cases", "case")):
        for place, value in enumerate(_elements(record.get(name)) or []):
            rows += _parent(value, kind, place)
    if "pages" not in record and "cases" not in record:
        rows += _parent(record, "case" if "case_family" in record else "page", 0)
    elif {"lines", "regions"} & record.keys():
        rows += _parent(record, None, 0)
    return rows


def parse_payloads(payloads: pa.Array) -> pa.Array:
    """A batch of payloads as one nested Arrow array."""
    return pa.array([parse_payload(p) for p in payloads.to_pylist()], type=RECORD)
