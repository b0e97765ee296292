"""Columnar shredding of nested records.

A nested column is taken apart into one stream per leaf path. Every entry of a stream has a
repetition level (how many lists of the path go on from the entry before; 0 starts a record) and
a definition level (how much of the path is there). Flat tables are put together again per
repeated ancestor from the level sequences alone: record number and place within every list are
running counts over the repetition levels.

Everything works on Arrow arrays with NumPy, one batch at a time, without a shuffle: a record
lies in one row, so both directions are local to it. Levels follow the public record-shredding
scheme of columnar formats: an optional node adds one definition level, a list one more for
being non-empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

ELEMENT = "[]"
Path = tuple[str, ...]


@dataclass(frozen=True)
class Leaf:
    """A leaf path with its highest levels."""

    path: Path
    type: pa.DataType
    max_rep: int
    max_def: int


@dataclass(frozen=True)
class Stream:
    """Level sequences and the defined values of one leaf."""

    leaf: Leaf
    rep: np.ndarray
    defn: np.ndarray
    values: pa.Array


def leaves(kind: pa.DataType, path: Path = (), rep: int = 0, defn: int = 1) -> list[Leaf]:
    """All leaf paths below a type; every node counts as optional."""
    if pa.types.is_struct(kind):
        return [leaf for field in kind for leaf in leaves(field.type, (*path, field.name), rep, defn + 1)]
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return leaves(kind.value_type, (*path, ELEMENT), rep + 1, defn + 2)
    return [Leaf(path, kind, rep, defn)]


def _valid(array: pa.Array) -> np.ndarray:
    if array.null_count == 0:
        return np.ones(len(array), dtype=bool)
    return array.is_valid().to_numpy(zero_copy_only=False)


def shred(array: pa.Array, leaf: Leaf) -> Stream:
    """The stream of one leaf over a batch of records.

    A null or missing part ends the entry at its definition level; an empty list is one entry;
    null elements are entries of their own. An empty batch gives an empty stream.
    """
    n = len(array)
    rep = np.zeros(n, dtype=np.uint8)
    defn = np.zeros(n, dtype=np.uint8)
    at = np.arange(n, dtype=np.int64)
    live = np.ones(n, dtype=bool)
    depth = 0

    def enter(node: pa.Array) -> None:
        ok = _valid(node)
        there = live.copy()
        there[live] = ok[at[live]]
        defn[there] += 1
        live[:] = there

    enter(array)
    for step in leaf.path:
        if step != ELEMENT:
            array = array.field(step)
            enter(array)
            continue
        depth += 1
        offsets = array.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        length = np.zeros(len(at), dtype=np.int64)
        length[live] = offsets[at[live] + 1] - offsets[at[live]]
        filled = live & (length > 0)
        copies = np.where(filled, length, 1)
        source = np.repeat(np.arange(len(at)), copies)
        first = np.zeros(len(source), dtype=bool)
        starts = np.cumsum(copies) - copies
        first[starts] = True
        within = np.arange(len(source)) - np.repeat(starts, copies)
        begin = np.zeros(len(at), dtype=np.int64)
        begin[filled] = offsets[at[filled]]
        rep = np.where(first, rep[source], np.uint8(depth)).astype(np.uint8)
        defn = (defn[source] + filled[source]).astype(np.uint8)
        live = filled[source]
        at = begin[source] + within
        array = array.values
        enter(array)
    return Stream(leaf, rep, defn, array.take(pa.array(at[live])))


def shred_all(array: pa.Array) -> dict[Path, Stream]:
    """The streams of all leaves of a nested array."""
    return {leaf.path: shred(array, leaf) for leaf in leaves(array.type)}


def places(stream: Stream, ancestor: Path) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rows of the table of a repeated ancestor, found from a leaf's levels.

    Gives the entries that start an element of the ancestor, their record numbers, and for every
    list on the way the 0-based place of the element in it.
    """
    depth = ancestor.count(ELEMENT)
    needed = len(ancestor) + depth  # node levels of the ancestor's path, its element itself not yet entered
    rows = np.flatnonzero((stream.rep <= depth) & (stream.defn >= needed))
    record = np.cumsum(stream.rep == 0) - 1
    ordinals = []
    for level in range(1, depth + 1):
        count = np.cumsum(stream.rep == level)
        restart = np.maximum.accumulate(np.where(stream.rep < level, np.arange(len(count)), 0)) if len(count) else count
        ordinals.append((count - count[restart])[rows] if len(count) else rows)
    return rows, record[rows], ordinals


def column(stream: Stream, rows: np.ndarray) -> pa.Array:
    """The leaf's value at each of the given entries, null where it isn't defined."""
    defined = stream.defn == stream.leaf.max_def
    position = np.cumsum(defined) - 1
    index = pa.array(position[rows], mask=~defined[rows])
    return stream.values.take(index)


def assemble(streams: dict[Path, Stream], ancestor: Path) -> tuple[np.ndarray, list[np.ndarray], dict[Path, pa.Array]]:
    """Flat table of a repeated ancestor: record numbers, places and the leaves it holds directly.

    The streams of leaves below a deeper list are left to that list's own table, which the places
    link to this one.
    """
    depth = ancestor.count(ELEMENT)
    own = {p: s for p, s in streams.items() if p[: len(ancestor)] == ancestor and s.leaf.max_rep == depth}
    anchor = next(iter(own.values()), None) or next(s for p, s in streams.items() if p[: len(ancestor)] == ancestor)
    _, record, ordinals = places(anchor, ancestor)
    return record, ordinals, {p: column(s, places(s, ancestor)[0]) for p, s in own.items()}


def inherited(stream: Stream, anchor: Stream, ancestor: Path) -> pa.Array:
    """A leaf of an outer list (or of the record) for every row of a deeper ancestor's table."""
    depth = stream.leaf.max_rep
    last = len(stream.leaf.path) - 1 - stream.leaf.path[::-1].index(ELEMENT) if depth else -1
    outer = stream.leaf.path[: last + 1]
    values = column(stream, places(stream, outer)[0]) if depth else column(stream, np.flatnonzero(stream.rep == 0))
    starts = (anchor.rep <= depth) & (anchor.defn >= len(outer) + depth)
    owner = np.cumsum(starts) - 1
    return values.take(pa.array(owner[places(anchor, ancestor)[0]]))


def rebuild(kind: pa.DataType, streams: dict[Path, Stream]) -> pa.Array:
    """The nested array again, from its streams alone: the inverse of ``shred_all``."""

    def build(kind: pa.DataType, path: Path, rep: int, defn: int, slots: dict[Path, np.ndarray]) -> pa.Array:
        mine = {p: s for p, s in slots.items() if p[: len(path)] == path}
        lead = next(iter(mine))
        present = streams[lead].defn[mine[lead]] > defn
        if pa.types.is_struct(kind):
            children = [build(f.type, (*path, f.name), rep, defn + 1, mine) for f in kind]
            return pa.StructArray.from_arrays(children, fields=list(kind), mask=pa.array(~present))
        if pa.types.is_list(kind) or pa.types.is_large_list(kind):
            inner = {}
            for p in mine:
                s = streams[p]
                inner[p] = np.flatnonzero((s.rep <= rep + 1) & (s.defn >= defn + 2))
            owner = np.searchsorted(mine[lead], inner[lead], side="right") - 1
            lengths = np.bincount(owner, minlength=len(mine[lead]))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            values = build(kind.value_type, (*path, ELEMENT), rep + 1, defn + 2, inner)
            return pa.ListArray.from_arrays(pa.array(offsets), values, type=pa.list_(kind.value_field), mask=pa.array(~present))
        return column(streams[path], mine[path])

    return build(kind, (), 0, 0, {p: np.flatnonzero(s.rep == 0) for p, s in streams.items()})


def shred_tables(
    df: DataFrame,
    keys: Sequence[str],
    column_name: str,
    ancestor: Path,
    schema: StructType,
    outputs: dict[str, Path],
    ordinals: Sequence[str],
    prepare: Callable[[pa.Array], pa.Array] | None = None,
    keep: Callable[[pa.Table], pa.Array] | None = None,
) -> DataFrame:
    """Flat table of one repeated ancestor of a nested column, linked by key and place.

    df          any frame; only ``keys`` and ``column_name`` are read (clashing extra columns do not matter)
    keys        columns that identify the record; they are copied to every child row
    ancestor    path of the repeated element, ending in ``[]``
    outputs     output column -> leaf path (relative to the record); leaves of outer lists repeat
    ordinals    names of the place columns, outermost list first
    prepare     turns the raw column into a nested Arrow array first (payloads)
    keep        row filter on the flat table

    Null records, null and empty lists give no rows; null elements keep their place and give a row
    of nulls. One pass, no shuffle, memory bound by the Arrow batch.
    """
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = batch.column(len(keys))
            if prepare is not None:
                array = prepare(array)
            wanted = set(outputs.values())
            streams = {leaf.path: shred(array, leaf) for leaf in leaves(array.type) if leaf.path in wanted}
            record, at, columns = assemble(streams, ancestor)
            deep = [p for p in columns if streams[p].leaf.max_rep == ancestor.count(ELEMENT)]
            for path in wanted - set(columns):
                columns[path] = inherited(streams[path], streams[deep[0]], ancestor)
            data: dict[str, pa.Array] = {k: batch.column(i).take(pa.array(record)) for i, k in enumerate(keys)}
            data |= {name: pa.array(place.astype(np.int32)) for name, place in zip(ordinals, at)}
            data |= {name: columns[path] for name, path in outputs.items()}
            flat = pa.table({n: data[n] for n in names})
            if keep is not None:
                flat = flat.filter(keep(flat))
            yield from flat.to_batches()

    return df.select(*keys, column_name).mapInArrow(run, schema)
