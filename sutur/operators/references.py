"""Orphan references by a linear merge of references and parent validity intervals.

References and parents are put into one stream, range-partitioned and sorted by (field, key,
time). One forward pass keeps, for the key at hand, the latest end of any interval that has begun;
a reference is live exactly if that end lies after its time. Since the range partitioning includes
the time and the row, a key with a third of all rows is spread over many tasks; what a task must
know about its first key from the tasks before is one small row per task, joined afterwards.

Kinds of orphans:
  missing  no parent has the key at all (rejected keys too)
  deleted  every parent that began by then had ended
  late     parents exist, all begin after the reference
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutur.session import materialize

_MIN = np.iinfo(np.int64).min
_FOREVER = "9999-12-31 23:59:59.999999"
_EXISTS, _PARENT, _REFERENCE = 0, 1, 2
_OUT = (
    "pid int, edge boolean, ref_field string, row_id bigint, at timestamp_ntz, micros bigint, head boolean, until bigint, exists boolean, "
    "first_key string, last_field string, last_key string"
)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forward pass over one sorted partition. Emits undecided or orphan references and one edge row."""
    context = TaskContext.get()
    pid = context.partitionId() if context else 0
    schema = _arrow_schema()
    first: tuple | None = None
    last: tuple | None = None
    until, exists, whole = _MIN, False, True
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        field, key = batch.column("ref_field"), batch.column("key")
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        at = batch.column("at").cast(pa.int64()).fill_null(int(_MIN)).to_numpy(zero_copy_only=False)
        ends = batch.column("until").cast(pa.int64()).fill_null(int(_MIN)).to_numpy(zero_copy_only=False)
        codes = pd.factorize(pd.MultiIndex.from_arrays([field.to_pandas(), key.to_pandas()]))[0]
        new = np.concatenate([[True], codes[1:] != codes[:-1]])
        group = np.cumsum(new) - 1
        start = (field[0].as_py(), key[0].as_py())
        if first is None:
            first = start
        running = pd.Series(np.where(kind == _PARENT, ends, _MIN))
        seen = pd.Series((kind == _EXISTS).astype(np.int8))
        if last == start:  # the key goes on from the batch before
            running.iloc[0] = max(running.iloc[0], until)
            seen.iloc[0] = max(seen.iloc[0], int(exists))
        running = running.groupby(group).cummax().to_numpy()
        seen = seen.groupby(group).cummax().to_numpy().astype(bool)
        head = np.array([(field[i].as_py(), key[i].as_py()) == first for i in np.flatnonzero(new)])[group]
        emit = np.flatnonzero((kind == _REFERENCE) & ~(running > at))
        last = (field[n - 1].as_py(), key[n - 1].as_py())
        until, exists = int(running[-1]), bool(seen[-1])
        whole = whole and last == first
        if len(emit):
            take = pa.array(emit)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(emit), pid, dtype=np.int32)),
                    pa.array(np.zeros(len(emit), dtype=bool)),
                    field.take(take).cast(pa.string()),
                    batch.column("row_id").take(take),
                    batch.column("at").take(take),
                    pa.array(at[emit]),
                    pa.array(head[emit]),
                    pa.array(running[emit]),
                    pa.array(seen[emit]),
                    pa.nulls(len(emit), pa.string()),
                    pa.nulls(len(emit), pa.string()),
                    pa.nulls(len(emit), pa.string()),
                ],
                schema=schema,
            )
    if first is not None:
        row = {
            "pid": [pid], "edge": [True], "ref_field": [first[0]], "row_id": [None], "at": [None], "micros": [None], "head": [whole],
            "until": [until], "exists": [exists], "first_key": [first[1]], "last_field": [last[0]], "last_key": [last[1]],
        }
        yield pa.RecordBatch.from_pydict(row, schema=schema)


def _arrow_schema() -> pa.Schema:
    return pa.schema(
        [
            ("pid", pa.int32()), ("edge", pa.bool_()), ("ref_field", pa.string()), ("row_id", pa.int64()),
            ("at", pa.timestamp("us")), ("micros", pa.int64()), ("head", pa.bool_()), ("until", pa.int64()), ("exists", pa.bool_()),
            ("first_key", pa.string()), ("last_field", pa.string()), ("last_key", pa.string()),
        ]
    )


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a parent live at their time, each with its kind.

    references  ref_field string, key string, row_id bigint, at timestamp_ntz
    parents     ref_field string, key string, begins timestamp_ntz, ends timestamp_ntz
    result      ref_field, row_id, at, kind

    A null key of a reference stands for a rejected one and is missing. A null time of a reference
    lies before every parent. A parent with a null key is nobody's target, one with a null begin is
    never live but exists, a null end means for ever. Ties: a parent that begins at the time of the
    reference is live, one that ends at it is not. Repeated rows and empty tables are fine; other
    columns of the inputs are not read.
    """
    spark = references.sparkSession
    no_time = F.lit(None).cast("timestamp_ntz")
    known = parents.where(F.col("key").isNotNull())
    intervals = (
        known.where(F.col("begins").isNotNull())
        .withColumn("until", F.coalesce("ends", F.lit(_FOREVER).cast("timestamp_ntz")))
        .groupBy("ref_field", "key", F.col("begins").alias("at"))
        .agg(F.max("until").alias("until"))
        .select("ref_field", "key", "at", F.lit(_PARENT).alias("kind"), "until", F.lit(None).cast("bigint").alias("row_id"))
    )
    marks = known.groupBy("ref_field", "key").agg(F.lit(0).alias("_")).select(
        "ref_field", "key", no_time.alias("at"), F.lit(_EXISTS).alias("kind"),
        no_time.alias("until"), F.lit(None).cast("bigint").alias("row_id"),
    )
    asked = references.where(F.col("key").isNotNull()).select(
        "ref_field", "key", "at", F.lit(_REFERENCE).alias("kind"), no_time.alias("until"), "row_id"
    )
    order = ["ref_field", "key", "at", "kind", "row_id"]  # null times first: marks, then references without a time
    stream = asked.unionByName(intervals).unionByName(marks).select(*order, "until")
    merged = stream.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_merge, _OUT)
    merged = materialize(merged, "references")

    # One row per task: what the key that a task begins with has seen in the tasks before.
    edges = sorted(merged.where("edge").collect(), key=lambda r: r.pid)
    carried, state = [], None
    for e in edges:
        goes_on = state is not None and state[0] == (e.ref_field, e.first_key)
        if goes_on:
            carried.append((e.pid, state[1], state[2]))
        until, exists = e.until, e.exists
        if goes_on and e.head:  # the whole task is the one key
            until, exists = max(until, state[1]), exists or state[2]
        state = ((e.last_field, e.last_key), until, exists)
    carry = spark.createDataFrame(carried, "pid int, until_before bigint, exists_before boolean")

    found = merged.where("not edge").join(F.broadcast(carry), "pid", "left")
    before = F.when(F.col("head"), F.col("until_before"))
    until = F.greatest(F.col("until"), F.coalesce(before, F.lit(int(_MIN))))
    exists = F.col("exists") | F.coalesce(F.when(F.col("head"), F.col("exists_before")), F.lit(False))
    kind = F.when(until > F.lit(int(_MIN)), "deleted").when(exists, "late").otherwise("missing")
    orphans = found.where(until <= F.col("micros")).select("ref_field", "row_id", "at", kind.alias("kind"))
    rejected = references.where(F.col("key").isNull()).select("ref_field", "row_id", "at", F.lit("missing").alias("kind"))
    return orphans.unionByName(rejected)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphans per table, field, month and kind; the month of a null time is null."""
    month = F.date_format("at", "yyyy-MM")
    return (
        orphans.groupBy(F.split_part("ref_field", F.lit("."), F.lit(1)).alias("tbl"), "ref_field", month.alias("month"), "kind")
        .agg(F.count(F.lit(1)).alias("n"))
    )
