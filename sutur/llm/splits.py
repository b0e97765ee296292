"""Splits that keep related records together.

Related documents form components (alike ids, or a shared entity). Components are found by
alternating star contraction, every round written to the shared folder. They are then balanced
into many equal bins by largest differencing: the state is a set of tuples of bin loads, and
combining two tuples pairs the heaviest bins of one with the lightest of the other. Tasks do this
for their share of the components; the tuples of the tasks are combined in the same way. Whole
bins are allocated to the splits by target proportion.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutur.functions.text import alike, strip_blanks
from sutur.session import drop_materialized, materialize, plain_strings

#: Equal bins that whole components are balanced into; components that one task balances; tuples combined in one task.
BINS = 100
SHARE = 50_000
FAN_IN = 256
# Entity ids that stand for "not known", in canonical spelling.
NOT_KNOWN = ("unknown", "n/a", "-")
_ROUNDS = 60
#: A key with more than one such part of all rows is joined by a broadcast of its one row, at most so many rows; only the others are shuffled.
HOT_KEYS = 64
ONE_TASK = 200_000


def join_least(rows: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows``, a written table, with ``per_key``: one row per key, with the number ``n`` of its rows; ``n`` is dropped.

    The few keys that hold a large part of the rows don't go through the shuffle, so a hub is spread
    over as many tasks as its rows lie in. Tables that one task can take are joined as they are.
    """
    if rows.count() <= ONE_TASK:
        return rows.join(per_key.drop("n").hint("merge"), key)
    per_key = materialize(per_key, "per-key")
    total, most = per_key.agg(F.sum("n"), F.max("n")).head()
    if not total or most * HOT_KEYS <= total:
        return rows.join(per_key.drop("n").hint("merge"), key)
    hot = per_key.where(F.col("n") * HOT_KEYS > total).drop("n")
    known = rows.sparkSession.createDataFrame(hot.collect(), hot.schema)  # fewer than HOT_KEYS rows
    broad = rows.join(F.broadcast(known), key)
    narrow = rows.join(F.broadcast(known.select(key)), key, "left_anti").join(per_key.drop("n").hint("merge"), key)
    return broad.unionByName(narrow)


def current_partitions(assignments: DataFrame) -> DataFrame:
    """(document_id, partition) by the latest assigned_at (ties: the larger assignment_id).

    The partition is read without letter case and outer blanks; ``val`` is validation. Documents
    whose current partition is null or blank have no row, nor has the null document.
    """
    latest = assignments.where("document_id is not null").groupBy("document_id").agg(
        F.max_by("partition", F.struct("assigned_at", "assignment_id")).alias("raw")
    )
    name = F.lower(strip_blanks(F.col("raw")))
    return latest.select("document_id", F.when(name == "val", "validation").when(name != "", name).alias("partition")).where(
        "partition is not null"
    )


def _key_edges(documents: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical keys of the documents, and edges from a key to the smallest key of a shared entity."""
    keys = documents.select(alike(F.col("document_id")).alias("key")).distinct()
    entity = alike(F.col("entity_id"))
    links = (
        entities.select(alike(F.col("document_id")).alias("key"), F.struct("entity_kind", entity.alias("id")).alias("entity"))
        .where(F.col("key").isNotNull() & (F.col("entity.id") != "") & ~F.col("entity.id").isin(*NOT_KNOWN) & F.col("entity.entity_kind").isNotNull())
        .distinct()
        .join(keys, "key", "left_semi")
    )
    links = materialize(links, "links")
    least = links.groupBy("entity").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"))
    edges = join_least(links, least, "entity").where("key <> least").select("key", "least").distinct()
    return keys, edges


def connected(edges: DataFrame) -> DataFrame:
    """(key, least): the smallest key of the component of every key with a smaller one in it.

    Large-star and small-star rounds until nothing changes. Every round joins the edges with one
    pre-aggregated row per node, hubs apart from the shuffle, so no task ever holds all neighbours of
    a hub, and is written to the shared folder. ``edges`` are (key, least) pairs with key > least.
    """
    current = materialize(edges, "stars")
    sign = None
    for _ in range(_ROUNDS):
        both = current.select(F.col("key").alias("u"), F.col("least").alias("v")).unionByName(
            current.select(F.col("least").alias("u"), F.col("key").alias("v"))
        )
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_least(both.where("v > u"), low, "u").where("v <> m").select(F.col("v").alias("key"), F.col("m").alias("least")).distinct()
        large = materialize(large, "stars")
        low = large.groupBy("key").agg(F.min("least").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_least(large, low, "key").where("least <> m").select(F.col("least").alias("key"), F.col("m").alias("least"))
        small = small.unionByName(low.select("key", F.col("m").alias("least"))).distinct()
        after = materialize(small, "stars")
        now = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("key", "least").cast("decimal(38,0)"))).head())
        for done in (large, current):
            drop_materialized(done)
        current = after
        if now == sign:
            return current
        sign = now
    raise RuntimeError("components did not settle")


def related_groups(manifest: DataFrame, entities: DataFrame) -> DataFrame:
    """(group_id, document_id) for every distinct non-null document_id of the manifest.

    Documents are related if their ids are alike or if they share an entity (by alike ids), also
    through a chain of documents of the manifest. group_id is the smallest document_id of the
    group. Null, blank and not-known entities relate nothing; null kinds neither.
    """
    documents = manifest.select("document_id").where("document_id is not null").distinct()
    _, edges = _key_edges(documents, entities)
    stars = connected(edges)
    keyed = documents.withColumn("key", alike(F.col("document_id")))
    rooted = keyed.join(stars.hint("merge"), "key", "left").select("document_id", F.coalesce("least", "key").alias("root"))
    rooted = materialize(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("document_id").alias("group_id"), F.count(F.lit(1)).alias("n"))
    return materialize(join_least(rooted, names, "root").select("group_id", "document_id"), "groups")


def broken_groups(groups: DataFrame, partitions: DataFrame) -> DataFrame:
    """Rows of the groups whose documents have two or more different current partitions."""
    placed = groups.join(partitions.hint("merge"), "document_id", "left")
    broken = placed.groupBy("group_id").agg(F.min("partition").alias("lo"), F.max("partition").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    return join_least(groups, broken.select("group_id", "n"), "group_id").select("group_id", "document_id")


def differenced(tuples: Sequence[np.ndarray], bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Loads of the bins, and for every tuple the bins that its entries end in: always combine the two tuples of largest spread.

    A tuple is an array of at most ``bins`` loads, the largest first; what it lacks is 0. The heaviest
    bin of one goes with the lightest of the other. Ties are broken by the order of arrival. A
    combination keeps two small arrays, its parts and where its bins come from; what lies where is read off on the way back.
    """
    if not len(tuples):
        return np.zeros(bins, dtype=np.int64), []
    spread = lambda loads: int(loads[-1] if len(loads) == bins else 0) - int(loads[0])
    heap = [(spread(loads), order) for order, loads in enumerate(tuples)]
    heapq.heapify(heap)
    loads: dict[int, np.ndarray] = {}
    parts: list[tuple[int, int, np.ndarray]] = []

    def taken(node: int) -> np.ndarray:
        if node >= len(tuples):
            return loads.pop(node)
        whole = np.zeros(bins, dtype=np.int64)
        whole[: len(tuples[node])] = tuples[node]
        return whole

    while len(heap) > 1:
        one, two = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        merged = taken(one) + taken(two)[::-1]
        order = np.argsort(-merged, kind="stable").astype(np.int16)
        node = len(tuples) + len(parts)
        parts.append((one, two, order))
        loads[node] = merged[order]
        heapq.heappush(heap, (spread(loads[node]), node))
    root = heap[0][1]
    total = taken(root)
    places: list[np.ndarray] = [np.zeros(0, dtype=np.int16)] * len(tuples)
    pending = [(root, np.arange(bins, dtype=np.int16))]
    while pending:
        node, ends = pending.pop()
        if node < len(tuples):
            places[node] = ends[: len(tuples[node])]
            continue
        one, two, order = parts[node - len(tuples)]
        before = np.empty_like(ends)
        before[order] = ends
        pending += [(one, before), (two, before[::-1])]
    return total, places


def largest_differencing(tuples: list[list[tuple[int, object]]]) -> list[tuple[int, list[object]]]:
    """One tuple of bins from many, as (load, marks): ``differenced`` for lists of (load, mark) of equal length."""
    if not tuples:
        return []
    ordered = [sorted(bins, key=lambda b: -b[0]) for bins in tuples]
    loads, places = differenced([np.array([load for load, _ in bins], dtype=np.int64) for bins in ordered], len(ordered[0]))
    marks: list[list[object]] = [[] for _ in loads]
    for bins, ends in zip(ordered, places):
        for (_, mark), end in zip(bins, ends):
            if mark is not None:
                marks[end].append(mark)
    return [(int(load), found) for load, found in zip(loads, marks)]


def balanced_bins(components: DataFrame, bins: int = BINS, share: int = SHARE) -> DataFrame:
    """(component, weight, bin) with bins 0..bins-1 of nearly equal weight.

    components  component string, weight bigint; components are distinct

    Level 0 balances the components of a share (at most about ``share`` of them) in one task;
    every further level combines the bin tuples of up to FAN_IN shares. Only numbers of bins move
    upwards; the way back down is a join on (share, bin). Nothing is collected.
    """
    total = components.count()
    shares = max(1, -(-total // share))
    placed = components.withColumn("share", F.pmod(F.xxhash64("component"), F.lit(shares)))

    def local(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["weight", "component"], ascending=[False, True], ignore_index=True)
        _, places = differenced(rows["weight"].to_numpy(dtype=np.int64).reshape(-1, 1), bins)
        at = np.array([ends[0] for ends in places], dtype=np.int32)
        return plain_strings(rows.assign(local=at)[["component", "weight", "share", "local"]])

    current = placed.groupBy("share").applyInPandas(local, "component string, weight bigint, share bigint, local int")
    current = materialize(current, "bins")
    while shares > 1:
        loads = current.groupBy("share", "local").agg(F.sum("weight").alias("load"))
        above = -(-shares // FAN_IN)

        def combine(rows: pd.DataFrame) -> pd.DataFrame:
            tuples = []
            for number, own in rows.sort_values(["share", "local"]).groupby("share"):
                loads = {int(b): int(w) for b, w in zip(own["local"], own["load"])}
                tuples.append([(loads.get(b, 0), (int(number), b)) for b in range(bins)])
            found = largest_differencing(tuples)
            out = [(s, b, int(rows["share"].iloc[0]) % above, to) for to, (_, marks) in enumerate(found) for s, b in marks]
            return pd.DataFrame(out, columns=["share", "local", "above", "to"])

        moves = loads.withColumn("above", F.pmod("share", F.lit(above))).groupBy("above").applyInPandas(combine, "share bigint, local int, above bigint, to int")
        current = current.join(moves, ["share", "local"]).select(
            "component", "weight", F.col("above").alias("share"), F.col("to").alias("local")
        )
        current = materialize(current, "bins")
        shares = above
    return current.select("component", "weight", F.col("local").alias("bin"))


def allocate_bins(loads: dict[int, int], ratios: dict[str, float]) -> dict[int, str]:
    """Whole bins to splits: heaviest first, to the split that lacks most of its target."""
    total = sum(loads.values())
    lack = {name: total * ratio for name, ratio in ratios.items() if ratio > 0}
    out = {}
    for number, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        name = max(lack, key=lambda n: lack[n])
        lack[name] -= load
        out[number] = name
    return out


def assign_splits(groups: DataFrame, manifest: DataFrame, ratios: dict[str, float], bins: int = BINS) -> DataFrame:
    """(group_id, document_id, bin, split): one split per group, by rows of the manifest.

    An empty manifest gives no rows. A group heavier than its split's target still stays whole.
    """
    rows = manifest.where("document_id is not null").groupBy("document_id").agg(F.count(F.lit(1)).alias("rows"))
    weighted = groups.join(rows.hint("merge"), "document_id").groupBy("group_id").agg(F.sum("rows").alias("weight"))
    binned = balanced_bins(weighted.select(F.col("group_id").alias("component"), "weight"), bins)
    loads = {r.bin: r.load for r in binned.groupBy("bin").agg(F.sum("weight").alias("load")).collect()}
    split = allocate_bins(loads, ratios)  # one entry per bin
    name = F.lit(None).cast("string")
    if split:
        name = F.element_at(F.create_map(*[F.lit(x) for pair in split.items() for x in pair]), F.col("bin"))
    named = binned.select(F.col("component").alias("group_id"), "bin", name.alias("split"))
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return join_least(groups, named.join(sizes.hint("merge"), "group_id"), "group_id").select("group_id", "document_id", "bin", "split")


def requested_ratios(assignments: DataFrame) -> dict[str, float]:
    """The ratios of the latest row that has them; 0.8, 0.1, 0.1 if none has."""
    found = (
        assignments.where("requested_ratios is not null")
        .agg(F.max_by("requested_ratios", F.struct("assigned_at", "assignment_id")).alias("r"))
        .head()
    )
    ratios = found.r.asDict() if found and found.r else {}
    if not ratios or any(v is None for v in ratios.values()):
        ratios = {"train": 0.8, "validation": 0.1, "test": 0.1}
    return ratios


def split_report(assigned: DataFrame, manifest: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """Rows, documents and groups of every split beside its target."""
    rows = manifest.where("document_id is not null").groupBy("document_id").agg(F.count(F.lit(1)).alias("rows"))
    held = assigned.join(rows, "document_id").groupBy("split").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("documents"), F.countDistinct("group_id").alias("groups")
    )
    targets = assigned.sparkSession.createDataFrame(list(ratios.items()), "split string, target double")
    whole = held.agg(F.sum("rows").alias("total"))
    return targets.join(held, "split", "left").join(F.broadcast(whole)).select(
        "split", "target", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("groups", F.lit(0)).alias("groups"), F.try_divide(F.coalesce("rows", F.lit(0)), "total").alias("share"),
    )
