"""Mixing sources to target shares of all tokens.

Every source gets a quota of tokens. Whole copies that a quota asks for are certain; for what is
left, documents are drawn by Pareto order sampling: with U uniform (from a hash of the document
and a seed) and the inclusion probability p of a document, documents are ranked by
(U / (1 - U)) / (p / (1 - p)) and taken from the smallest on. p is proportional to the size of the
document, certain from 1 on. The sample is of fixed size in tokens: ranks are taken while the sum
stays within the rest of the quota.

The cut is found without sorting a source in one task: ranks fall into fixed buckets whose token
sums are added up first; only the bucket in which the quota ends is ranked exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sutur.functions.text import strip_blanks
from sutur.llm.tokens import encode_corpus
from sutur.session import materialize

#: Buckets that ranks and sizes fall into, refinements of the last bucket, and its rows ranked in one task at most.
RANK_BUCKETS = 4096
SIZE_STEPS = 16
EXACT_ROWS = 200_000
_MOST_SOURCES = 10_000
#: As ``wanted``: as many tokens as the listed sources have.
ALL_TOKENS = "all"


def canonical_source(source: Column) -> Column:
    """A source as it is listed: outer blanks and letter case levelled, ``_`` read as ``-``."""
    return F.translate(F.lower(strip_blanks(source)), "_", "-")


def plan_quotas(totals: dict[str, int], targets: dict[str, tuple[float, int]], wanted: int | None = None) -> dict[str, int]:
    """Tokens to take of every listed source.

    Without ``wanted``, the mixture is the largest in which every source that has tokens meets its
    target, no source being used more than its repeats allow. With ``wanted`` tokens, a source that
    cannot give its share gives all that its repeats allow.
    """
    have = {s: n for s, n in totals.items() if n > 0 and s in targets and targets[s][0] > 0 and targets[s][1] > 0}
    if not have:
        return {s: 0 for s in targets}
    whole = wanted if wanted is not None else min(have[s] * targets[s][1] / targets[s][0] for s in have)
    return {s: min(math.floor(targets[s][0] * whole + 1e-9), have[s] * targets[s][1]) if s in have else 0 for s in targets}


def _odds_scale(sizes: list[tuple[float, int, int]], rest: float) -> float:
    """The factor c for which inclusion min(1, c * size) gives ``rest`` tokens on average.

    ``sizes`` are (mean size, documents, tokens) of the size buckets of a source.
    """
    low, high = 0.0, 1.0
    expected = lambda c: sum(min(1.0, c * mean) * tokens for mean, _, tokens in sizes)
    while expected(high) < rest and high < 1e12:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if expected(middle) < rest else (low, middle)
    return high


def mixture(documents: DataFrame, targets: DataFrame, wanted: int | str | None = None, seed: int = 20240229, path: str | None = None) -> tuple[DataFrame, list[dict]]:
    """The mixture as (doc_id, source, n_tokens, copies) with copies >= 1, and the plan per source.

    documents  doc_id, text, source;  targets  source, target_share, max_repeats (a small table)

    Documents of unlisted or null sources are left out, as are texts without tokens. A null share
    or cap counts as 0. Of repeated targets the first by share and cap is used. Equal ranks are
    ordered by doc_id, so the result does not depend on partitioning.
    """
    listed = targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    rows = listed.orderBy("source", F.desc("target_share"), F.desc("max_repeats")).limit(_MOST_SOURCES + 1).collect()
    if len(rows) > _MOST_SOURCES:
        raise ValueError(f"more than {_MOST_SOURCES} target rows")
    goals: dict[str, tuple[float, int]] = {}
    for r in rows:
        goals.setdefault(r.source, (float(r.target_share or 0), int(r.max_repeats or 0)))
    placed = documents.select("doc_id", canonical_source(F.col("source")).alias("source"), "text")
    placed = placed.where(F.col("source").isin(*goals)) if goals else placed.where("false")
    counted = encode_corpus(placed.select(F.struct("doc_id", "source").alias("key"), "text"), "key", "text", path, only_counts=True)
    sized = counted.where("n_tokens > 0").select("key.doc_id", "key.source", "n_tokens")
    mixing = F.xxhash64(F.lit(seed), "doc_id", "source")
    uniform = (F.shiftrightunsigned(mixing, 12).cast("double") + 0.5) / float(1 << 52)
    sized = materialize(sized.withColumn("u", uniform), "sizes")

    bucket = F.floor(F.log2("n_tokens") * SIZE_STEPS).cast("int")
    histogram = sized.groupBy("source", bucket.alias("b")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()
    totals: dict[str, int] = {}
    for r in histogram:
        totals[r.source] = totals.get(r.source, 0) + r.tokens
    quotas = plan_quotas(totals, goals, sum(totals.values()) if wanted == ALL_TOKENS else wanted)
    plan = []
    for source, (share, repeats) in goals.items():
        have, quota = totals.get(source, 0), quotas[source]
        whole = quota // have if have else 0
        rest = quota - whole * have
        scale = _odds_scale([(r.tokens / r.docs, r.docs, r.tokens) for r in histogram if r.source == source], rest) if rest else 0.0
        plan.append({"source": source, "target_share": share, "max_repeats": repeats, "available": have, "quota": quota, "whole": whole, "rest": rest, "scale": scale})
    spark = documents.sparkSession
    schema = "source string, target_share double, max_repeats int, available bigint, quota bigint, whole bigint, rest bigint, scale double"
    plans = spark.createDataFrame([tuple(p.values()) for p in plan], schema)

    drawn = sized.join(F.broadcast(plans.select("source", "whole", "rest", "scale")), "source")
    chance = F.least(F.col("scale") * F.col("n_tokens"), F.lit(1.0))
    odds = F.when(chance >= 1, 0.0).otherwise(F.try_divide(F.col("u") / (1 - F.col("u")), chance / (1 - chance)))
    rank = odds / (1 + odds)  # in [0, 1), the same order
    ranked = drawn.withColumn("rank", F.when(F.col("rest") > 0, F.coalesce(rank, F.lit(1.0))).otherwise(F.lit(1.0)))
    ranked = ranked.select("doc_id", "source", "n_tokens", "whole", "rest", "rank")

    # Find the bucket in which the rest of each quota ends; refine it while it is large.
    spans = {p["source"]: [0.0, 1.0 + 1e-12, p["rest"]] for p in plan if p["rest"] > 0}
    for _ in range(6):
        if not spans:
            break
        frame = spark.createDataFrame([(s, *v) for s, v in spans.items()], "source string, lo double, hi double, left bigint")
        inside = ranked.join(F.broadcast(frame), "source").where("rank >= lo and rank < hi")
        part = F.floor((F.col("rank") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANK_BUCKETS).cast("int")
        sums = inside.groupBy("source", F.least(part, F.lit(RANK_BUCKETS - 1)).alias("b")).agg(
            F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.min("rank").alias("first"), F.max("rank").alias("last")
        )
        large = False
        by_source: dict[str, list] = {}
        for r in sums.collect():  # at most RANK_BUCKETS rows per source
            by_source.setdefault(r.source, []).append(r)
        for source, found in by_source.items():
            left = spans[source][2]
            found.sort(key=lambda r: r.b)
            for r in found:
                if r.tokens > left:
                    spans[source] = [r.first, math.nextafter(r.last, 2.0), left]
                    large = large or (r.docs > EXACT_ROWS and r.last > r.first)
                    break
                left -= r.tokens
            else:
                spans[source] = [2.0, 2.0, left]
        if not large:
            break
    frame = spark.createDataFrame([(s, *v) for s, v in spans.items()], "source string, lo double, hi double, left bigint")
    judged = ranked.join(F.broadcast(frame), "source", "left")
    below = (F.col("rest") > 0) & (F.col("rank") < F.col("lo"))
    border = (F.col("rest") > 0) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    running = Window.partitionBy("source").orderBy("rank", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = judged.where(border).withColumn("sum", F.sum("n_tokens").over(running))
    last = last.withColumn("extra", (F.col("sum") <= F.col("left")).cast("int"))
    others = judged.where(~F.coalesce(border, F.lit(False))).withColumn("extra", F.coalesce(below, F.lit(False)).cast("int"))
    columns = ["doc_id", "source", "n_tokens", (F.col("whole") + F.col("extra")).cast("int").alias("copies")]
    return others.select(*columns).unionByName(last.select(*columns)).where("copies > 0"), plan


def mixture_shares(documents: DataFrame, targets: DataFrame, wanted: int | str | None = None, path: str | None = None) -> DataFrame:
    """Per listed source: target share, tokens there and taken, share reached, most copies, and whether it is met.

    A target counts as met if the tokens taken are within one largest document of the quota and the
    quota is not cut by the cap or by an empty source. ``share_met`` is about the share itself: it is
    the target, give or take the largest document taken of the source. A source without tokens, or at
    its cap, leaves the others above their targets, so a source may have met its quota and not its share.
    """
    mixed, plan = mixture(documents, targets, wanted, path=path)
    spark = documents.sparkSession
    schema = "source string, target_share double, max_repeats int, available bigint, quota bigint"
    plans = spark.createDataFrame([tuple(list(p.values())[:5]) for p in plan], schema)
    taken = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"),
        F.max("copies").alias("most_copies"), F.max("n_tokens").alias("largest"),
    )
    joined = plans.join(taken, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    total = joined.agg(F.sum("tokens").alias("all_tokens"), F.sum("quota").alias("all_quota"))
    share = F.try_divide(F.col("tokens"), F.col("all_tokens"))
    met = (F.col("quota") > 0) & (F.abs(F.col("tokens") - F.col("quota")) <= F.coalesce("largest", F.lit(0)))
    planned = F.try_divide(F.col("quota"), F.col("all_quota"))
    off = F.abs(F.col("tokens") - F.col("target_share") * F.col("all_tokens"))
    share_met = F.coalesce((F.col("target_share") > 0) & (F.col("tokens") > 0) & (off <= F.col("largest")), F.lit(False))
    return joined.join(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "available", "quota", "tokens", F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), share.alias("reached_share"),
        (met & (planned >= F.col("target_share") * 0.999)).alias("met"), share_met.alias("share_met"),
    )
