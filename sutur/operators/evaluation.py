"""Scoring of predictions against references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sutur.errors import EvaluationError
from sutur.functions.edits import alignment_steps, character_edits, error_rate, total_edits, word_edits
from sutur.functions.text import characters
from sutur.guards import require_empty, require_unique

POLICY = "ocr-edit-v1"
#: Samples named as worst unless asked otherwise.
WORST = 10


def key_mismatches(references: DataFrame, predictions: DataFrame) -> DataFrame:
    """(sample_id, side): ids without a prediction (``missing``) or without a reference (``extra``)."""
    missing = references.select("sample_id").join(predictions, "sample_id", "left_anti").withColumn("side", F.lit("missing"))
    extra = predictions.select("sample_id").join(references, "sample_id", "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def score(pairs: DataFrame) -> DataFrame:
    """Per sample: edit counts and rates over characters and words, and exact match.

    pairs  sample_id, reference, hypothesis. A null text counts as empty; rates over an empty
    reference are null. Pairs that are equal, as most are, cost one comparison.
    """
    reference, hypothesis = F.coalesce("reference", F.lit("")), F.coalesce("hypothesis", F.lit(""))
    edited = pairs.select(
        "sample_id", reference.alias("reference"), hypothesis.alias("hypothesis"),
        character_edits(reference, hypothesis).alias("character_edits"), word_edits(reference, hypothesis).alias("word_edits"),
    )
    return edited.select(
        "*",
        error_rate(F.col("character_edits")).alias("character_error_rate"),
        error_rate(F.col("word_edits")).alias("word_error_rate"),
        (F.col("reference") == F.col("hypothesis")).alias("exact_match"),
    )


def evaluate_predictions(references: DataFrame, predictions: DataFrame) -> DataFrame:
    """Scores of references (sample_id, text) and predictions (sample_id, text); fails unless both hold the same unique ids."""
    for side, role in ((references, "reference"), (predictions, "prediction")):
        require_unique(side, ["sample_id"], EvaluationError, f"duplicate {role}")
    require_empty(key_mismatches(references, predictions), EvaluationError, "references and predictions differ in their ids")
    pairs = references.select("sample_id", F.col("text").alias("reference")).join(
        predictions.select("sample_id", F.col("text").alias("hypothesis")), "sample_id"
    )
    return score(pairs)


def changed_scores(recorded: DataFrame) -> DataFrame:
    """(sample_id, field) where a recorded score is not what its texts give.

    recorded  sample_id, reference, hypothesis, and of what ``score`` gives any columns; rates are
    compared exactly, as they are quotients of whole numbers, and a null is a value
    """
    fields = [n for n in ("character_edits", "word_edits", "character_error_rate", "word_error_rate", "exact_match") if n in recorded.columns]
    again = score(recorded.select("sample_id", "reference", "hypothesis")).select("sample_id", *[F.col(n).alias(f"_{n}") for n in fields])
    differing = F.filter(F.array(*[F.when(~F.col(n).eqNullSafe(F.col(f"_{n}")), F.lit(n)) for n in fields]), lambda x: x.isNotNull())
    return recorded.join(again.hint("merge"), "sample_id").select("sample_id", F.explode(differing).alias("field"))


def verify_scores(recorded: DataFrame) -> int:
    """Number of recorded samples; fails if an id repeats or a recorded score is not what its texts give."""
    require_unique(recorded, ["sample_id"], EvaluationError, "duplicate sample")
    require_empty(changed_scores(recorded), EvaluationError, "a recorded score does not come out again")
    return recorded.count()


def corpus_scores(scored: DataFrame) -> DataFrame:
    """One row: summed edits and lengths, corpus rates (sums over sums), exact matches."""
    sums = []
    for unit in ("character", "word"):
        for part in ("substitutions", "deletions", "insertions", "reference_length"):
            sums.append(F.coalesce(F.sum(f"{unit}_edits.{part}"), F.lit(0)).alias(f"{unit}_{part}"))
    whole = scored.agg(F.count(F.lit(1)).alias("samples"), F.count_if("exact_match").alias("exact_matches"), *sums)
    for unit in ("character", "word"):
        edits = F.col(f"{unit}_substitutions") + F.col(f"{unit}_deletions") + F.col(f"{unit}_insertions")
        whole = whole.withColumn(f"{unit}_error_rate", F.try_divide(edits.cast("double"), F.col(f"{unit}_reference_length")))
    return whole.withColumn("exact_match_rate", F.try_divide(F.col("exact_matches").cast("double"), F.col("samples")))


def worst_samples(scored: DataFrame, limit: int = WORST) -> DataFrame:
    """The worst samples by rate, then edits, then id; undefined rates come last. A top-k, not a sort of all."""
    rate = F.col("character_error_rate")
    return scored.orderBy(rate.isNull(), rate.desc(), total_edits(F.col("character_edits")).desc(), "sample_id").limit(limit)


def confusions(scored: DataFrame) -> DataFrame:
    """(op, reference, hypothesis, n) of all edits of the preferred alignments, most frequent first."""
    steps = scored.where("not exact_match").select(F.explode(alignment_steps("reference", "hypothesis")).alias("s"))
    return (
        steps.groupBy("s.op", "s.reference", "s.hypothesis").agg(F.count(F.lit(1)).alias("n"))
        .orderBy("op", F.desc("n"), F.col("reference").asc_nulls_first(), F.col("hypothesis").asc_nulls_first())
    )


def frequencies(scored: DataFrame) -> DataFrame:
    """(side, ch, n): characters of references and hypotheses."""
    both = scored.select(F.explode(F.array(F.struct(F.lit("reference").alias("side"), "reference"), F.struct(F.lit("hypothesis").alias("side"), F.col("hypothesis").alias("reference")))).alias("t"))
    return both.select("t.side", F.explode(characters(F.col("t.reference"))).alias("ch")).groupBy("side", "ch").agg(F.count(F.lit(1)).alias("n"))


def weighted_mean_loss(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Sample-weighted mean of batch losses per key (loss double, samples bigint)."""
    return batches.groupBy(*keys).agg(F.try_divide(F.sum(F.col("loss") * F.col("samples")), F.sum("samples")).alias("loss"))


def improvements(epochs: DataFrame, min_delta: float = 0.0) -> DataFrame:
    """(epoch, loss, improved): whether an epoch beats the best accepted one before by more than ``min_delta``.

    Epochs of one run are few; the accepted best is a fold, so it runs over the ordered array.
    """
    ordered = epochs.agg(F.array_sort(F.collect_list(F.struct("epoch", "loss"))).alias("e"))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.array().cast("array<struct<epoch:int,loss:double,improved:boolean>>").alias("out"))

    def step(acc, x):
        better = acc["best"].isNull() | (x["loss"] < acc["best"] - min_delta)
        row = F.struct(x["epoch"].cast("int").alias("epoch"), x["loss"].cast("double").alias("loss"), better.alias("improved"))
        return F.struct(F.when(better, x["loss"].cast("double")).otherwise(acc["best"]).alias("best"), F.concat(acc["out"], F.array(row)).alias("out"))

    return ordered.select(F.inline(F.aggregate("e", start, step)["out"]))
