"""Frame paths, class scores and CTC rules over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = 0


def first_argmax(scores: Column) -> Column:
    """0-based place of the first largest score; null for an empty array."""
    return F.when(F.size(scores) > 0, F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def frame_path(logits: Column, length: Column) -> Column:
    """Best class of every valid frame."""
    return F.transform(F.slice(logits, F.lit(1), length), first_argmax)


def collapse_path(path: Column) -> Column:
    """Greedy CTC: equal neighbours become one, then blanks go - in this order."""
    kept = F.filter(path, lambda c, i: (i == 0) | (c != F.get(path, i - 1)))
    return F.filter(kept, lambda c: c != BLANK)


def minimum_timesteps(target: Column) -> Column:
    """Frames that a target needs at least: its length and one more for every repeated neighbour."""
    repeats = F.filter(target, lambda c, i: (i > 0) & (c == F.get(target, i - 1)))
    return F.size(target) + F.size(repeats)


def is_alignable(target: Column, frames: Column) -> Column:
    return frames >= minimum_timesteps(target)


def alignment_issue(target: Column, frames: Column, classes: int, most_frames: int | None = None) -> Column:
    """Why a target of class indices can't be aligned with frames, or null: ``empty_target``, ``no_frames``, ``too_many_frames``, ``blank_in_target``, ``unknown_class``, ``too_few_frames``.

    Malformed input comes first, in this order; nulls count as empty. A row without an issue is feasible.
    """
    return (
        F.when(F.coalesce(F.size(target), F.lit(0)) <= 0, "empty_target")
        .when(F.coalesce(frames, F.lit(0)) <= 0, "no_frames")
        .when(F.lit(most_frames is not None) & (frames > (most_frames or 0)), "too_many_frames")
        .when(F.exists(target, lambda c: c.isNull() | (c <= BLANK)), "blank_in_target")
        .when(F.exists(target, lambda c: c >= classes), "unknown_class")
        .when(~is_alignable(target, frames), "too_few_frames")
    )


def decode(indices: Column, vocabulary: Column) -> Column:
    """Text of 1-based class indices by an array of characters; an unknown index fails."""
    found = F.transform(indices, lambda i: F.element_at(vocabulary, i))
    return F.array_join(found, "")


def encode(text: Column, vocabulary: Column) -> Column:
    """1-based indices of the characters of a text; null where one is unknown.

    ``vocabulary`` is a map character -> index (a literal for small vocabularies).
    """
    indices = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.try_element_at(vocabulary, c))
    return F.when(~F.exists(indices, lambda i: i.isNull()), indices)
