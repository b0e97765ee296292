"""Edit distance metrics. Code points are the unit; optimal alignments prefer match, then
substitution, deletion, insertion when read from the end."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

EDITS = StructType([StructField(n, IntegerType()) for n in ("substitutions", "deletions", "insertions", "reference_length")])
STEPS = ArrayType(StructType([StructField(n, StringType()) for n in ("op", "reference", "hypothesis")]))


#: Cells of the distance table that are looked at together when many short pairs are counted at once.
_CELLS = 1 << 20
_NONE = -1


def _coded(pairs: Sequence[tuple[Sequence[Hashable], Sequence[Hashable]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tokens as numbers, the same for equal tokens of a pair."""
    out = []
    for a, b in pairs:
        if isinstance(a, str) and isinstance(b, str):
            out.append(tuple(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) for t in (a, b)))
        else:
            names: dict[Hashable, int] = {}
            out.append(tuple(np.fromiter((names.setdefault(x, len(names)) for x in xs), dtype=np.int64, count=len(xs)) for xs in (a, b)))
    return out


def _next_costs(above: np.ndarray, differs: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The next row of the distance table; insertions run along the row. Works on one pair or on many."""
    row = np.empty_like(above)
    row[..., 0] = above[..., 0] + 1
    np.minimum(above[..., 1:] + 1, above[..., :-1] + differs, out=row[..., 1:])
    return np.minimum.accumulate(row - steps, axis=-1) + steps


def _padded(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Both sides as matrices; what fills them up is equal to nothing on the other side."""
    out = []
    for side in (0, 1):
        matrix = np.full((len(pairs), max(len(p[side]) for p in pairs)), _NONE - side, dtype=np.int64)
        for i, p in enumerate(pairs):
            matrix[i, : len(p[side])] = p[side]
        out.append(matrix)
    return out


def _count_batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(substitutions, deletions, insertions, reference length) per pair, all pairs at once.

    Two rows per pair: the distance, and the substitutions on the preferred way to each cell. The
    rest follows: of distance c with s substitutions, deletions less insertions are the lengths' difference.
    """
    n, m = (np.array([len(p[side]) for p in pairs], dtype=np.int64) for side in (0, 1))
    a, b = _padded(pairs)
    steps = np.arange(b.shape[1] + 1, dtype=np.int64)
    cost = np.repeat(steps[None, :], len(pairs), axis=0)
    subs = np.zeros_like(cost)
    last, lasts, rows = cost[np.arange(len(pairs)), m], np.zeros(len(pairs), dtype=np.int64), np.arange(len(pairs))
    for i in range(a.shape[1]):
        differs = (b != a[:, i : i + 1]).astype(np.int64)
        below = _next_costs(cost, differs, steps)
        found = subs.copy()  # a deletion keeps what the cell above has
        diagonal = cost[:, :-1] + differs == below[:, 1:]
        found[:, 1:] = np.where(diagonal, subs[:, :-1] + differs, found[:, 1:])
        placed = np.ones_like(found, dtype=bool)
        placed[:, 1:] = diagonal | (cost[:, 1:] + 1 == below[:, 1:])
        source = np.maximum.accumulate(np.where(placed, steps, 0), axis=1)  # an insertion keeps what the cell to the left has
        cost, subs = below, np.take_along_axis(found, source, axis=1)
        ends = n == i + 1
        last[ends], lasts[ends] = cost[rows[ends], m[ends]], subs[rows[ends], m[ends]]
    deletions = (last - lasts + n - m) // 2
    return np.stack([lasts, deletions, last - lasts - deletions, n], axis=1)


def count_edits(pairs: Sequence[tuple[Sequence[Hashable], Sequence[Hashable]]]) -> np.ndarray:
    """Edit counts of many pairs, n x 4. Equal pairs cost one comparison; memory grows with the texts, not with their product."""
    out = np.array([(0, 0, 0, len(a)) for a, _ in pairs], dtype=np.int64).reshape(-1, 4)
    changed = sorted((i for i, (a, b) in enumerate(pairs) if a != b), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    begin = 0
    while begin < len(changed):
        end, width = begin + 1, len(pairs[changed[begin]][1]) + 1
        while end < len(changed) and (len(pairs[changed[end]][1]) + 1) * (end - begin + 1) <= max(_CELLS // 16, width):
            end += 1
        out[changed[begin:end]] = _count_batch(_coded([pairs[i] for i in changed[begin:end]]))
        begin = end
    return out


def edit_counts(reference: Sequence[Hashable], hypothesis: Sequence[Hashable]) -> tuple[int, int, int, int]:
    """(substitutions, deletions, insertions, reference length)."""
    return tuple(count_edits([(reference, hypothesis)])[0].tolist())


Step = tuple[str, Hashable | None, Hashable | None]


def _common_ending(reference: Sequence[Hashable], hypothesis: Sequence[Hashable]) -> int:
    """Read from the end, equal last tokens are always a match: the common ending needs no table."""
    most, k = min(len(reference), len(hypothesis)), 0
    while k < most and reference[-1 - k] == hypothesis[-1 - k]:
        k += 1
    return k


def _way_back(reference: Sequence[Hashable], hypothesis: Sequence[Hashable], i: int, j: int, rows: Callable[[int], dict[int, list[int]]]) -> list[Step]:
    """Steps of the preferred alignment, the ending behind (i, j) included. ``rows(i)`` gives rows i and i - 1 of the table, and maybe more."""
    found: list[Step] = [("match", r, h) for r, h in zip(reference[i:], hypothesis[j:])][::-1]
    table: dict[int, list[int]] = {}
    while i or j:
        if i not in table or (i and i - 1 not in table):
            table = rows(i)
        here = table[i][j]
        same = bool(i and j and reference[i - 1] == hypothesis[j - 1])
        if i and j and table[i - 1][j - 1] + (not same) == here:
            i, j = i - 1, j - 1
            found.append(("match" if same else "substitution", reference[i], hypothesis[j]))
        elif i and table[i - 1][j] + 1 == here:
            i -= 1
            found.append(("deletion", reference[i], None))
        else:
            j -= 1
            found.append(("insertion", None, hypothesis[j]))
    found.reverse()
    return found


def _aligned_alone(reference: Sequence[Hashable], hypothesis: Sequence[Hashable], ending: int) -> list[Step]:
    """One long pair: every so many rows are kept and those between made again, so memory grows with the length times its root."""
    i, j = len(reference) - ending, len(hypothesis) - ending
    (a, b), = _coded([(reference[:i], hypothesis[:j])])
    steps = np.arange(j + 1, dtype=np.int64)
    block = max(16, int(i**0.5))
    follow = lambda row, r: _next_costs(row, (b != a[r - 1]).astype(np.int64), steps)
    row, kept = steps, {0: steps}
    for r in range(1, i + 1):
        row = follow(row, r)
        if r % block == 0:
            kept[r] = row

    def rows(i: int) -> dict[int, list[int]]:
        first = max(0, i - 1) // block * block
        found = [kept[first]]
        for r in range(first + 1, i + 1):
            found.append(follow(found[-1], r))
        return dict(enumerate(found, first))

    return _way_back(reference, hypothesis, i, j, rows)


def alignments(pairs: Sequence[tuple[Sequence[Hashable], Sequence[Hashable]]]) -> list[list[Step]]:
    """Preferred optimal alignments: steps (operation, reference token, hypothesis token) of every pair; tables of short pairs are made together."""
    ending = [_common_ending(r, h) for r, h in pairs]
    left = [(len(r) - e, len(h) - e) for (r, h), e in zip(pairs, ending)]
    out: list[list[Step]] = [[] for _ in pairs]
    order = sorted(range(len(pairs)), key=lambda p: (left[p][1], left[p][0]))
    begin = 0
    while begin < len(order):
        end, high = begin + 1, left[order[begin]][0] + 1
        while end < len(order):
            high = max(high, left[order[end]][0] + 1)
            if high * (left[order[end]][1] + 1) * (end - begin + 1) > _CELLS:
                break
            end += 1
        mine = order[begin:end]
        begin = end
        if len(mine) == 1 and left[mine[0]][0] * left[mine[0]][1] > _CELLS:
            out[mine[0]] = _aligned_alone(*pairs[mine[0]], ending[mine[0]])
            continue
        coded = _coded([(pairs[p][0][: left[p][0]], pairs[p][1][: left[p][1]]) for p in mine])
        a, b = _padded(coded)
        steps = np.arange(b.shape[1] + 1, dtype=np.int64)
        table = [np.repeat(steps[None, :], len(mine), axis=0)]
        for i in range(a.shape[1]):
            table.append(_next_costs(table[-1], (b != a[:, i : i + 1]).astype(np.int64), steps))
        for n, p in enumerate(mine):
            own = {i: row[n, : left[p][1] + 1].tolist() for i, row in enumerate(table[: left[p][0] + 1])}
            out[p] = _way_back(*pairs[p], *left[p], lambda _, own=own: own)
    return out


def alignment(reference: Sequence[Hashable], hypothesis: Sequence[Hashable]) -> list[Step]:
    """Steps of the preferred optimal alignment of one pair."""
    return alignments([(reference, hypothesis)])[0]


def _edits_frame(pairs: list[tuple[Sequence[Hashable], Sequence[Hashable]]]) -> pd.DataFrame:
    return pd.DataFrame(count_edits(pairs).astype("int32"), columns=[f.name for f in EDITS])


@F.pandas_udf(EDITS)
def character_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Edit counts over code points; a null text counts as empty."""
    return _edits_frame([(r or "", h or "") for r, h in zip(reference, hypothesis)])


@F.pandas_udf(EDITS)
def word_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Edit counts over tokens between U+0020."""
    cut = lambda t: [w for w in (t or "").split(" ") if w]
    return _edits_frame([(cut(r), cut(h)) for r, h in zip(reference, hypothesis)])


@F.pandas_udf(STEPS)
def alignment_steps(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """The steps that differ, in order; matches are left out, equal texts have none."""
    pairs = [("", "") if r == h else (r or "", h or "") for r, h in zip(reference, hypothesis)]
    return pd.Series([[{"op": op, "reference": a, "hypothesis": b} for op, a, b in steps if op != "match"] for steps in alignments(pairs)])


def total_edits(edits: Column) -> Column:
    return edits["substitutions"] + edits["deletions"] + edits["insertions"]


def error_rate(edits: Column) -> Column:
    """Edits over reference length, null for an empty reference; not capped."""
    return F.try_divide(total_edits(edits).cast("double"), edits["reference_length"])


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Distance over length without the split by kind: stays in the JVM."""
    return F.try_divide(F.levenshtein(reference, hypothesis).cast("double"), F.char_length(reference))
