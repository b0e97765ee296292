"""Orphans: against brute force, over task borders, with hot keys, nulls and ties."""

import random
from datetime import datetime, timedelta

from sutur.operators.references import orphan_references, orphan_report

T0 = datetime(2024, 1, 1)
REF = "ref_field string, key string, row_id bigint, at timestamp_ntz, extra string"
PAR = "ref_field string, key string, begins timestamp_ntz, ends timestamp_ntz, at string"


def _brute(refs, parents):
    out = set()
    for field, key, row, at, _ in refs:
        own = [(b, e) for f, k, b, e, _ in parents if f == field and k == key and k is not None]
        begun = [(b, e) for b, e in own if b is not None and at is not None and b <= at]
        if any(e is None or e > at for _, e in begun):
            continue
        out.add((field, row, "deleted" if begun else "late" if own else "missing"))
    return out


def _run(spark, refs, parents):
    found = orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR))
    return found, {(r.ref_field, r.row_id, r.kind) for r in found.collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    day = lambda: None if rng.random() < 0.05 else T0 + timedelta(days=rng.randint(0, 20))
    key = lambda: None if rng.random() < 0.05 else rng.choice(["hot"] * 12 + list("abcdefg"))
    refs = [(rng.choice("xy"), key(), i, day(), "e") for i in range(900)]
    parents = [(rng.choice("xy"), key(), day(), day(), "clash") for _ in range(60)]
    found, got = _run(spark, refs, parents)
    assert got == _brute(refs, parents)
    assert sum(r.n for r in orphan_report(found).collect()) == len(got)


def test_one_key_over_many_tasks(spark):
    refs = [("x", "hot", i, T0 + timedelta(days=i % 400), None) for i in range(4000)]
    parents = [("x", "hot", T0 + timedelta(days=100), T0 + timedelta(days=200), None), ("x", "hot", T0 + timedelta(days=150), T0 + timedelta(days=160), None)]
    _, got = _run(spark, refs, parents)
    assert got == _brute(refs, parents)


def test_ties_and_empty(spark):
    at = T0
    refs = [("x", "k", 1, at, None), ("x", "l", 2, at, None)]
    parents = [("x", "k", at, None, None), ("x", "l", T0 - timedelta(days=1), at, None)]
    assert _run(spark, refs, parents)[1] == {("x", 2, "deleted")}
    assert _run(spark, [], parents)[1] == set()
    assert _run(spark, refs, [])[1] == {("x", 1, "missing"), ("x", 2, "missing")}
