"""Edit metrics, corpus sums, confusions, CTC rules, numbers."""

import random

import pytest
from pyspark.sql import functions as F

from sutur.errors import EvaluationError
from sutur.functions.edits import alignment, edit_counts
from sutur.functions.numbers import derived_seed, file_kind, points_to_pixels, resized_width, width_to_timesteps
from sutur.functions.sequences import collapse_path, decode, first_argmax, frame_path, minimum_timesteps
from sutur.functions.text import code_point_label, urdu_number
from sutur.operators.evaluation import confusions, corpus_scores, evaluate_predictions, improvements, key_mismatches, score, worst_samples


@pytest.mark.parametrize(
    ("reference", "hypothesis", "counts"),
    [("kitten", "sitting", (2, 0, 1)), ("abc", "abc", (0, 0, 0)), ("abc", "adc", (1, 0, 0)), ("abc", "ac", (0, 1, 0)), ("abc", "abbc", (0, 0, 1)),
     ("aaa", "aa", (0, 1, 0)), ("اردو", "ارزو", (1, 0, 0)), ("خط‌و", "خطو", (0, 1, 0)), ("ab", "ba", (2, 0, 0)), ("", "xy", (0, 0, 2))],
)
def test_counts(reference, hypothesis, counts):
    assert edit_counts(reference, hypothesis)[:3] == counts


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_is_optimal_and_complete():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in "xy")
        steps = alignment(a, b)
        assert sum(op != "match" for op, _, _ in steps) == _distance(a, b)
        assert "".join(r for _, r, _ in steps if r) == a and "".join(h for _, _, h in steps if h) == b


def test_preference_from_the_end():
    """Against a plain table read from the end: match, substitution, deletion, insertion."""
    rng = random.Random(9)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 8))) for _ in "xy")
        cost = {(i, j): _distance(a[:i], b[:j]) for i in range(len(a) + 1) for j in range(len(b) + 1)}
        i, j, want = len(a), len(b), []
        while i or j:
            if i and j and a[i - 1] == b[j - 1] and cost[i, j] == cost[i - 1, j - 1]:
                step, i, j = "match", i - 1, j - 1
            elif i and j and cost[i, j] == cost[i - 1, j - 1] + 1:
                step, i, j = "substitution", i - 1, j - 1
            elif i and cost[i, j] == cost[i - 1, j] + 1:
                step, i = "deletion", i - 1
            else:
                step, j = "insertion", j - 1
            want.append(step)
        assert [op for op, _, _ in alignment(a, b)] == want[::-1]


def test_scores(spark):
    pairs = spark.createDataFrame([("1", "a", ""), ("2", "abcdefghij", "abcdefghiX"), ("3", "", "xy"), ("4", None, None), ("5", "a b", "a  b")], "sample_id string, reference string, hypothesis string")
    scored = score(pairs)
    rows = {r.sample_id: r for r in scored.collect()}
    assert rows["1"].character_error_rate == 1.0 and rows["3"].character_error_rate is None and rows["4"].exact_match
    assert rows["5"].word_error_rate == 0.0 and not rows["5"].exact_match
    total = corpus_scores(scored.where("sample_id in ('1', '2')")).head()
    assert total.character_error_rate == pytest.approx(2 / 11)
    assert [r.sample_id for r in worst_samples(scored, 3).collect()] == ["1", "5", "2"]
    assert {(r.op, r.reference, r.hypothesis): r.n for r in confusions(scored).collect()} == {
        ("deletion", "a", None): 1, ("substitution", "j", "X"): 1, ("insertion", None, "x"): 1, ("insertion", None, "y"): 1, ("insertion", None, " "): 1,
    }
    assert corpus_scores(scored.limit(0)).head().character_error_rate is None


def test_totality(spark):
    make = lambda *ids: spark.createDataFrame([(i, "t") for i in ids], "sample_id string, text string")
    assert evaluate_predictions(make("a", "b"), make("b", "a")).count() == 2
    assert {tuple(r) for r in key_mismatches(make("a"), make("b")).collect()} == {("a", "missing"), ("b", "extra")}
    for left, right in ((make("a"), make("b")), (make("a", "a"), make("a"))):
        with pytest.raises(EvaluationError):
            evaluate_predictions(left, right)


def test_improvements(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 4.95), (3, 4.0), (4, 4.5)], "epoch int, loss double")
    assert [r.improved for r in improvements(df, 0.1).orderBy("epoch").collect()] == [True, False, True, False]


def test_ctc(spark):
    df = spark.createDataFrame([([1, 0, 1, 0, 0],), ([1, 1, 0, 2, 2],), ([0, 0],), ([],)], "p array<int>")
    assert [r.o for r in df.select(collapse_path(F.col("p")).alias("o")).collect()] == [[1, 1], [1, 2], [], []]
    assert [r.o for r in df.select(minimum_timesteps(F.col("p")).alias("o")).collect()] == [6, 7, 3, 0]
    logits = spark.createDataFrame([([[0.0, 2.0, 2.0], [1.0, 0.0, 0.0], [0.0, 0.0, 3.0]], 2)], "l array<array<float>>, n int")
    path = frame_path(F.col("l"), F.col("n"))
    row = logits.select(path.alias("p"), decode(collapse_path(path), F.array(F.lit("x"), F.lit("y"))).alias("t"), first_argmax(F.array().cast("array<int>")).alias("e")).head()
    assert row.p == [1, 0] and row.t == "x" and row.e is None


def test_numbers(spark):
    row = spark.range(1).select(
        resized_width(F.lit(3), F.lit(128)).alias("w"), width_to_timesteps(F.lit(11)).alias("t"), width_to_timesteps(F.lit(3)).alias("n"),
        points_to_pixels(F.lit(612.0), F.lit(200)).alias("p"), derived_seed(F.lit(7), F.lit("é")).cast("string").alias("s"),
        code_point_label(F.lit("😀")).alias("c"), code_point_label(F.lit(" ")).alias("d"), urdu_number(F.lit(42), 4).alias("u"),
        file_kind(F.unhex(F.lit("00000A255044462D31"))).alias("pdf"), file_kind(F.unhex(F.lit("FFD8FF00"))).alias("jpg"), file_kind(F.unhex(F.lit(""))).alias("none"),
    ).head()
    import hashlib

    assert (row.w, row.t, row.n, row.p) == (2, 2, None, 1700)
    assert row.s == str(int.from_bytes(hashlib.sha256("7\0é".encode()).digest()[:8], "big"))
    assert (row.c, row.d, row.u, row.pdf, row.jpg, row.none) == ("U+1F600", "U+0020", "۰۰۴۲", "pdf", "jpeg", None)


def test_many_pairs_at_once_and_long_texts():
    import random

    from sutur.functions import edits

    rng = random.Random(6)
    draw = lambda alphabet, most: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, most)))
    pairs = [(draw("abک", 25), draw("abک", 25)) for _ in range(300)] + [("", ""), ("a", ""), ("", "a"), ("ab", "ab")]
    pairs += [(a.split("a"), b.split("a")) for a, b in pairs[:60]]
    for (a, b), counts, steps in zip(pairs, edits.count_edits(pairs).tolist(), edits.alignments(pairs)):
        ops = [op for op, _, _ in steps]
        assert counts == [ops.count("substitution"), ops.count("deletion"), ops.count("insertion"), len(a)]
        assert [r for op, r, _ in steps if op != "insertion"] == list(a) and [h for op, _, h in steps if op != "deletion"] == list(b)
    a, b = draw("abcdefgh", 3) + "x" * 2 + "".join(rng.choice("abcdefgh") for _ in range(1500)), "".join(rng.choice("abcdefgh") for _ in range(1400))
    ops = [op for op, _, _ in edits.alignment(a, b)]  # longer than what is kept in one piece
    assert edits.edit_counts(a, b) == (ops.count("substitution"), ops.count("deletion"), ops.count("insertion"), len(a))
