"""Training-data operators against brute force, exact round trips and edge cases."""

import os
import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sutur.llm import mixing, overlap, splits, terms
from sutur.llm.bpe import BytePairEncoder, default_path, read_ranks
from sutur.llm.residue import ResidueMatcher, judge_documents
from sutur.llm.tokens import decode_ids, encode_corpus

pytestmark = pytest.mark.skipif(not os.path.exists(default_path()), reason="no public vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    return BytePairEncoder(read_ranks(default_path()))


def test_bpe_equals_the_public_library(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(default_path()), "byte_bpe_50k.json"))
    public.encode_special_tokens = True
    rng = random.Random(3)
    pieces = ["a", "th", "in ", " ", "  ", "\n", "'s", "'ll", "é", "ہے", "12", "٣", "\x00", "🖋", "zzzz", "tion", "_", "<|endoftext|>", "ـ", "\r\n\t", "̈"]
    for _ in range(500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        assert encoder.encode(text) == public.encode(text, add_special_tokens=False).ids
    long = "ab" * 40_000
    assert encoder.encode(long) == public.encode(long, add_special_tokens=False).ids


def test_encode_corpus(spark):
    rows = [(1, "کتاب and text", "x"), (2, None, "y"), (3, "", "z"), (4, "  ", "z"), (1, "کتاب and text", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    found = encode_corpus(df).collect()
    assert len(found) == 5
    by = {r.doc_id: r.ids for r in found}
    assert by[2] == [] and by[3] == [] and decode_ids(by[1]) == rows[0][1] and decode_ids(by[4]) == "  "
    assert encode_corpus(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in encode_corpus(df, only_counts=True).collect()}[1] == len(by[1])


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _changed(text, edits, rng):
    out = list(text)
    for _ in range(edits):
        at = rng.randint(0, len(out))
        kind = rng.randint(0, 2)
        if kind == 0:
            out.insert(at, rng.choice("abcdefgh کہ"))
        elif out:
            at = min(at, len(out) - 1)
            out[at : at + 1] = [rng.choice("abcdefgh کہ")] if kind == 1 else []
    return "".join(out)


def test_near_texts_lose_nothing(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh کہ") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 14)))[:80] for _ in range(60)]
    base += ["x" * 24, "ab" * 15, "a" * 30]
    train = {t for t in base if len(t) >= 24}
    held = {t for b in base for t in [_changed(b, rng.randint(0, len(b) // 4 + 1), rng)] if len(t) >= 24}
    held |= {"x" * 29, "x" * 30, "ab" * 12}
    long = "".join(rng.choice("abcdefghij") for _ in range(900))
    train |= {long, long[:700], long + "z" * 100}
    held |= {_changed(long, 100, rng), _changed(long[:700], 130, rng), long[50:]}
    want = {(t, e) for t in train for e in held if abs(len(t) - len(e)) * 5 <= max(len(t), len(e)) and _distance(t, e) * 5 <= max(len(t), len(e))}
    frame = lambda texts: spark.createDataFrame([(t,) for t in sorted(texts)], "text string")
    got = {(r.train_text, r.eval_text) for r in overlap.near_texts(frame(train), frame(held)).collect()}
    assert got == want and len(want) > 40
    assert overlap.near_texts(frame(train).limit(0), frame(held)).count() == 0
    assert overlap.near_texts(frame(train), frame(held).limit(0)).count() == 0


def test_near_texts_shuffle_little_more_than_the_texts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh کہ") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    made = lambda n: spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(14)),) for _ in range(n)], "text string")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    def cost(n):
        begun = shuffled()
        overlap.near_texts(made(n), made(n // 2)).collect()
        return shuffled() - begun

    few, many = cost(200), cost(4000)
    assert many - few < 4 * 100 * 1.5 * (4000 - 200)  # four times texts of some 100 bytes; the keys alone are thousands of bytes a text


def test_near_texts_in_many_blocks(spark, monkeypatch):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(30, 60))).strip("  ").replace("  ", "b") for _ in range(60)]
    train, held = sorted(set(base)), sorted({_changed(b, rng.randint(0, len(b) // 4), rng) for b in base})
    held = [t for t in held if len(t) >= 24]
    train = [t for t in train if len(t) >= 24]
    want = {(t, e) for t in train for e in held if _distance(t, e) * 5 <= max(len(t), len(e))}
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts] * 2, "text string")
    monkeypatch.setattr(overlap, "BLOCK_KEYS", 300)
    monkeypatch.setattr(overlap, "_MEETINGS", 64)
    found = [(r.train_text, r.eval_text) for r in overlap.near_texts(frame(train), frame(held)).collect()]
    assert sorted(found) == sorted(want) and len(want) > 20
    sizes = [(30, 1), (31, 5), (33, 40), (36, 2)]
    assert overlap.blocks(sizes) == [(30, 31, 0, 1), *[(33, 33, i, 2) for i in range(2)], (36, 36, 0, 1)]
    assert overlap.blocks([]) == []


def test_cross_split_pairs(spark):
    text = "a line of text that is long enough"
    rows = [("s1", "tr", "images//a.png", None), ("s2", "ev", "./images/a.png", None), ("s3", "tr", None, text), ("s4", "ev", "/bad", "  a line of  text that is long enougH"),
            ("s5", "none", "images/a.png", text), ("s6", "tr", "x", "short"), ("s7", "ev", "y", "short"), ("s1", "ev", "images/a.png", None), (None, "ev", "images/a.png", text),
            ("s3", "tr", None, text)]
    manifest = spark.createDataFrame([(*r, "src", "clash") for r in rows], "sample_id string, document_id string, image_path string, text string, source string, partition string")
    splits_ = spark.createDataFrame(
        [(1, "tr", "test", "2024-01-01"), (2, "tr", " TRAIN", "2024-01-02"), (3, "ev", "Val", "2024-01-01"), (4, "none", None, "2024-01-03")],
        "assignment_id bigint, document_id string, partition string, at string",
    ).withColumn("assigned_at", F.col("at").cast("timestamp_ntz"))
    assert sorted(tuple(r) for r in overlap.cross_split_pairs(manifest, splits_).collect()) == [("s1", "s2"), ("s3", "s4")]
    report = {(r.partition, r.source): (r.samples, r.overlapping, r.pairs) for r in overlap.cross_split_report(manifest, splits_).collect()}
    assert report == {("validation", "src"): (4, 2, 2)}
    assert overlap.cross_split_pairs(manifest.limit(0), splits_).count() == 0


def _brute_groups(documents, links):
    import re

    canon = lambda s: s.strip().lower().translate(str.maketrans("۰۱۲۳۴۵۶۷۸۹", "0123456789"))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    keys = {canon(d) for d in documents}
    for d, kind, e in links:
        if d is not None and e is not None and kind is not None and canon(d) in keys and canon(e) not in ("", "unknown", "n/a", "-"):
            parent[find(("d", canon(d)))] = find((kind, canon(e)))
    groups = {}
    for d in documents:
        groups.setdefault(find(("d", canon(d))), set()).add(d)
    return {(min(g), d) for g in groups.values() for d in g}


def test_related_groups(spark):
    rng = random.Random(2)
    spell = lambda s: rng.choice([s, s.upper(), s + " ", " " + s, s.translate(str.maketrans("0123456789", "۰۱۲۳۴۵۶۷۸۹"))])
    documents = {spell(f"doc-{i}") for i in range(120)}
    links = [(spell(f"doc-{rng.randint(0, 130)}"), rng.choice(["scribe", "donor"]), rng.choice([None, "", "Unknown", "n/a", " - ", *[spell(f"e-{rng.randint(0, 80)}")] * 4])) for _ in range(150)]
    links += [(f"doc-{i}", "chain", f"c-{i // 2}") for i in range(40, 60)] + [(f"doc-{i + 1}", "chain", f"c-{i // 2}") for i in range(40, 60)] + [(None, "scribe", "e-1"), ("doc-1", None, "e-1")]
    manifest = spark.createDataFrame([(d, "x") for d in documents] * 2 + [(None, "x")], "document_id string, entity_id string")
    entities = spark.createDataFrame(links, "document_id string, entity_kind string, entity_id string")
    groups = splits.related_groups(manifest, entities)
    assert {tuple(r) for r in groups.collect()} == _brute_groups(documents, links)
    assert splits.related_groups(manifest.limit(0), entities).count() == 0
    assert splits.related_groups(manifest, entities.limit(0)).count() == len(documents)


def test_balanced_bins_and_whole_groups(spark):
    rng = random.Random(4)
    weights = [5000, 3000] + [rng.randint(1, 40) for _ in range(900)]
    df = spark.createDataFrame([(f"c{i}", w) for i, w in enumerate(weights)], "component string, weight bigint")
    for share in (10_000, 40):  # one share, and several levels of them
        found = splits.balanced_bins(df, bins=10, share=share).collect()
        assert sorted(r.component for r in found) == sorted(f"c{i}" for i in range(len(weights)))
        loads = Counter()
        for r in found:
            loads[r.bin] += r.weight
        light = [loads[b] for b in range(10) if loads[b] < 3000]
        assert max(light) - min(light) <= 60
    assert splits.balanced_bins(df.limit(0), bins=10).count() == 0
    many = spark.range(25_000).select(F.concat(F.lit("c"), "id").alias("component"), (F.pmod("id", F.lit(7)) + 1).alias("weight")).coalesce(1)
    loads = [r.n for r in splits.balanced_bins(many).groupBy("bin").agg(F.sum("weight").alias("n")).collect()]
    assert len(loads) == 100 and max(loads) - min(loads) <= 7
    chosen = splits.allocate_bins({b: 10 for b in range(100)}, {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert Counter(chosen.values()) == {"train": 80, "validation": 10, "test": 10}
    loads = [load for load, _ in splits.largest_differencing([[(w, i), (0, None)] for i, w in enumerate([8, 7, 6, 5, 4])])]
    assert sorted(loads) == [14, 16]


def test_splits_of_groups(spark):
    groups = spark.createDataFrame([(f"g{i // 3}", f"d{i}") for i in range(600)], "group_id string, document_id string")
    manifest = spark.createDataFrame([(f"d{i}", i) for i in range(600) for _ in range(1 + i % 4)], "document_id string, bin bigint")
    ratios = {"train": 0.7, "validation": 0.2, "test": 0.1}
    assigned = splits.assign_splits(groups, manifest, ratios)
    assert assigned.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    report = {r.split: r.share for r in splits.split_report(assigned, manifest, ratios).collect()}
    assert all(abs(report[k] - v) < 0.01 for k, v in ratios.items())
    assert splits.assign_splits(groups.limit(0), manifest.limit(0), ratios).count() == 0


def test_hubs_stay_out_of_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(splits, "ONE_TASK", 100)
    documents = [f"d{i:04d}" for i in range(900)]
    links = [(d, "scribe", "hub") for d in documents[300:]] + [(d, "volume", f"v{i // 2}") for i, d in enumerate(documents)]
    manifest = spark.createDataFrame([(d,) for d in documents], "document_id string")
    entities = spark.createDataFrame(links, "document_id string, entity_kind string, entity_id string")
    assert {tuple(r) for r in splits.related_groups(manifest, entities).collect()} == _brute_groups(documents, links)
    rows = spark.createDataFrame([("hub" if i % 3 else f"k{i}", i) for i in range(600)], "k string, i int")
    keys = rows.groupBy("k").agg(F.max("i").alias("m"), F.count(F.lit(1)).alias("n"))
    found = splits.join_least(rows, keys, "k")
    assert found.count() == 600 and found.where("i > m").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_differencing_keeps_every_component():
    rng = random.Random(9)
    weights = sorted((rng.randint(1, 60) for _ in range(3000)), reverse=True)
    loads, places = splits.differenced([splits.np.array([w]) for w in weights], 20)
    found = Counter()
    for w, ends in zip(weights, places):
        found[int(ends[0])] += w
    assert [found[b] for b in range(20)] == loads.tolist() and max(loads) - min(loads) <= 2
    assert splits.differenced([], 5)[0].tolist() == [0] * 5


def test_term_frequencies(spark):
    rng = random.Random(8)
    texts = [None, "", " ", "é é"] + [" ".join(rng.choice(["the", "the", "the", "a", f"w{rng.randint(0, 300)}"]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "term int, text string").repartition(6)
    want = Counter(w for t in texts if t for w in unicodedata.normalize("NFC", t).split())
    held = Counter(w for t in texts if t for w in set(unicodedata.normalize("NFC", t).split()))
    for heavy in (2048, 1, 0):
        found = {r.term: (r.occurrences, r.records) for r in terms.term_frequencies(df, F.col("text"), terms.nfc_terms, heavy_terms=heavy).collect()}
        assert found == {w: (n, held[w]) for w, n in want.items()}
    assert terms.term_frequencies(df.limit(0), F.col("text"), terms.nfc_terms).count() == 0


def test_marked_terms(spark):
    manifest = spark.createDataFrame([(1, "a", "x y"), (2, "a", "x y"), (3, "b", "x"), (4, "c", "x z"), (5, "d", None), (6, None, "q")], "record_id bigint, sample_id string, text string")
    errors = spark.createDataFrame(
        [("r1", "sub", "k", 3), ("r1", "sub", "k", 3), ("r2", "sub", "k", 2), (None, "sub", "k", 1), ("r1", "del", "", 5), ("r3", "del", None, 5), ("r1", "del", "m", 0), ("r1", "del", "n", None), ("r2", "ins", "o", 4)],
        "report_id string, op string, character string, count bigint",
    )
    found = {(r.field, r.term): (r.occurrences, r.records, r.mark) for r in terms.marked_terms(manifest, errors).collect()}
    assert found == {
        ("manifest.text", "x"): (3, 3, "common"), ("manifest.text", "y"): (1, 1, "rare"), ("manifest.text", "z"): (1, 1, "rare"),
        ("error_analysis.character", "k"): (6, 2, "common"), ("error_analysis.character", "o"): (4, 1, "rare"),
    }


def _mixing_frames(spark, rng):
    rows = [(i, rng.choice(["Big ", "big", "BIG"]), "word " * rng.randint(1, 60)) for i in range(400)]
    rows += [(1000 + i, "small_set", "word " * rng.randint(1, 20)) for i in range(20)] + [(2000, None, "word"), (2001, "other", "word"), (2002, "big", ""), (2003, "big", None)]
    documents = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, source string, text string, copies int")
    targets = spark.createDataFrame([("big", 0.8, 1), ("small-set", 0.1, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    return documents, targets


def test_mixture(spark):
    documents, targets = _mixing_frames(spark, random.Random(6))
    mixed, plan = mixing.mixture(documents, targets)
    rows = mixed.collect()
    caps = {"big": 1, "small-set": 4}
    assert all(1 <= r.copies <= caps[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    shares = {r.source: r for r in mixing.mixture_shares(documents, targets).collect()}
    assert abs(shares["big"].tokens / (shares["big"].tokens + shares["small-set"].tokens) - 8 / 9) < 0.02
    assert shares["big"].met and shares["small-set"].met and not shares["absent"].met
    again = {(r.doc_id, r.copies) for r in mixing.mixture(documents.repartition(9), targets)[0].collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}
    assert mixing.mixture(documents.limit(0), targets)[0].count() == 0
    assert mixing.mixture(documents, targets.limit(0))[0].count() == 0
    large, plan = mixing.mixture(documents, targets, wanted=10**6)
    assert {r.copies for r in large.where("source = 'small-set'").collect()} == {4}


def test_rank_border_is_exact(spark, monkeypatch):
    documents, targets = _mixing_frames(spark, random.Random(6))
    whole = {(r.doc_id, r.copies) for r in mixing.mixture(documents, targets)[0].collect()}
    monkeypatch.setattr(mixing, "RANK_BUCKETS", 3)
    monkeypatch.setattr(mixing, "EXACT_ROWS", 5)
    assert {(r.doc_id, r.copies) for r in mixing.mixture(documents, targets)[0].collect()} == whole


RESIDUE = [
    "Dear {{ name }}, we thank you for the page.", "عنوان: ${عنوان}", "Date: [INSERT date]", "Title: %(title)s", "##sampleCount##", "والسلام «تاریخ یہاں آئے گا»",
    "کاتب: &lt;reviewer&gt;", "Lorem ipsum dolor sit amet consectetur.", "404 Not Found", "HTTP/1.1 504 Gateway Timeout", "You must enable JavaScript in your browser.",
    "<noscript>Turn on scripts to load the page.</noscript>", "آپ کے براؤزر میں جاوا اسکرپٹ بند ہے۔", "یہاں متن آئے گا۔", "خرابی ۴۰۴: صفحہ موجود نہیں", "asdf qwer zxcv",
    "test test test 9", "Text coming soon.", "A fine line of real text.\nConnection timed out: image-store port 80\nMore of it.", '{"status":503,"detail":"Service Unavailable","request":"r1"}',
    "Access&nbsp;denied.", "An unexpected err​or occurred.", "خرابي ۵۰۰: اندرونی خرابی",
]
CLEAN = [
    None, "", "  ", "A fine line of real text about a page and its script.", "The field `{{ name }}` is replaced before the page is printed.", "Use the shell variable ${folio} when you call it.",
    "The macro \\title{folio} sets the running head.", 'The config {"seed": 7, "ratio": 0.5} was used.', "A set is written as {a, b, c} and <b> marks bold type.",
    "The old viewer printed 'Access denied' to every guest last year; the cause was a wrong clock.", "Line 9 of the log says that enabling scripts in the browser helped one visitor.",
    "The words lorem ipsum printed on the specimen came from the printer, which amused them.", "رپورٹ کے مطابق ۷ پتوں میں سے ۲ پر ’صفحہ نہیں ملا‘ کا جواب آیا تھا۔",
    "پرانے قاعدے میں لکھا ہے کہ {تاریخ} کی جگہ چھپائی سے پہلے نام خود بھر جاتا ہے۔", "جاوا اسکرپٹ کے بغیر نیا ناظر زیادہ تیز چلتا ہے۔", "فارم کی خالی لکیر ________ پر مہر لگی ہوئی تھی۔",
    "The file name pattern is line-%06d.png and the number counts from one.",
]


def test_residue(spark):
    matcher = ResidueMatcher()
    assert [t for t in RESIDUE if not matcher.judge(t)[0]] == []
    assert [t for t in CLEAN if matcher.judge(t)[0]] == []
    df = spark.createDataFrame(list(enumerate(RESIDUE + CLEAN)), "doc_id bigint, text string").withColumn("kinds", F.lit("clash"))
    assert judge_documents(df).where("excluded").count() == len(RESIDUE)
    assert judge_documents(df.limit(0)).count() == 0
    assert matcher.judge("kettle " * 200_000)[0] == []


def test_residue_on_wording_kept_apart():
    import heldout_residue as kept

    matcher = ResidueMatcher()
    for residue, content in ((kept.RESIDUE, kept.CONTENT), (kept.LATER_RESIDUE, kept.LATER_CONTENT), (kept.LAST_RESIDUE, kept.LAST_CONTENT)):
        found, wrong = sum(map(matcher.found, residue)), sum(map(matcher.found, content))
        assert found >= 0.7 * len(residue) and found >= 0.9 * (found + wrong)
    assert [t for t in kept.RESIDUE[:40] if matcher.found(t) and not matcher.found(kept.texts_with_content_around(t))] == []
    assert not matcher.found("A plain line of an ordinary book.\n" * 2000 + "TODO") and matcher.judge("A plain line of an ordinary book.\n" * 2000 + "TODO")[0] == ["filler"]


def test_dummy_words_anywhere_in_a_unit():
    judge = ResidueMatcher().judge
    line = "test intro test test test test test test outro test"
    assert judge(line)[0] == judge(f"{line}\nlorem ipsum dolor sit amet")[0] == ["filler"]
    assert judge("test intro test test test test test closing outro test")[0] == []  # 7 of 10
    assert judge("test test")[0] == []


def test_fields_with_any_content():
    matcher = ResidueMatcher()
    long = "a_name_of_more_than_forty_characters_in_all_45"
    fields = ["{{ name|upper }}", "{{ user['first'] }}", "{% if page.title %}", "<%= page.title() %>", "[[ page|title ]]", "<< page: title >>"]
    fields += [o + long + c for o, c in (("{{", "}}"), ("{%", "%}"), ("<%", "%>"), ("[[", "]]"), ("<<", ">>"), ("##", "##"), ("@@", "@@"))]
    assert [f for f in fields if matcher.judge(f"It was written by {f} in that year.")[0] != ["template"]] == []
    clean = ["{{ open\nclosed }}", "{{ }}", "The placeholder `{{ name|upper }}` is filled later."]
    assert [t for t in clean if matcher.judge(t)[0]] == []
    assert [matcher.fields(t) for t in ("{{ a " * 20_000, "__a " * 20_000, "{{" + " a" * 100_000, "##" + " a" * 100_000)] == [0, 0, 0, 0]


def test_share_met_is_about_the_share(spark):
    documents = spark.createDataFrame([(i, "word " * 40, s) for i, s in enumerate(["a", "b"] * 300)], "doc_id bigint, text string, source string")
    goals = lambda *rows: spark.createDataFrame(list(rows), "source string, target_share double, max_repeats int")
    both = {r.source: r.share_met for r in mixing.mixture_shares(documents, goals(("a", 0.6, 2), ("b", 0.4, 2))).collect()}
    assert both == {"a": True, "b": True}
    short = {r.source: (r.met, r.share_met) for r in mixing.mixture_shares(documents, goals(("a", 0.5, 2), ("b", 0.4, 2), ("none", 0.1, 2))).collect()}
    assert short == {"a": (True, False), "b": (True, False), "none": (False, False)}


def test_mixture_of_all_tokens_names_shortfalls(spark, tmp_path):
    from sutur.llm import queries

    text = "the river was wide and slow that year "
    documents = [(i, text * 5, "large") for i in range(200)] + [(200, text, "small")]
    spark.createDataFrame(documents, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    targets = spark.createDataFrame([("large", 0.9, 4), ("small", 0.1, 4)], "source string, target_share double, max_repeats int")
    targets.write.parquet(str(tmp_path / "mix_targets.parquet"))
    shares = {r.source: r for r in queries.queries()["p7_shares_of_all"](spark, str(tmp_path)).collect()}
    whole = shares["large"].available + shares["small"].available
    assert shares["small"].most_copies == 4 and shares["small"].tokens == 4 * shares["small"].available and not shares["small"].met
    assert 0.85 * whole < shares["large"].tokens <= 0.9 * whole
