"""Queries over samples, splits, vocabularies, validation, review and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sutur.functions.edits import character_error_rate, total_edits
from sutur.functions.fingerprints import dataset_fingerprint, group_fingerprints, sample_line
from sutur.functions.numbers import derived_seed, file_kind, resized_width, width_to_timesteps
from sutur.functions.paths import portable_path
from sutur.functions.text import ascii_space_tokens, code_point_label, has_forbidden_control, issue_codes, nfc, normalize_transcription, urdu_number
from sutur.operators import evaluation, review, splitting, validation, vocabulary
from sutur.operators.samples import corpus_samples, first_deliveries
from sutur.session import materialize, table
from sutur.sources.artifacts import manifest_differences
from sutur.sources.synthetic import composed_texts, directional_runs, synthetic_lines

# A small corpus and templates for generated rows, and what corrupts a hypothesis.
_LINES = ("کتاب", "قلم دان", "صفحہ نمبر", "پرانا خط", "نیا حاشیہ")
_TEMPLATES = ("سطر {number}", "صفحہ {number} پر", "جلد {number}")
_SWAPS = (("کے", "کی"), ("تھا", "ہے"), ("۔", ""), ("ں", "ن"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_samples(table(spark, sf_dir, "manifest"))


def digested_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with the hash of their image, from the newest artifact row of the path."""
    return _digested(spark, sf_dir, samples(spark, sf_dir))


def _digested(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    files = table(spark, sf_dir, "artifact_manifest").where("path is not null")
    hashes = files.groupBy(F.col("path").alias("image_path")).agg(F.max_by("sha256", F.struct("added_at", "sha256")).alias("digest"))
    return rows.join(hashes, "image_path", "left")


def hypothesis(text: Column) -> Column:
    for old, new in _SWAPS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = samples(spark, sf_dir)
    return evaluation.score(found.select("sample_id", F.col("text").alias("reference"), hypothesis(F.col("text")).alias("hypothesis")))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.assign_documents(samples(spark, sf_dir))


def _partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with the partition of their document, written out once."""
    found = materialize(samples(spark, sf_dir), "samples")
    return materialize(found.join(splitting.assign_documents(found).select("document_id", "partition"), "document_id"), "partitioned")


def _vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary of all samples."""
    return vocabulary.build_vocabulary(samples(spark, sf_dir))


def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)


def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(digested_samples(spark, sf_dir), "digested")
    split = found.join(splitting.assign_documents(found).select("document_id", "partition"), "document_id")
    return splitting.leakage(split, "digest")


def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "manifest").where("text is not null").select("record_id", "text", nfc(F.col("text")).alias("n"))
    return rows.select("record_id", F.array_join(issue_codes(F.col("text"), F.col("n")), ",").alias("codes"))


def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "manifest")
    return rows.select("record_id", normalize_transcription(F.col("text")).alias("text"))


def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _partitioned(spark, sf_dir)
    train = vocabulary.build_vocabulary(found.where("partition = 'train'"))
    return vocabulary.unseen_characters(found.where("partition <> 'train'"), train)


def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(samples(spark, sf_dir), "samples")
    characters = vocabulary.vocabulary_list(vocabulary.build_vocabulary(found))
    encoded = vocabulary.encode_texts(found, characters, strict=False)
    return encoded.select("sample_id", F.array_join(F.transform("indices", lambda i: i.cast("string")), " ").alias("indices"))


def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with more than one text: digest, texts and samples."""
    found = digested_samples(spark, sf_dir).where("digest is not null").select("digest", "text", "sample_id")
    per_text = found.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("samples"))
    return per_text.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.sum("samples").alias("samples")).where("texts > 1")


def q14b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation report of all deliveries with the image rules; a file is looked up by the portable form of its path."""
    manifest = table(spark, sf_dir, "manifest")
    portable = manifest.select("record_id", portable_path(F.col("image_path")).alias("image_path"))
    hashes = _digested(spark, sf_dir, portable).select("record_id", "digest")
    rows = manifest.join(hashes, "record_id", "left")
    return validation.with_messages(validation.text_issues(manifest).unionByName(validation.duplicate_issues(rows)))


def q15(spark: SparkSession, sf_dir: str, include: bool) -> DataFrame:
    decisions = review.latest_decisions(table(spark, sf_dir, "review_decisions"))
    kept = review.merge_decisions(samples(spark, sf_dir), decisions, include)
    return kept.select("sample_id", F.array_join("tags", ",").alias("tags"))


def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.unknown_decisions(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "review_decisions")).select("decision_id", "sample_id")


def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dataset_fingerprint(samples(spark, sf_dir))
    return spark.createDataFrame([(found,)], "fingerprint string")


def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances without the split by kind; they stay in the JVM."""
    text, other = F.col("text"), hypothesis(F.col("text"))
    return samples(spark, sf_dir).select("sample_id", F.levenshtein(text, other).alias("distance"), character_error_rate(text, other).alias("rate"))


def q25(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = samples(spark, sf_dir).select("sample_id")
    predictions = table(spark, sf_dir, "review_decisions").select("sample_id").where("sample_id is not null").distinct()
    return evaluation.key_mismatches(references, predictions).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first"))


def q39(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "artifact_manifest")
    by_path = lambda least: files.groupBy("path").agg(
        (F.min_by if least else F.max_by)(F.struct("size_bytes", "sha256"), F.struct("added_at", "sha256")).alias("f")
    ).select("path", "f.*")
    return manifest_differences(by_path(True), by_path(False))


def q39b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as first recorded against those that are still there, by path: gone, new, of another size or hash."""
    files = table(spark, sf_dir, "artifact_manifest").where("path is not null")
    newest = lambda rows: rows.groupBy("path").agg(F.max_by(F.struct("size_bytes", "sha256"), F.struct("added_at", "sha256")).alias("f")).select("path", "f.*")
    return manifest_differences(newest(files.where("added_at < timestamp_ntz '2024-07-01 00:00:00'")), newest(files.where("deleted_at is null")))


def q40(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return rows.select("doc_id", F.length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"), file_kind(F.col("content")).alias("kind"))


def q41(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "manifest").select("record_id", portable_path(F.col("image_path")).alias("path"))


def q42(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "manifest").select("sample_id").where("sample_id is not null").distinct()
    return ids.select("sample_id", derived_seed(F.lit(1337), F.col("sample_id")).cast("string").alias("seed"))


def q43(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "error_analysis").where("character is not null and character <> ''").select("row_id", "character", "code_point")
    label = code_point_label(F.col("character"))
    return rows.select("row_id", label.alias("label"), (label == F.col("code_point")).alias("agrees"))


def q44(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select(
        "doc_id", has_forbidden_control(text).alias("control"), F.size(ascii_space_tokens(text)).alias("tokens"), F.char_length(text).alias("chars"),
    )


def q48(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "page_ground").select("record_id", F.explode("lines").alias("l")).select("record_id", "l.line_id", "l.output_box")
    sized = part.where("output_box.width > 0 and output_box.height > 0").select("record_id", "line_id", F.col("output_box.width").alias("w"), F.col("output_box.height").alias("h"))
    scaled = resized_width(F.col("w"), F.col("h"))
    return sized.select("record_id", "line_id", "w", "h", scaled.alias("scaled"), width_to_timesteps(scaled).alias("frames"))


def q49(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "manifest").where("line_index is not null").select("record_id", urdu_number(F.col("line_index"), 4).alias("number"))


def q50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("sample_id", directional_runs("text").alias("r")).select("sample_id", F.posexplode("r").alias("pos", "run")).select("sample_id", "pos", "run.direction", "run.text")


def q51(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.text_overlap(_partitioned(spark, sf_dir))


def q53(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = table(spark, sf_dir, "nation").count() * 40
    return synthetic_lines(spark, count, _LINES).select("sample_id", "text", "document_id", "line_index", F.col("seed").cast("string").alias("seed"))


def q56(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("loss"), F.lit(1).alias("samples"))
    mean = evaluation.weighted_mean_loss(rows, ["user_id"])
    return mean.select("user_id", F.round("loss", 6).alias("loss"))


def q56b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price of a return flag, weighted by quantity: batches of different sizes."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("loss"), F.col("l_quantity").cast("double").alias("samples"))
    return evaluation.weighted_mean_loss(rows, ["l_returnflag"]).select("l_returnflag", F.round("loss", 4).alias("loss"))


def queries() -> dict:
    c = F.col
    return {
        "q01_split_counts": lambda s, d: splitting.split_counts(_split(s, d)),
        "q02_split_assignments": q02,
        "q03_leakage": q03,
        "q04_issue_codes": q04,
        "q05_normalized_text": q05,
        "q06_dataset_statistics": lambda s, d: validation.dataset_statistics(first_deliveries(table(s, d, "manifest"))),
        "q07_samples_per_document": lambda s, d: samples(s, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("n")),
        "q08_character_frequency": lambda s, d: validation.character_frequency(table(s, d, "documents")),
        "q09_vocabulary": _vocabularies,
        "q10_unseen_characters": q10,
        "q10b_unseen_in_documents": lambda s, d: vocabulary.unseen_characters(table(s, d, "documents"), vocabulary.build_vocabulary(samples(s, d))),
        "q11_encode": q11,
        "q12_duplicates": lambda s, d: validation.duplicate_issues(digested_samples(s, d)).groupBy("code", "sample_id").agg(F.count(F.lit(1)).alias("n")),
        "q13_conflicts": q13,
        "q14_validation_report": lambda s, d: validation.with_messages(
            validation.text_issues(table(s, d, "manifest")).unionByName(validation.duplicate_issues(table(s, d, "manifest"), None))
        ),
        "q14b_validation_report_with_images": q14b,
        "q15_review_overlay": lambda s, d: q15(s, d, False),
        "q15b_review_overlay_with_doubtful": lambda s, d: q15(s, d, True),
        "q16_unknown_decisions": q16,
        "q17_dataset_fingerprint": q17,
        "q17b_document_fingerprints": lambda s, d: group_fingerprints(samples(s, d), "document_id"),
        "q17c_sample_lines": lambda s, d: samples(s, d).select("sample_id", sample_line().alias("line")),
        "q18_scores": lambda s, d: _scored(s, d).select(
            "sample_id", "character_edits", "word_edits", "character_error_rate", "word_error_rate", "exact_match"
        ),
        "q19_corpus_scores": lambda s, d: evaluation.corpus_scores(_scored(s, d)),
        "q20_exact_match": lambda s, d: samples(s, d).agg(
            F.count(F.lit(1)).alias("samples"), F.count_if(c("text") == hypothesis(c("text"))).alias("exact")
        ),
        "q21_edit_distances": q21,
        "q22_word_error_rates": lambda s, d: _scored(s, d).select("sample_id", total_edits(c("word_edits")).alias("edits"), c("word_edits.reference_length").alias("words"), "word_error_rate"),
        "q23_worst_samples": lambda s, d: evaluation.worst_samples(_scored(s, d)).select("sample_id", "character_error_rate"),
        "q24_confusions": lambda s, d: evaluation.confusions(_scored(s, d)),
        "q24b_frequencies": lambda s, d: evaluation.frequencies(
            samples(s, d).select(c("text").alias("reference"), hypothesis(c("text")).alias("hypothesis"))
        ),
        "q25_key_totality": q25,
        "q39_artifact_differences": q39,
        "q39b_changed_artifacts": q39b,
        "q40_file_kinds": q40,
        "q41_portable_paths": q41,
        "q42_derived_seeds": q42,
        "q43_code_points": q43,
        "q44_text_predicates": q44,
        "q48_line_widths": q48,
        "q49_urdu_numbers": q49,
        "q50_directional_runs": q50,
        "q51_text_overlap": q51,
        "q53_synthetic_lines": q53,
        "q54_composed_texts": lambda s, d: composed_texts(s, table(s, d, "nation").count(), _TEMPLATES),
        "q56_weighted_loss": q56,
        "q56b_weighted_by_size": q56b,
    }


_B = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PARTS = r"list_filter(string_split(replace(image_path, '\', '/'), '/'), lambda p: p <> '' and p <> '.')"
_PATH = rf"""case when regexp_matches(image_path, '[^{_B}]') and not contains(image_path, chr(0)) and not contains(image_path, ':')
  and not starts_with(image_path, '/') and not starts_with(image_path, '\') and not list_contains({_PARTS}, '..') and len({_PARTS}) > 0
  then array_to_string({_PARTS}, '/') end"""
_CONTROL = r"regexp_matches(replace(text, chr(8204), ''), '[\p{Cc}\p{Cf}\p{Cs}\p{Zl}\p{Zp}]')"
_COLLAPSED = rf"trim(regexp_replace(nfc_normalize(text), '[{_B}]+', ' ', 'g'))"
_NORMAL = f"case when not {_CONTROL} and {_COLLAPSED} <> '' then {_COLLAPSED} end"
_CHARS = "list_filter(string_split(text, ''), lambda c: c <> '')"
# One row per sample_id (its earliest delivery), and the sound ones among them.
_FIRST = """deliveries as (
  select * exclude (rank) from (select *, row_number() over (partition by sample_id order by record_id) as rank from manifest where sample_id is not null) where rank = 1
)"""
_SAMPLES = f"""{_FIRST}, canonical as (
  select * exclude (text, image_path, tags), {_NORMAL} as text, {_PATH} as image_path,
         list_sort(list_distinct(coalesce(list_filter(tags, lambda t: t is not null), []))) as tags
  from deliveries where schema_version = 1
    and not (page_id is not null and not regexp_matches(page_id, '[^{_B}]')) and coalesce(line_index, 0) >= 0
    and regexp_matches(sample_id, '[^{_B}]') and document_id is not null and regexp_matches(document_id, '[^{_B}]')
), samples as (select * from canonical where text is not null and image_path is not null)"""
_DIGESTED = f"""{_SAMPLES}, hashes as (
  select path, arg_max(sha256, (added_at, sha256)) as digest from artifact_manifest where path is not null group by path
), digested as (select s.*, h.digest from samples s left join hashes h on h.path = s.image_path)"""
_FOLD = """sizes as (select document_id, count(*) as n from {source} group by document_id
), ranked as (
  select document_id, n, row_number() over (order by n desc, sha256('1337' || chr(0) || document_id), document_id) as r from sizes
), total as (select sum(n) * 0.8::double as t0, sum(n) * 0.1::double as t1, sum(n) * 0.1::double as t2 from sizes
), fold(r, document_id, n, c0, c1, c2, pick) as (
  select 0::bigint, null::varchar, 0::bigint, 0::bigint, 0::bigint, 0::bigint, null::varchar
  union all
  select r, document_id, n,
         c0 + case when pick = 'train' then n else 0 end, c1 + case when pick = 'validation' then n else 0 end, c2 + case when pick = 'test' then n else 0 end, pick
  from (
    select x.r, x.document_id, x.n, f.c0, f.c1, f.c2,
           case when d0 <= d1 and d0 <= d2 then 'train' when d1 <= d2 then 'validation' else 'test' end as pick
    from fold f join ranked x on x.r = f.r + 1, total,
      lateral (select abs(f.c0 + x.n - t0) + abs(f.c1 - t1) + abs(f.c2 - t2) as d0,
                      abs(f.c0 - t0) + abs(f.c1 + x.n - t1) + abs(f.c2 - t2) as d1,
                      abs(f.c0 - t0) + abs(f.c1 - t1) + abs(f.c2 + x.n - t2) as d2)
  )
), assigned as (select document_id, n as samples, pick as "partition" from fold where r > 0)"""
_SPLIT = _SAMPLES + ", " + _FOLD.format(source="samples")


def _with(ctes: str, query: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{ctes}\n{query}"


def _hypothesis_sql(text: str) -> str:
    for old, new in _SWAPS:
        text = f"replace({text}, '{old}', '{new}')"
    return text


def _severity(code: str) -> str:
    errors = ", ".join(f"'{c}'" for c in validation.ERRORS)
    return f"case when {code} in ({errors}) then 'error' else 'warning' end"


def _messages(code: str) -> str:
    return "case " + code + " " + " ".join(f"when '{c}' then '{m}'" for c, m in validation.MESSAGES.items()) + " end"


_CODES = rf"""case when not regexp_matches(text, '[^{_B}]') then ['empty_text'] else list_filter([
    case when {_CONTROL} then 'invalid_text_control' end,
    case when nfc_normalize(text) <> text then 'non_nfc_text' end,
    case when regexp_matches(text, '^[{_B}]|[{_B}]$') then 'leading_or_trailing_whitespace' end,
    case when contains(text, '  ') or regexp_matches(text, '[{_B.replace(' ', '')}]') then 'noncanonical_whitespace' end], lambda c: c is not null) end"""


def _identity_rank(keys: str, source: str, code: str, where: str = "true") -> str:
    return f"""select '{code}' as code, sample_id from (select sample_id, row_number() over (partition by {keys} order by sample_id nulls first, image_path nulls first,
      document_id nulls first, text nulls first) as k from {source} where {where}) where k > 1"""


def _stats(value: str, name: str) -> str:
    return f"min({value}) as {name}_min, median({value})::double as {name}_median, max({value}) as {name}_max"


def _fold(a: str, b: str, steps: bool = False) -> str:
    """Distance table of two lists, row after row: costs ``c``, and along the preferred way substitutions, or all steps as text, ``s``.

    A row is the running minimum of what match, substitution and deletion give; cells that only an
    insertion reaches take what the last other cell to their left has.
    """
    same = f"({a}[x.i] <> {b}[j])::bigint"
    columns = f"range(0, len({b}) + 1)"
    if steps:
        step = lambda op, r, h: f"('{op}' || chr(1) || {r} || chr(1) || {h} || chr(2))"
        diagonal = f"p.s[j] || case when {a}[x.i] = {b}[j] then '' else {step('substitution', f'{a}[x.i]', f'{b}[j]')} end"
        above, first = f"p.s[j + 1] || {step('deletion', f'{a}[x.i]', chr(39) * 2)}", f"p.s[1] || {step('deletion', f'{a}[x.i]', chr(39) * 2)}"
        start = f"list_transform({columns}, lambda j: array_to_string(list_transform(list_slice({b}, 1, j), lambda y: {step('insertion', chr(39) * 2, 'y')}), ''))"
        last = f"list_filter(range(1, j + 2), lambda z: v[z] is not null)[-1]"
        chosen = f"list_transform([{last}], lambda z: v[z] || substr(p0[j + 1], length(p0[z]) + 1))[1]"
        kind = "varchar[]"
    else:
        diagonal, above, first = f"p.s[j] + {same}", "p.s[j + 1]", "0"
        start, kind = f"list_transform({columns}, lambda j: 0::bigint)", "bigint[]"
        chosen = "list_filter(list_slice(v, 1, j + 1), lambda z: z is not null)[-1]"
    return f"""list_transform([{start}], lambda p0: list_reduce(list_transform(range(1, len({a}) + 1), lambda i: {{'i': i, 'c': cast([] as bigint[]), 's': cast([] as {kind})}}),
  lambda p, x: list_transform([list_transform({columns}, lambda j: case when j = 0 then x.i else least(p.c[j + 1] + 1, p.c[j] + {same}) end)],
    lambda t: list_transform([list_transform({columns}, lambda j: list_min(list_transform(list_slice(t, 1, j + 1), lambda v, k: v - k)) + j + 1)],
      lambda c: list_transform([list_transform({columns}, lambda j: case when j = 0 then {first} when p.c[j] + {same} = c[j + 1] then {diagonal} when p.c[j + 1] + 1 = c[j + 1] then {above} end)],
        lambda v: {{'i': x.i, 'c': c, 's': list_transform({columns}, lambda j: {chosen})}})[1])[1])[1],
  {{'i': 0::bigint, 'c': {columns}, 's': p0}}))[1]"""


def _edits(name: str, folded: str, n: str, m: str) -> str:
    """The four counts of an alignment as columns, from its cost and its substitutions."""
    cost, subs = f"{folded}.c[-1]", f"{folded}.s[-1]"
    return f"{subs}::int as {name}_s, (({cost} - {subs} + {n} - {m}) // 2)::int as {name}_d, ({cost} - {subs} - ({cost} - {subs} + {n} - {m}) // 2)::int as {name}_i, {n}::int as {name}_n"


def _review(keep: str) -> str:
    form = "regexp_matches(lower(source_dataset_fingerprint), '^[0-9a-f]{64}$')"
    return _with(
        _SAMPLES
        + f""", sound as (
  select * from review_decisions where schema_version = 1 and regexp_matches(sample_id, '[^{_B}]') and status in ('valid', 'invalid', 'needs_review')
    and {form} and len(list_filter(coalesce(tags, []), lambda t: t is not null and not regexp_matches(t, '[^{_B}]'))) = 0
    and (note is null or (regexp_matches(note, '[^{_B}]') and length(note) <= 240 and not regexp_matches(note, '[\\r\\n]')))
    and (reviewer is null or regexp_matches(reviewer, '[^{_B}]'))
), latest as (
  select * from (select *, row_number() over (partition by sample_id order by decided_at desc nulls last, decision_id desc) as k from sound) where k = 1
)""",
        f"""select s.sample_id, array_to_string(case when l.sample_id is null then s.tags
             else list_sort(list_distinct(list_concat(s.tags, coalesce(l.tags, [])))) end, ',') as tags
           from samples s left join latest l using (sample_id) where l.status is null or l.status in ({keep})""",
    )


def oracle_sql() -> dict:
    line = """concat('{"document_id":', to_json(document_id), ',"image_path":', to_json(image_path),
      case when line_index is null then '' else ',"line_index":' || line_index end, case when page_id is null then '' else ',"page_id":' || to_json(page_id)::varchar end,
      ',"sample_id":', to_json(sample_id), ',"schema_version":1', case when len(tags) = 0 then '' else ',"tags":' || to_json(tags)::varchar end,
      ',"text":', to_json(text), '}')"""
    kind = r"""case when starts_with(regexp_replace(substr(h, 1, 2048), '^(00|09|0A|0C|0D|20)+', ''), '255044462D') then 'pdf'
      when starts_with(h, '89504E470D0A1A0A') then 'png' when starts_with(h, 'FFD8FF') then 'jpeg' end"""
    chars = f"select unnest({_CHARS}) as ch from"
    split = lambda text, by: f"list_filter(string_split({text}, '{by}'), lambda c: c <> '')"
    cut = f"""{_SAMPLES}, pairs as (select sample_id, text as r, {_hypothesis_sql("text")} as h from samples), cut as (
      select sample_id, r = h as same, {split("r", "")} as a, {split("h", "")} as b, {split("r", " ")} as w, {split("h", " ")} as v from pairs)"""
    scored = f"""{cut}, scored as (
      select sample_id, false as exact_match, {_edits("c", "f", "len(a)", "len(b)")}, {_edits("w", "g", "len(w)", "len(v)")} from (select *, {_fold("a", "b")} as f, {_fold("w", "v")} as g from cut where not same)
      union all select sample_id, true, 0, 0, 0, len(a)::int, 0, 0, 0, len(w)::int from cut where same)"""
    counts = lambda n: f"struct_pack(substitutions := {n}_s, deletions := {n}_d, insertions := {n}_i, reference_length := {n}_n)"
    rate = lambda n: f"case when {n}_n > 0 then ({n}_s + {n}_d + {n}_i)::double / {n}_n end"
    sums = lambda n, name: ", ".join(f"coalesce(sum({n}_{x}), 0)::bigint as {name}_{y}" for x, y in zip("sdin", ("substitutions", "deletions", "insertions", "reference_length")))
    whole = lambda n: f"case when sum({n}_n) > 0 then sum({n}_s + {n}_d + {n}_i)::double / sum({n}_n) end"
    word_list = rf"list_filter(regexp_split_to_array(text, '[{_B}]+'), lambda w: w <> '')"
    return {
        "q01_split_counts": _with(
            _SPLIT,
            """select p as "partition", coalesce(count(a.document_id), 0) as documents, coalesce(sum(a.samples), 0)::bigint as samples,
                 coalesce(sum(a.samples)::double / (select sum(samples) from assigned), 0) as ratio
               from (select unnest(['train', 'validation', 'test']) as p) left join assigned a on a."partition" = p group by p""",
            True,
        ),
        "q02_split_assignments": _with(_SPLIT, "select * from assigned", True),
        "q03_leakage": _with(_DIGESTED, "select 'conflicting_label' as kind, digest as key from digested where digest is not null group by digest having count(distinct text) > 1"),
        "q04_issue_codes": f"select record_id, array_to_string({_CODES}, ',') as codes from manifest where text is not null",
        "q05_normalized_text": f"select record_id, {_NORMAL} as text from manifest",
        "q06_dataset_statistics": _with(
            _FIRST,
            f"""select (select count(*) from deliveries) as samples, (select count(distinct document_id) from deliveries) as documents,
                  (select count(*) from deliveries where text is null or not regexp_matches(text, '[^{_B}]')) as empty_texts, a.*, b.*,
                  (select count(distinct ch) from ({chars} deliveries)) as distinct_characters
                from (select {_stats("length(text)", "characters")}, {_stats(f"len({word_list})", "words")} from deliveries) a,
                     (select {_stats("n", "samples_per_document")} from (select count(*) as n from deliveries group by document_id)) b""",
        ),
        "q07_samples_per_document": _with(_SAMPLES, "select document_id, count(*) as n from samples group by 1"),
        "q08_character_frequency": f"select ch, count(*) as n from ({chars} documents) group by 1",
        "q09_vocabulary": _with(_SAMPLES, f"select row_number() over (order by ch)::int as idx, ch from (select distinct ch from ({chars} samples))"),
        "q10_unseen_characters": _with(
            _SPLIT,
            f"""select distinct ch from ({chars} samples s join assigned a using (document_id) where a."partition" <> 'train')
                where ch not in ({chars} samples s join assigned a using (document_id) where a."partition" = 'train')""",
            True,
        ),
        "q10b_unseen_in_documents": _with(_SAMPLES, f"select distinct ch from ({chars} documents) where ch not in ({chars} samples)"),
        "q13_conflicts": _with(
            _DIGESTED, "select digest, count(distinct text) as texts, count(*)::bigint as samples from digested where digest is not null group by 1 having count(distinct text) > 1"
        ),
        "q39b_changed_artifacts": """with r as (select path, arg_max(struct_pack(z := size_bytes, h := sha256), (added_at, sha256)) as a from artifact_manifest
              where path is not null and added_at < timestamp '2024-07-01 00:00:00' group by path),
            b as (select path, arg_max(struct_pack(z := size_bytes, h := sha256), (added_at, sha256)) as b from artifact_manifest where path is not null and deleted_at is null group by path)
            select * from (select path, case when r.path is null then 'extra' when b.path is null then 'missing' when a.z is not null and a.z <> b.z then 'size' when a.h <> b.h then 'sha256' end as issue
              from r full join b using (path)) where issue is not null""",
        "q56b_weighted_by_size": """select l_returnflag, round(sum(l_extendedprice::double * l_quantity::double) / sum(l_quantity::double), 4) as loss from lineitem group by 1""",
        "q11_encode": _with(
            f"{_SAMPLES}, vocab as (select row_number() over (order by ch) as idx, ch from (select distinct ch from ({chars} samples))), "
            f"pieces as (select sample_id, unnest({_CHARS}) as ch, generate_subscripts({_CHARS}, 1) as p from samples)",
            "select sample_id, string_agg(idx::varchar, ' ' order by p) as indices from pieces join vocab using (ch) group by 1",
        ),
        "q12_duplicates": _with(
            _DIGESTED,
            "select code, sample_id, count(*) as n from ("
            + " union all ".join(
                [
                    _identity_rank("sample_id", "digested", "duplicate_sample_id"),
                    _identity_rank("image_path", "digested", "duplicate_image_path"),
                    _identity_rank("digest", "digested", "duplicate_image", "digest is not null"),
                    _identity_rank("digest, text", "digested", "duplicate_pair", "digest is not null"),
                    """select 'conflicting_image_text', sample_id from digested where digest in
                         (select digest from digested where digest is not null group by 1 having count(distinct text) > 1)""",
                ]
            )
            + ") group by all",
        ),
        "q14_validation_report": f"""select code, {_severity("code")} as severity, {_messages("code")} as message, sample_id from (
            select unnest(list_concat(case when text is null then ['empty_text'] else {_CODES} end, case when length(text) > 512 then ['unusually_long_text'] else [] end)) as code, sample_id from manifest
            union all {_identity_rank("sample_id", "manifest", "duplicate_sample_id")} union all {_identity_rank("image_path", "manifest", "duplicate_image_path")})""",
        "q15_review_overlay": _review("'valid'"),
        "q15b_review_overlay_with_doubtful": _review("'valid', 'needs_review'"),
        "q16_unknown_decisions": "select decision_id, sample_id from review_decisions d where not exists (select 1 from manifest m where m.sample_id = d.sample_id)",
        "q17_dataset_fingerprint": _with(_SAMPLES, f"select sha256(string_agg({line} || chr(10), '' order by sample_id)) as fingerprint from samples"),
        "q17b_document_fingerprints": _with(
            _SAMPLES, f"select document_id, sha256(string_agg({line} || chr(10), '' order by sample_id)) as fingerprint, count(*) as samples from samples group by 1"
        ),
        "q17c_sample_lines": _with(_SAMPLES, f"select sample_id, {line} as line from samples"),
        "q18_scores": _with(
            scored,
            f"select sample_id, {counts('c')} as character_edits, {counts('w')} as word_edits, {rate('c')} as character_error_rate, {rate('w')} as word_error_rate, exact_match from scored",
        ),
        "q19_corpus_scores": _with(
            scored,
            f"""select count(*) as samples, count(*) filter (exact_match) as exact_matches, {sums("c", "character")}, {sums("w", "word")}, {whole("c")} as character_error_rate,
                  {whole("w")} as word_error_rate, case when count(*) > 0 then count(*) filter (exact_match)::double / count(*) end as exact_match_rate from scored""",
        ),
        "q21_edit_distances": _with(
            scored, f"select sample_id, (c_s + c_d + c_i)::int as distance, {rate('c')} as rate from scored"
        ),
        "q22_word_error_rates": _with(scored, f"select sample_id, (w_s + w_d + w_i)::int as edits, w_n as words, {rate('w')} as word_error_rate from scored"),
        "q23_worst_samples": _with(
            scored, f"select sample_id, {rate('c')} as character_error_rate from scored order by character_error_rate desc nulls last, c_s + c_d + c_i desc, sample_id limit 10"
        ),
        "q24_confusions": _with(
            f"""{cut}, steps as (select unnest(list_filter(string_split(({_fold("a", "b", True)}).s[-1], chr(2)), lambda x: x <> '')) as x from cut where not same)""",
            """select split_part(x, chr(1), 1) as op, nullif(split_part(x, chr(1), 2), '') as reference, nullif(split_part(x, chr(1), 3), '') as hypothesis, count(*) as n from steps group by all""",
        ),
        "q20_exact_match": _with(_SAMPLES, f"select count(*) as samples, count(*) filter (text = {_hypothesis_sql('text')}) as exact from samples"),
        "q24b_frequencies": _with(
            _SAMPLES,
            f"""select side, ch, count(*) as n from (select 'reference' as side, unnest({_CHARS}) as ch from samples union all
                  select 'hypothesis', unnest({_CHARS}) from (select {_hypothesis_sql("text")} as text from samples)) group by all""",
        ),
        "q25_key_totality": _with(
            f"{_SAMPLES}, p as (select distinct sample_id from review_decisions where sample_id is not null)",
            """select side, count(*) as n, min(sample_id) as first from (
                 select 'missing' as side, sample_id from samples where sample_id not in (select sample_id from p) union all
                 select 'extra', sample_id from p where sample_id not in (select sample_id from samples)) group by 1""",
        ),
        "q39_artifact_differences": """with f as (select path, arg_min(struct_pack(z := size_bytes, h := sha256), (added_at, sha256)) as a,
              arg_max(struct_pack(z := size_bytes, h := sha256), (added_at, sha256)) as b from artifact_manifest where path is not null group by path)
            select path, case when a.z <> b.z then 'size' else 'sha256' end as issue from f where (a.z is not null and a.z <> b.z) or a.h <> b.h""",
        "q40_file_kinds": f"""select doc_id, strlen(text) as bytes, sha256(text) as sha256, {kind} as kind from (select doc_id, text, hex(encode(text)) as h from documents)""",
        "q41_portable_paths": f"select record_id, {_PATH} as path from manifest",
        "q42_derived_seeds": """select sample_id, ('0x' || substr(sha256('1337' || chr(0) || sample_id), 1, 16))::ubigint::varchar as seed
            from (select distinct sample_id from manifest where sample_id is not null)""",
        "q43_code_points": """select row_id, 'U+' || lpad(upper(to_hex(unicode("character"))), greatest(4, length(to_hex(unicode("character"))))::int, '0') as label,
              'U+' || lpad(upper(to_hex(unicode("character"))), greatest(4, length(to_hex(unicode("character"))))::int, '0') = code_point as agrees
            from error_analysis where "character" is not null and "character" <> ''""",
        "q44_text_predicates": f"""select doc_id, {_CONTROL} as control, len(list_filter(string_split(text, ' '), lambda t: t <> ''))::int as tokens, length(text)::int as chars
            from documents where text is not null""",
        "q48_line_widths": """select record_id, line_id, w, h, scaled, case when scaled between 4 and 2048 then (scaled // 2) // 2 end as frames from (
            select record_id, line_id, w, h, ((2 * w::bigint * 64 + h) // (2 * h::bigint))::int as scaled from (
              select record_id, l.line_id, l.output_box.width as w, l.output_box.height as h from (select record_id, unnest(lines) as l from page_ground)) where w > 0 and h > 0)""",
        "q49_urdu_numbers": """select record_id, translate(lpad(line_index::varchar, greatest(4, length(line_index::varchar))::int, '0'), '0123456789', '۰۱۲۳۴۵۶۷۸۹') as number from manifest where line_index is not null""",
        "q51_text_overlap": _with(
            _SPLIT + """, t as (select distinct a."partition" as p, s.text from samples s join assigned a using (document_id))""",
            "select l.p as a, r.p as b, count(*) as texts from t l join t r on l.text = r.text and l.p < r.p group by all",
            True,
        ),
        "q53_synthetic_lines": """select 'synthetic-' || lpad(n::varchar, greatest(6, length(n::varchar))::int, '0') as sample_id, """
        + "list_extract([" + ", ".join(f"'{t}'" for t in _LINES) + f"], ((n - 1) % {len(_LINES)} + 1)::int) as text, "
        + """'document-' || lpad((((n - 1) // 4) + 1)::varchar, greatest(4, length((((n - 1) // 4) + 1)::varchar))::int, '0') as document_id, ((n - 1) % 4)::int as line_index,
             ('0x' || substr(sha256('1337' || chr(0) || 'synthetic-' || lpad(n::varchar, greatest(6, length(n::varchar))::int, '0')), 1, 16))::ubigint::varchar as seed
             from (select unnest(range(1, (select count(*) * 40 + 1 from nation))) as n)""",
        "q54_composed_texts": "select d as document, t::int as template, d * 3 + t + 1 as number, replace(list_extract(["
        + ", ".join(f"'{t}'" for t in _TEMPLATES)
        + "], (t + 1)::int), '{number}', translate(lpad((d * 3 + t + 1)::varchar, greatest(4, length((d * 3 + t + 1)::varchar))::int, '0'), '0123456789', '۰۱۲۳۴۵۶۷۸۹')) as text "
        + "from (select unnest(range(0, (select count(*) from nation))) as d), (select unnest(range(0, 3)) as t)",
        "q56_weighted_loss": "select user_id, round(avg(value), 6) as loss from events group by 1",
    }
