"""Problem 4: references of the manifest and of review decisions to rows that are not there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sutur.functions.paths import portable_path
from sutur.operators.references import orphan_references, orphan_report
from sutur.session import table

_IMAGE, _SAMPLE, _DATASET = "manifest.image_path", "review_decisions.sample_id", "review_decisions.source_dataset_fingerprint"


def _side(df: DataFrame, field: str, key, **columns) -> DataFrame:
    return df.select(F.lit(field).alias("ref_field"), key.alias("key"), *[c.alias(n) for n, c in columns.items()])


def corpus_orphans(manifest: DataFrame, reviews: DataFrame, artifacts: DataFrame, datasets: DataFrame) -> DataFrame:
    """Orphans of the three reference fields. Null references are none."""
    c = F.col
    forever = F.lit(None).cast("timestamp_ntz")
    refs = _side(manifest.where("image_path is not null"), _IMAGE, portable_path(c("image_path")), row_id=c("record_id"), at=c("loaded_at"))
    for field in (_SAMPLE, _DATASET):
        name = field.split(".")[1]
        key = c(name) if field == _SAMPLE else F.lower(c(name))
        refs = refs.unionByName(_side(reviews.where(c(name).isNotNull()), field, key, row_id=c("decision_id"), at=c("decided_at")))
    parents = _side(artifacts, _IMAGE, c("path"), begins=c("added_at"), ends=c("deleted_at"))
    parents = parents.unionByName(_side(manifest, _SAMPLE, c("sample_id"), begins=c("loaded_at"), ends=forever))
    parents = parents.unionByName(
        _side(datasets, _DATASET, F.lower(c("dataset_fingerprint")), begins=c("registered_at"), ends=c("retired_at"))
    )
    return orphan_references(refs, parents)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_orphans(*[table(spark, sf_dir, n) for n in ("manifest", "review_decisions", "artifact_manifest", "datasets")])


def queries() -> dict:
    return {
        "p4_found": lambda spark, sf_dir: _orphans(spark, sf_dir).select("ref_field", "row_id"),
        "p4_orphans": lambda spark, sf_dir: _orphans(spark, sf_dir).select(
            "ref_field", "row_id", F.date_format("at", "yyyy-MM").alias("month"), "kind"
        ),
        "p4_report": lambda spark, sf_dir: orphan_report(_orphans(spark, sf_dir)),
    }


_ORPHANS = r"""
with m as (
  select record_id, loaded_at, sample_id, image_path,
         list_filter(string_split(replace(image_path, '\', '/'), '/'), lambda p: p <> '' and p <> '.') as parts
  from manifest
), paths as (
  select record_id, loaded_at,
         case when regexp_matches(image_path, '[^\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')
                   and not contains(image_path, chr(0)) and not contains(image_path, ':')
                   and not starts_with(image_path, '/') and not starts_with(image_path, '\')
                   and not list_contains(parts, '..') and len(parts) > 0
              then array_to_string(parts, '/') end as k
  from m where image_path is not null
), refs as (
  select 'manifest.image_path' as ref_field, k, record_id as row_id, loaded_at as ts from paths
  union all
  select 'review_decisions.sample_id', sample_id, decision_id, decided_at from review_decisions where sample_id is not null
  union all
  select 'review_decisions.source_dataset_fingerprint', lower(source_dataset_fingerprint), decision_id, decided_at
  from review_decisions where source_dataset_fingerprint is not null
), parents as (
  select 'manifest.image_path' as ref_field, path as k, added_at as b, deleted_at as e from artifact_manifest
  union all
  select 'review_decisions.sample_id', sample_id, loaded_at, null from manifest
  union all
  select 'review_decisions.source_dataset_fingerprint', lower(dataset_fingerprint), registered_at, retired_at from datasets
), judged as (
  select r.ref_field, r.row_id, r.ts,
         count(p.k) as known,
         count(*) filter (p.k is not null and p.b <= r.ts) as begun,
         count(*) filter (p.k is not null and p.b <= r.ts and (p.e is null or p.e > r.ts)) as live
  from refs r left join parents p on p.ref_field = r.ref_field and p.k = r.k
  group by r.ref_field, r.row_id, r.ts
), orphans as (
  select ref_field, row_id, strftime(ts, '%Y-%m') as month,
         case when begun > 0 then 'deleted' when known > 0 then 'late' else 'missing' end as kind
  from judged where live = 0
)
"""


def oracle_sql() -> dict:
    return {
        "p4_found": _ORPHANS + "select ref_field, row_id from orphans",
        "p4_orphans": _ORPHANS + "select ref_field, row_id, month, kind from orphans",
        "p4_report": _ORPHANS + "select split_part(ref_field, '.', 1) as tbl, ref_field, month, kind, count(*) as n from orphans group by all",
    }
