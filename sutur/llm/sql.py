"""DuckDB SQL for those queries of the subpackage that SQL can express on whole tables."""

from __future__ import annotations

# Fixed value: the code points for which Python's str.isspace() is true, as an RE2 class body.
BLANKS = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_TERMS = rf"""
with once as (
  select sample_id, arg_min(t, record_id) as t
  from (select sample_id, record_id, struct_pack(text := text) as t from manifest where sample_id is not null) group by sample_id
), pieces as (
  select sample_id, unnest(regexp_split_to_array(nfc_normalize(t.text), '[{BLANKS}]+')) as term from once where t.text is not null
), words as (
  select term, count(*) as occurrences, count(distinct sample_id) as records from pieces where term <> '' group by term
), n as (
  select (select count(distinct sample_id) from manifest) as samples, (select count(distinct report_id) from error_analysis) as reports
), rows_once as (
  select distinct report_id, op, "character", "count" from error_analysis
  where "character" is not null and "character" <> '' and "count" >= 1
), chars as (
  select "character" as term, cast(sum("count") as bigint) as occurrences, count(distinct report_id) as records from rows_once group by 1
), terms as (
  select 'manifest.text' as field, term, occurrences, records,
         case when records <= 2 then 'rare' when records * 20 > samples then 'common' end as mark
  from words, n
  union all
  select 'error_analysis.character', term, occurrences, records,
         case when occurrences < 5 then 'rare' when records * 2 > reports then 'common' end
  from chars, n
)
"""



def _canon(column: str) -> str:
    """Canonical spelling of an id: letter case, outer blanks and Urdu digits levelled."""
    return f"translate(lower(regexp_replace({column}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')), '۰۱۲۳۴۵۶۷۸۹', '0123456789')"


_GROUPS = f"""
with recursive docs as (
  select distinct document_id, {_canon('document_id')} as k from manifest where document_id is not null
), links as (
  select distinct {_canon('document_id')} as k, entity_kind as kind, {_canon('entity_id')} as e
  from document_entities where document_id is not null and entity_id is not null and entity_kind is not null
), usable as (
  select distinct k, kind, e from links where e not in ('', 'unknown', 'n/a', '-') and k in (select k from docs)
), edges as (
  select distinct a.k as a, b.k as b from usable a join usable b on a.kind = b.kind and a.e = b.e
  union select k, k from docs
), reach as (
  select a, b from edges
  union
  select r.a, e.b from reach r join edges e on r.b = e.a
), roots as (
  select a as k, min(b) as root from reach group by a
), groups as (
  select min(document_id) over (partition by root) as group_id, document_id from docs join roots using (k)
), latest as (
  select document_id, arg_max(struct_pack(p := "partition"), (assigned_at, assignment_id)).p as raw from split_metadata group by document_id
), named as (
  select document_id, lower(regexp_replace(raw, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')) as p from latest
), parts as (
  select document_id, case p when 'val' then 'validation' when '' then null else p end as p from named
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_groups": _GROUPS + "select group_id, document_id from groups",
        "p2_found": _GROUPS
        + """select group_id, document_id from groups where group_id in (
               select group_id from groups join parts using (document_id) group by group_id having count(distinct p) > 1)""",
        "p5_found": _TERMS + "select field, term, mark from terms where mark is not null",
        "p5_terms": _TERMS + "select * from terms",
    }
