"""Queries and SQL of the training-data operators that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.operators import nested, snapdiff


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _shredded(spark: SparkSession, sf_dir: str) -> nested.Shredded:
    return nested.shredded(_read(spark, sf_dir, "raw_pages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.section_paths(_shredded(spark, sf_dir))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a document can be said without its identity."""
    return nested.nested_documents(_shredded(spark, sf_dir)).select("raw_id", "title", "link", "n_objects", "n_sections")


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.nested_links(_shredded(spark, sf_dir)).select("raw_id", "section_path", "ordinal", "href", "link_text")


def p3_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their parents and texts."""
    return nested.nested_sections(_shredded(spark, sf_dir)).select("raw_id", "section_path", "parent_path", "key", "ordinal", "heading", "content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapdiff.corpus_changes(_read(spark, sf_dir, "corpus_snapshots"))


QUERIES = {
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p3_links": p3_links,
    "p3_places": p3_places,
    "p3_sections": lambda s, d: nested.nested_sections(_shredded(s, d)),
    "p3_bridge": lambda s, d: _shredded(s, d).bridge,
    "p3_objects": lambda s, d: _shredded(s, d).objects,
    "p3_documents": lambda s, d: nested.nested_documents(_shredded(s, d)),
    "p3_deliveries": lambda s, d: _shredded(s, d).deliveries,
    "p4_found": p4_found,
}

# every value of every payload: as a string that holds JSON, an object's fields or an array's elements lead on
_NODES = r"""with recursive raw as (select distinct raw_id, payload from raw_pages where payload is not null and json_valid(payload)),
node(raw_id, payload, v, k, o, sec, direct, around) as (
  select raw_id, payload, payload::json, cast(null as varchar), 0, false, false, cast(null as varchar) from raw
  union all
  select raw_id, payload, e.v, e.k, e.o, e.sec, e.direct, e.around from (
    select raw_id, payload, unnest(case json_type(v)
      when 'VARCHAR' then case when regexp_matches(v->>'$', '^\s*[{\["]') and json_valid(v->>'$') then [{'v': try_cast(v->>'$' as json), 'k': k, 'o': o, 'sec': sec, 'direct': direct, 'around': around}] else [] end
      when 'OBJECT' then list_transform(map_entries(try_cast(v as map(varchar, json))), lambda e: {'v': e.value, 'k': e.key, 'o': 0, 'sec': e.key in ('sections', 'children'), 'direct': true, 'around': case when sec then concat_ws('/', around, o) else around end})
      when 'ARRAY' then list_transform(range(json_array_length(v)::bigint), lambda i: {'v': json_extract(v, '$[' || i || ']'), 'k': k, 'o': i::integer, 'sec': sec and direct, 'direct': false, 'around': around})
      else [] end) as e from node)),
opened as (select *, case when sec then concat_ws('/', around, o) else around end as path from node where json_type(v) = 'OBJECT')
"""


def _readable(x: str) -> str:
    """SQL of the text of a JSON value: of a list its parts, of an object its text."""
    at = f"json_extract({x}, '$[' || i || ']')"
    one = f"case json_type({at}) when 'OBJECT' then {at}->>'text' when 'BOOLEAN' then null when 'NULL' then null else {at}->>'$' end"
    parts = f"nullif(array_to_string(list_filter(list_transform(range(json_array_length({x})::bigint), lambda i: {one}), lambda y: y is not null and y <> ''), chr(10)), '')"
    return f"case json_type({x}) when 'ARRAY' then {parts} when 'OBJECT' then nullif({x}->>'text', '') when 'BOOLEAN' then null when 'NULL' then null else {x}->>'$' end"


ORACLES = {
    "p3_places": _NODES + f"select raw_id, path as section_path, around as parent_path, k as key, o as ordinal, {_readable("json_extract(v, '$.heading')")} as heading, {_readable("json_extract(v, '$.content')")} as content from opened where sec",
    "p3_found": _NODES + "select distinct raw_id, path as section_path from opened where sec",
    "p3_counts": _NODES + """, roots as (select raw_id, payload, count(*) as n_objects, cast(count(*) filter (where sec) as bigint) as n_sections,
  min(v->>'title') filter (where path is null and k is distinct from 'links') as title, min(v->>'link') filter (where path is null and k is distinct from 'links') as link from opened group by raw_id, payload)
select raw_id, title, link, n_objects, n_sections from roots""",
    "p3_links": _NODES + "select raw_id, path as section_path, o as ordinal, v->>'href' as href, v->>'text' as link_text from opened where k = 'links' and path is not null",
    "p4_found": r"""
with cleaned as (
  select snapshot_date,
         regexp_extract(l, '^([A-Za-z][A-Za-z0-9+.\-]*://)?([^/?#]*)(.*)$', 1) as scheme,
         regexp_extract(l, '^([A-Za-z][A-Za-z0-9+.\-]*://)?([^/?#]*)(.*)$', 2) as host,
         regexp_extract(l, '^([A-Za-z][A-Za-z0-9+.\-]*://)?([^/?#]*)(.*)$', 3) as rest,
         trim(replace(coalesce(title, ''), chr(160), ' '), E' \n\t\r') as title,
         list_filter(list_transform(coalesce(sections, []), lambda s: {
             'h': coalesce(nullif(trim(replace(coalesce(s.heading, ''), chr(160), ' '), E' \n\t\r'), ''), '(ingen overskrift)'),
             'c': trim(replace(coalesce(s.content, ''), chr(160), ' '), E' \n\t\r')}), lambda s: s.c <> '') as secs,
         scraped_at
  from (select *, trim(link, E' \n\t\r' || chr(160)) as l from corpus_snapshots) where l <> ''),
latest as (
  select snapshot_date, link, arg_max(title, scraped_at) as title, arg_max(secs, scraped_at) as secs
  from (select *, lower(scheme) || regexp_replace(lower(host), ':443$', '') || rest as link from cleaned)
  group by snapshot_date, link),
days as (select d, lead(d) over (order by d) as n from (select distinct snapshot_date as d from latest)),
older as (select days.n as snapshot_date, link, title, secs from latest join days on days.d = latest.snapshot_date where days.n is not null),
newer as (select * from latest where snapshot_date in (select n from days where n is not null))
select strftime(snapshot_date, '%Y-%m-%d') as snapshot_date, link,
       case when o.link is null then 'added' when n.link is null then 'removed' else 'changed' end as change_kind
from (select snapshot_date, link, title as nt, secs as ns, link as l1 from newer) n_
full outer join (select snapshot_date, link, title as ot, secs as os, link as l2 from older) o_ using (snapshot_date, link)
cross join lateral (select l2 as link) o cross join lateral (select l1 as link) n
where l1 is null or l2 is null or nt <> ot or ns <> os
""",
}
