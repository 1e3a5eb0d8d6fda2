"""Queries of the BI side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators import bi
from loomtrace.plans.estate import Estate
from loomtrace.plans.suite import Suite

suite = Suite()


@suite("c1_bi_field_nodes", "select * from e_fields where lower(schema_name) in ('s1', 's3')")
def _(e: Estate) -> DataFrame:
    return bi.bi_field_nodes(e.fields, ["s1", "S3"])


_PATHS = """parts as (select collection_id, unnest(range(len(string_split(location, '/')))) as place, unnest(string_split(location, '/')) as part from e_collections),
    paths as (select c.collection_id, coalesce(string_agg(a.name, '/' order by p.place) || '/', '') || any_value(c.name) as path from e_collections c left join parts p on p.collection_id = c.collection_id and part <> '' left join e_collections a on a.collection_id::varchar = p.part group by c.collection_id)"""


@suite("c2_collection_paths", f"with {_PATHS} select * from paths")
def _(e: Estate) -> DataFrame:
    return bi.collection_paths(e.collections)


_GLOBS = "select 'team 1*' as glob union all select '*/Team 5' union all select 'personal' union all select 'Team 2' union all select 'Team ??' union all select 'nothing[x]'"
_HITS = f"{_PATHS}, cm as (select distinct c.collection_id, g.glob from e_collections c join paths p on p.collection_id = c.collection_id join ({_GLOBS}) g on lower(c.name) glob lower(g.glob) or lower(p.path) glob lower(g.glob) or (c.personal and 'personal' glob lower(g.glob)))"


def _excluded(e: Estate) -> DataFrame:
    return bi.collections_matching(e.collections, bi.collection_paths(e.collections), e.sql(_GLOBS))


@suite("c3_collections_matching", f"with {_HITS} select * from cm")
def _(e: Estate) -> DataFrame:
    return _excluded(e)


@suite("c4_scope_cards", f"with {_HITS} select card_id, collection_id from e_cards where collection_id not in (select collection_id from cm)")
def _(e: Estate) -> DataFrame:
    return bi.scope_cards(e.cards.select("card_id", "collection_id"), _excluded(e))


@suite("c5_query_kind", "select card_id, case when (dataset_query->>'type') = 'native' then 'native' when (dataset_query->'stages') is not null then 'stages' when (dataset_query->'query') is not null then 'legacy' end as kind from e_cardq")
def _(e: Estate) -> DataFrame:
    return bi.query_kind(e.cardq)


_REFS = """t as (select q.card_id, j.fullkey, j.value as v from e_cardq q, json_tree(q.dataset_query::json) j where j.type = 'ARRAY' and j.value->>0 in ('field', 'metric')),
    refs as (select card_id, replace(regexp_replace(regexp_replace(regexp_extract(replace(fullkey, '"', ''), '^\\$((\\.query|\\.stages\\[\\d+\\])((\\.joins\\[\\d+\\])?\\.source-query|\\.joins\\[\\d+\\]\\.stages\\[\\d+\\])*)', 1), '\\[(\\d+)\\]', '#\\1', 'g'), '^$', ''), '$', '') as lv, v->>0 as kind, json_type(v->1) = 'OBJECT' as late, v, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(fullkey, '"', ''), '^\\$\\.stages\\[0\\]\\.', '$.'), '^\\$\\.stages\\[(\\d+)\\]\\.', '$.stage\\1.'), '\\[\\d+\\]', '', 'g'), '^\\$\\.query\\.', ''), '^\\$\\.', ''), 'filters', 'filter'), 'conditions', 'condition') as label from t),
    rf as (select card_id, label, kind, case when late then v->>2 else v->>1 end as target, case when late then v->1->>'source-field' else v->2->>'source-field' end as source_field, case when late then v->1->>'join-alias' else v->2->>'join-alias' end as join_alias, lv as level from refs)"""


def _refs(e: Estate) -> DataFrame:
    return bi.walk_query(e.cardq)


@suite("c6_walk_query", f"with {_REFS} select card_id, label, kind, count(*) as n from rf group by card_id, label, kind")
def _(e: Estate) -> DataFrame:
    return _refs(e).groupBy("card_id", "label", "kind").agg(F.count(F.lit(1)).alias("n"))


@suite("c7_normalise_ref", f"with {_REFS} select * from rf")
def _(e: Estate) -> DataFrame:
    return _refs(e).drop("ord")


@suite("c8_implicit_join_refs", f"with {_REFS} select card_id, label, target, false as implicit_join from rf union all select card_id, label, source_field, true from rf where source_field is not null")
def _(e: Estate) -> DataFrame:
    return bi.implicit_join_refs(_refs(e)).select("card_id", "label", "target", "implicit_join")


@suite(
    "c9_upstream_cards",
    f"""with {_REFS} select distinct card_id, u::bigint as upstream from (select q.card_id, regexp_extract(j.value->>'source-table', '^card__(\\d+)$', 1) as u from e_cardq q, json_tree(q.dataset_query::json) j where j.type = 'OBJECT' and json_type(j.value->'source-table') = 'VARCHAR'
    union all select card_id, dataset_query->'stages'->0->>'source-card' from e_cardq union all select card_id, target from rf where kind = 'metric') where u <> ''""",
)
def _(e: Estate) -> DataFrame:
    return bi.upstream_cards(e.cardq, _refs(e)).drop("ord")


@suite(
    "c10_source_context",
    """with s as (select card_id, coalesce(dataset_query->'query'->'source-query'->>'source-table', dataset_query->'query'->>'source-table', dataset_query->'stages'->0->>'source-table') as s, dataset_query->'stages'->0->>'source-card' as c from e_cardq)
    select card_id, try_cast(s as bigint) as table_id, coalesce(try_cast(regexp_extract(s, '^card__(\\d+)$', 1) as bigint), c::bigint) as source_card from s""",
)
def _(e: Estate) -> DataFrame:
    return bi.source_context(e.cardq)


_BYID = f"{_REFS}, bid as (select r.card_id, label, target, try_cast(target as bigint) as field_id, source_field, join_alias, case when f.field_id is not null then 'resolved' when try_cast(target as bigint) is not null then 'unknown' when target is null then 'malformed' else 'by_name' end as status from rf r left join e_fields f on f.field_id = try_cast(r.target as bigint) where kind = 'field')"


@suite("c11_resolve_refs_by_id", f"with {_BYID} select * from bid")
def _(e: Estate) -> DataFrame:
    return bi.resolve_refs_by_id(_refs(e), e.fields)


_CTX = "select card_id, case when card_id % 3 <> 1 then card_id % 25 end as table_id, source_card_id as source_card from e_cards"
_FT = "select f.field_id, f.column_name, t.table_id from e_fields f join e_tables t on t.table_name = f.table_name and t.schema_name = f.schema_name"
#: Join aliases by query level; of an alias that two joins of one level bear the first counts.
_SCOPES = """jn as (select q.card_id, replace(regexp_replace(regexp_extract(replace(j.fullkey, '"', ''), '^\\$((\\.query|\\.stages\\[\\d+\\])((\\.joins\\[\\d+\\])?\\.source-query|\\.joins\\[\\d+\\]\\.stages\\[\\d+\\])*)', 1), '\\[(\\d+)\\]', '#\\1', 'g'), '$', '') as level,
      j.value->>'alias' as alias, case when j.fullkey like '$.stages%' then j.value->'stages'->0->>'source-table' else j.value->>'source-table' end as source, j.fullkey as place
      from e_cardq q, json_tree(q.dataset_query::json) j where j.type = 'OBJECT' and regexp_matches(replace(j.fullkey, '"', ''), '\\.joins\\[\\d+\\]$') and j.value->>'alias' is not null),
    js as (select card_id, level, alias, try_cast(arg_min(coalesce(source, 'none'), place) as bigint) as table_id from jn group by card_id, level, alias)"""


@suite("c12_join_scopes", f"with {_SCOPES} select * from js")
def _(e: Estate) -> DataFrame:
    return bi.join_scopes(e.cardq)


@suite(
    "c12_resolve_refs_by_name",
    f"""with {_REFS}, {_SCOPES}, ft as ({_FT}), one as (select table_id, lower(column_name) as low, min(field_id) as f from ft group by 1, 2 having count(*) = 1),
    up as (select u.card_id, lower(column_name) as low, min(u.field_id) as f from e_consumed u join e_fields f on f.field_id = u.field_id group by 1, 2 having count(distinct u.field_id) = 1),
    x as (select n.card_id, n.label, n.target, n.join_alias, j.card_id is not null and j.table_id is not null as fin, a.f as fa, b.f as fb, c.f as fc from rf n left join js j on j.card_id = n.card_id and j.level = n.level and j.alias = n.join_alias left join ({_CTX}) k on k.card_id = n.card_id
      left join one a on a.table_id = j.table_id and a.low = lower(target) left join one b on b.table_id = k.table_id and b.low = lower(target) left join up c on c.card_id = k.source_card and c.low = lower(target)
      where n.kind = 'field' and try_cast(n.target as bigint) is null),
    y as (select *, case when fin then fa else coalesce(fb, fc) end as field_id from x)
    select card_id, label, target, field_id, case when field_id is not null then case when fin or (fb is not null and join_alias is null) then 'exact' else 'parsed' end end as confidence from y""",
)
def _(e: Estate) -> DataFrame:
    results = bi.result_fields(e.cardq.select("card_id", F.lit(None).cast("string").alias("result_metadata")))  # the tables hold none
    named = _refs(e).where(F.col("kind") == "field").where(F.col("target").try_cast("bigint").isNull())
    return bi.resolve_refs_by_name(named, e.sql(_CTX), e.sql(_FT), bi.join_scopes(e.cardq), e.consumed.select("card_id", "field_id").distinct(), results)


@suite("c13_consumption", "select card_id, field_id, string_agg(distinct clause, ', ' order by clause) as clauses, bool_or(implicit_join) as implicit_join from e_consumed group by card_id, field_id")
def _(e: Estate) -> DataFrame:
    return bi.consumption(e.consumed)


@suite(
    "c14_native_template_tags",
    "with t as (select distinct card_id, unnest(regexp_extract_all(sql, '\\{\\{\\s*([^{}]+?)\\s*\\}\\}', 1)) as tag from e_native) select card_id, tag, case when tag like '#%' then 'card' when lower(tag) like 'snippet:%' then 'snippet' else 'variable' end as kind from t",
)
def _(e: Estate) -> DataFrame:
    return bi.native_template_tags(e.native)


@suite(
    "c15_substitute_tags",
    """select card_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(sql, '[[', ''), ']]', ''), '{{region}}', '1 = 1'), '{{ since }}', '''1970-01-01'''), '{{n}}', '1'), '{{ pick}}', case when card_id % 2 = 0 then '(select 1)' else '''tag''' end), '\\{\\{\\s*#[^{}]*\\}\\}', '(select 1)', 'g'), '\\{\\{[^{}]*\\}\\}', '''tag''', 'g') as sql from e_native""",
)
def _(e: Estate) -> DataFrame:
    return bi.substitute_tags(e.native, e.tags)


@suite(
    "c16_inline_snippets",
    """with s as (select card_id, sql, card_id % 4 as p from e_native) select card_id, replace(sql, '{{snippet: part ' || p || '}}',
    case p when 0 then 'p0 = 1 and p1 = 1 and p2 = 1 and ' when 1 then 'p1 = 1 and p2 = 1 and p3 = 1 and ' when 2 then 'p2 = 1 and p3 = 1 and ' else 'p3 = 1 and ' end) as sql, 1::bigint as missing from s""",
)
def _(e: Estate) -> DataFrame:
    return bi.inline_snippets(e.native, e.snippets)


@suite("c17_dimension_tag_fields", "select card_id, tag, t.field_id, f.field_id is not null as known from e_tags t left join e_fields f on f.field_id = t.field_id where kind = 'dimension'")
def _(e: Estate) -> DataFrame:
    return bi.dimension_tag_fields(e.tags, e.fields)


@suite("c18_native_card_refs", "select distinct card_id, u as upstream from (select card_id, unnest(regexp_extract_all(sql, '\\{\\{\\s*#\\s*(\\d+)', 1))::bigint as u from e_native union all select card_id, ref_card from e_tags where kind = 'card')")
def _(e: Estate) -> DataFrame:
    return bi.native_card_refs(e.native, e.tags)


@suite(
    "c19_native_tables",
    """with f as (select distinct card_id, unnest(regexp_extract_all(lower(sql), '\\b(?:from|join)\\s+([a-z_][\\w."]*)', 1)) as n from e_native), n as (select lower(table_name) as n, min(table_id) as id from e_tables group by 1 having count(*) = 1 union all select lower(schema_name || '.' || table_name), table_id from e_tables)
    select distinct f.card_id, n.id as table_id from f join n on n.n = f.n""",
)
def _(e: Estate) -> DataFrame:
    return bi.native_tables(e.native, e.tables)


_PARSED = "select card_id, case when card_id % 3 <> 0 then f.table_name end as table_name, case when card_id % 7 = 0 then 'none' else f.column_name end as column_name, case when card_id % 2 = 0 then 'exact' else 'parsed' end as confidence from e_native n join e_fields f on f.field_id % 300 = n.card_id % 300"


@suite(
    "c20_native_column_refs",
    f"""with p as ({_PARSED}), o as (select card_id, min(lower(table_name)) as t from p where table_name is not null group by 1 having count(distinct lower(table_name)) = 1),
    k as (select lower(table_name) as t, lower(column_name) as c, min(field_id) as field_id from e_fields group by 1, 2),
    r as (select p.card_id, lower(p.column_name) as column_name, k.field_id, min(confidence) as confidence from p left join o on o.card_id = p.card_id left join k on k.t = coalesce(lower(p.table_name), o.t) and k.c = lower(p.column_name) group by 1, 2, 3)
    select card_id, column_name, field_id, case when field_id is not null then confidence end as confidence from r""",
)
def _(e: Estate) -> DataFrame:
    return bi.native_column_refs(e.sql(_PARSED), e.fields)


_DEPS = "select card_id, upstream, ord from e_deps"
_NATIVE = "select card_id from e_cards where query_type = 'native'"
_CLOSED = f"deps as ({_DEPS}), ps as (select card_id from ({_NATIVE}) union select d.card_id from ps join deps d on d.upstream = ps.card_id), inh as (select d.card_id, u.field_id from deps d join e_consumed u on u.card_id = d.upstream union select d.card_id, i.field_id from inh i join deps d on d.upstream = i.card_id)"


@suite("c21_parsed_sources", f"with recursive {_CLOSED} select card_id from ps")
def _(e: Estate) -> DataFrame:
    return bi.parsed_sources(e.sql(_DEPS), e.sql(_NATIVE))


@suite("c22_transitive_fields", f"with recursive {_CLOSED} select * from inh")
def _(e: Estate) -> DataFrame:
    return bi.transitive_fields(e.sql(_DEPS), e.consumed)


_DIRECT = "select distinct u.card_id, u.field_id, case when k.query_type = 'native' then 'parsed' else 'exact' end as confidence from e_consumed u join e_cards k on k.card_id = u.card_id"


@suite(
    "c23_consumed_by_edges",
    f"""with recursive {_CLOSED}, dr as ({_DIRECT}), rc as (select card_id, field_id from inh union select card_id, field_id from dr),
    th as (select d.card_id, r.field_id, arg_min(d.upstream, (d.ord, d.upstream)) as via from deps d join rc r on r.card_id = d.upstream where d.card_id <> d.upstream and not exists (select 1 from dr where dr.card_id = d.card_id and dr.field_id = r.field_id) group by d.card_id, r.field_id)
    select 'mb_field::' || field_id as f, 'mb_card::' || card_id as t, confidence, null::bigint as via from dr union all
    select 'mb_field::' || field_id, 'mb_card::' || card_id, case when via in (select card_id from ps) then 'parsed' else 'exact' end, via from th""",
)
def _(e: Estate) -> DataFrame:
    return bi.consumed_by_edges(e.sql(_DIRECT), e.sql(_DEPS), bi.parsed_sources(e.sql(_DEPS), e.sql(_NATIVE)))


_KNOWN = "select card_id from e_cards where not archived"
_WALKED = "select card_id from e_cardq where not (dataset_query = '{}')"


@suite(
    "c25_upstream_problems",
    f"""select distinct card_id, 'card__' || upstream as ref, case when upstream in ({_KNOWN}) then 'card without a query to walk' else 'card missing or out of scope' end as reason
    from e_deps where upstream not in ({_WALKED})""",
)
def _(e: Estate) -> DataFrame:
    return bi.upstream_problems(e.sql(_DEPS), e.sql(_KNOWN), e.sql(_WALKED))


_USERS = "select 'user' || n_nationkey as creator, case when n_nationkey % 3 = 0 then n_name end as common_name, case when n_nationkey % 2 = 0 then 'u' || n_nationkey || '@x.org' end as email from nation"


@suite("c24_card_nodes", f"with {_PATHS} select k.node_id, k.name, coalesce(u.common_name, u.email, k.creator) as creator, p.path as collection_path, query_type, archived from e_cards k left join ({_USERS}) u on u.creator = k.creator left join paths p on p.collection_id = k.collection_id")
def _(e: Estate) -> DataFrame:
    return bi.card_nodes(e.cards, e.sql(_USERS), bi.collection_paths(e.collections))


@suite("c25_card_resolution", f"with {_BYID} select query_type, count(*) as total, count(*) filter (card_id not in (select card_id from bid where status = 'unknown')) as resolved from e_cards group by query_type")
def _(e: Estate) -> DataFrame:
    return bi.card_resolution(e.cards, bi.resolve_refs_by_id(_refs(e), e.fields).where("status = 'unknown'"))


_DASH = "select dash_id, case when card_id % 10 = 9 then null else card_id end as card_id, dashcard_id from e_dashcards union all select dash_id, card_id, dashcard_id + 1000000 from e_dashcards"


@suite("c26_appears_on_edges", f"select 'mb_card::' || card_id as f, dash_id as t, min(dashcard_id) as dashcard_id from ({_DASH}) where card_id in (select card_id from e_cards where not archived) group by 1, 2")
def _(e: Estate) -> DataFrame:
    return bi.appears_on_edges(e.sql(_DASH), e.cards.where("not archived"))


@suite("c27_dashboard_resolution", "select dash_id, bool_and(card_id % 4999 <> 5 or card_id is null) as resolved from e_dashcards group by dash_id")
def _(e: Estate) -> DataFrame:
    return bi.dashboard_resolution(e.dashcards, e.cards.where("card_id % 4999 <> 5"))
