"""Queries of the model, column and dashboard analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomtrace.operators import detail, walk
from loomtrace.plans.estate import Estate
from loomtrace.plans.graph_queries import _EVERY, _ROLL, _reach_sql
from loomtrace.plans.project_queries import _REASONS, _traces
from loomtrace.plans.suite import Suite

suite = Suite()

_UP = _reach_sql(_EVERY, "t", "f").replace("ed as", "ed2 as").replace("join ed ", "join ed2 ").replace("rr", "r2").replace("reached2 as", "above as").replace("from rr", "from r2")


@suite(
    "l1_column_detail",
    f"""with recursive {_reach_sql(_EVERY)}, {_UP},
    u as (select start, count(*) filter (n.node_type = 'column') as uc, count(*) filter (n.node_type = 'source') as us from above a join e_nodes n on n.node_id = a.node_id group by start),
    d as (select start, count(*) filter (n.node_type = 'column') as dc, count(distinct n.owner_id) filter (n.node_type = 'column') as dm, count(*) filter (n.node_type = 'mb_field') as fi, count(*) filter (n.node_type = 'mb_card') as ca, count(*) filter (n.node_type = 'mb_dashboard') as da from reached a join e_nodes n on n.node_id = a.node_id group by start)
    select s.node_id as start, coalesce(uc, 0) as up_columns, coalesce(us, 0) as up_sources, coalesce(dc, 0) as down_columns, coalesce(dm, 0) as down_models, coalesce(fi, 0) as fields, coalesce(ca, 0) as cards, coalesce(da, 0) as dashboards, (select count(*) from e_relates r where r.f = s.node_id or r.t = s.node_id) as relationships from ({_EVERY}) s left join u on u.start = s.node_id left join d on d.start = s.node_id""",
)
def _(e: Estate) -> DataFrame:
    return detail.column_detail(e.nodes, e.edges, e.sql(_EVERY))


#: All objects of the BI side.
_OBJECTS = "select node_id from e_nodes where node_type in ('mb_field', 'mb_card', 'mb_dashboard')"
_BI = f"""{_reach_sql(_OBJECTS, 't', 'f')}, s as (select start, count(*) filter (n.node_type = 'column') as columns, count(distinct n.owner_id) filter (n.node_type = 'column') as models,
      max({{rank}}) filter (n.node_type = 'column') as r, count(*) filter (n.node_type = 'mb_field') as fields, count(*) filter (n.node_type = 'mb_field' and n.node_id not in (select t from e_binds)) as unbound from reached a join e_nodes n on n.node_id = a.node_id group by start),
    bd as (select o.node_id as start, coalesce(columns, 0) as columns, coalesce(models, 0) as models, case r when 5 then 'exact' when 4 then 'validated' when 3 then 'parsed' when 2 then 'inferred' when 1 then 'fuzzy' end as best, coalesce(fields, 0) as fields, coalesce(unbound, 0) as unbound from ({_OBJECTS}) o left join s on s.start = o.node_id)""".replace(
    "{rank}", "case a.confidence when 'exact' then 5 when 'validated' then 4 when 'parsed' then 3 when 'inferred' then 2 else 1 end"
)


@suite("l2_bi_detail", f"with recursive {_BI} select * from bd")
def _(e: Estate) -> DataFrame:
    return detail.bi_detail(e.nodes, e.edges, e.sql(_OBJECTS))


@suite(
    "l3_chain_gap",
    f"""with recursive {_BI} select b.start, case when columns > 0 then null when n.node_type = 'mb_field' then 'field-unbound' when unbound > 0 then 'fields-unbound' when n.node_type = 'mb_dashboard' then 'dashboard-unresolved' when k.query_type = 'native' then 'native-unresolved' else 'query-unresolved' end as gap
    from bd b join e_nodes n on n.node_id = b.start left join e_cards k on k.node_id = b.start""",
)
def _(e: Estate) -> DataFrame:
    return detail.chain_gap(detail.bi_detail(e.nodes, e.edges, e.sql(_OBJECTS)), e.nodes, e.cards)


_MOD = "select node_id from e_models"
_OWN = f"select node_id from e_columns where owner_id in ({_MOD})"


@suite(
    "l4_model_detail",
    f"""with recursive up as (select m.node_id as start, r.f as n from ({_MOD}) m join e_references r on r.t = m.node_id union select u.start, r.f from up u join e_references r on r.t = u.n),
    dn as (select m.node_id as start, r.t as n from ({_MOD}) m join e_references r on r.f = m.node_id union select u.start, r.t from dn u join e_references r on r.f = u.n), {_reach_sql(_OWN)},
    b as (select c.owner_id as start, count(distinct r.node_id) filter (r.node_id like 'mb_card%') as cards, count(distinct r.node_id) filter (r.node_id like 'mb_dash%') as dashboards, min(depth) as nearest from reached r join e_columns c on c.node_id = r.start where r.node_id like 'mb_card%' or r.node_id like 'mb_dash%' group by 1)
    select m.node_id as start, (select count(*) from up where up.start = m.node_id) as upstream, (select count(*) from dn where dn.start = m.node_id) as downstream, coalesce(cards, 0) as cards, coalesce(dashboards, 0) as dashboards, nearest from ({_MOD}) m left join b on b.start = m.node_id""",
)
def _(e: Estate) -> DataFrame:
    return detail.model_detail(e.nodes, e.edges, e.sql(_MOD))


@suite("l5_relationships_touching", "select f as node_id, 'out' as direction, t as other, confidence = 'validated' as validated from e_relates union all select t, 'in', f, confidence = 'validated' from e_relates")
def _(e: Estate) -> DataFrame:
    return detail.relationships_touching(e.relates, e.columns)


_ROOTS = "select node_id from e_sources"


@suite(
    "l6_layer_groups",
    f"""with recursive {_reach_sql(_ROOTS)}, g as (select start, case when n.node_type = 'source' then 'sources' else n.schema_name end as layer, count(*) as n, min(depth) as near, max(depth) as far from reached r join e_nodes n on n.node_id = r.node_id where n.node_type in ('model', 'source') group by 1, 2)
    select *, case when near = far then near::varchar else near || '-' || far end as hops from g""",
)
def _(e: Estate) -> DataFrame:
    return detail.layer_groups(walk.reach(e.edges, e.sql(_ROOTS)), e.nodes)


@suite("l7_dashboard_groups", "with g as (select dash_id, count(*) as n from e_cards k left join (select distinct card_id, dash_id from e_dashcards) d on d.card_id = k.card_id group by dash_id) select *, row_number() over (order by dash_id is null, n desc, dash_id) as place from g")
def _(e: Estate) -> DataFrame:
    return detail.dashboard_groups(e.cards, e.dashcards)


_TAGGED = "select node_id, schema_name, package, case when k % 4 <> 3 then 'tier' || (k % 3) when k = 3 then 'staging' end as tag from e_models"
_STAGED = "select a.node_id as f, b.node_id as t, a.owner_id as a, b.owner_id as b from e_columns a join e_columns b on a.name = b.name and a.k is null and a.owner_id < b.owner_id and a.owner_id like 'model%'"
_PAIRS = "mp as (select r.f, r.t, a.owner_id as a, b.owner_id as b, r.confidence = 'validated' as validated from e_relates r join e_columns a on a.node_id = r.f join e_columns b on b.node_id = r.t)"
_SCOPES = f"""{_PAIRS}, sm as (select 'schema' as kind, schema_name as scope, node_id from ({_TAGGED}) union all select 'tag', tag, node_id from ({_TAGGED}) where tag is not null),
    sr as (select kind, scope, count(distinct (f, t)) as n from (select distinct s.kind, s.scope, f, t from mp join sm s on s.node_id = mp.a or s.node_id = mp.b) group by 1, 2),
    sco as (select s.kind, s.scope, count(distinct node_id) as tables, coalesce(max(sr.n), 0) as relationships, regexp_matches(s.scope, '(?i)stag|int|tmp|raw|scratch') as internal from sm s left join sr on sr.kind = s.kind and sr.scope = s.scope group by 1, 2)"""


def _pairs(e: Estate) -> DataFrame:
    return detail.model_pairs(e.relates, e.columns)


@suite("l8_erd_scopes", f"with {_SCOPES} select * from sco")
def _(e: Estate) -> DataFrame:
    return detail.erd_scopes(e.sql(_TAGGED), _pairs(e))


@suite("l9_root_package", "select package, count(*) as n from e_models group by package order by n desc, package limit 1")
def _(e: Estate) -> DataFrame:
    return detail.root_package(e.models)


@suite("l10_default_scope", f"with {_SCOPES}, t as (select *, case when scope = 'gone' then 0 when kind = 'schema' and not internal then 1 when kind = 'schema' then 2 else 3 end as tier from sco) select kind, scope, tier from t order by tier, tables desc, scope limit 1")
def _(e: Estate) -> DataFrame:
    return detail.default_scope(detail.erd_scopes(e.sql(_TAGGED), _pairs(e)), "gone")


_IN = "select node_id from e_models where schema_name in ('S0', 'S1', 'S2')"
_SUG = "select a.node_id as from_id, b.node_id as to_id, a.k * 100 + b.k as place from e_models a join e_models b on a.k < b.k"
_ERD = f"""{_PAIRS}, ins as ({_IN}), tch as (select * from mp where a in (select node_id from ins) or b in (select node_id from ins)), wi as (select *, row_number() over (order by place) as k from ({_SUG}) where from_id in (select node_id from ins) and to_id in (select node_id from ins)),
    erd as (select 'table' as part, node_id as a, '' as b, 1::bigint as n from ins union all select 'external', x, '', 1 from (select a as x from tch union select b from tch) where x not in (select node_id from ins)
      union all select 'relationship', a, b, count(*) from tch group by a, b union all select 'suggestion', from_id, to_id, k from wi where k <= 30 union all select 'hidden', '', '', count(*) from wi where k > 30)"""


def _erd(e: Estate) -> DataFrame:
    return detail.erd_for_scope(e.sql(_IN), _pairs(e), e.sql(_SUG))


@suite("l11_erd_for_scope", f"with {_ERD} select * from erd")
def _(e: Estate) -> DataFrame:
    return _erd(e)


@suite(
    "l12_focus_erd",
    f"with {_PAIRS}, nb as (select m.node_id as focus, m.node_id as x from e_models m union select m.node_id, p.b from e_models m join mp p on p.a = m.node_id union select m.node_id, p.a from e_models m join mp p on p.b = m.node_id) select distinct n.focus, p.a, p.b from mp p join nb n on n.x = p.a join nb o on o.focus = n.focus and o.x = p.b",
)
def _(e: Estate) -> DataFrame:
    return detail.focus_erd(_pairs(e), e.models)


@suite(
    "l12_related_models",
    f"with {_PAIRS}, dr as (select a, b from mp union select a, b from ({_STAGED})) select node_id as focus, node_id as model from e_models union select a, b from dr where a in (select node_id from e_models) union select b, a from dr where b in (select node_id from e_models)",
)
def _(e: Estate) -> DataFrame:
    return detail.related_models(_pairs(e).select("a", "b").union(e.sql(_STAGED).select("a", "b")), e.models)


@suite("l13_erd_counts", f"with {_ERD} select part, count(*) as n from erd group by part")
def _(e: Estate) -> DataFrame:
    return detail.erd_counts(_erd(e))


_NAMES = "select k as id, upper(name) as from_model, case when k % 3 = 0 then 'r' || (k % 5) when k % 3 = 1 then 'nobody' else name end as to_model from e_models"
_OWNERS = "select node_id, node_type, name from e_nodes where node_type in ('model', 'source') union all select 'model.shop.r1', 'model', 'r1' from region where r_regionkey = 0"


@suite("l14_resolve_staged", f"with o as (select lower(name) as low, node_id as uid from ({_OWNERS}) qualify row_number() over (partition by lower(name) order by node_type = 'source', node_id) = 1) select n.id, a.uid as from_id, b.uid as to_id, a.uid is not null and b.uid is not null as resolved from ({_NAMES}) n left join o a on a.low = lower(from_model) left join o b on b.low = lower(to_model)")
def _(e: Estate) -> DataFrame:
    return detail.resolve_staged(e.sql(_NAMES), e.sql(_OWNERS))




@suite(
    "l15_model_star",
    f"""with {_PAIRS}, al as (select f, t, a, b, validated as v, true as d from mp where a <> b union all select f, t, a, b, false, false from ({_STAGED}) where a <> b),
    bo as (select a as model, b as neighbour, f as own, t as other, true as o, v, d from al union all select b, a, t, f, false, v, d from al),
    fi as (select * from bo qualify row_number() over (partition by model, neighbour, own, other order by d desc, o desc, v desc) = 1),
    s as (select model, neighbour, count(*) as joins, count(*) filter (o) as outgoing, count(*) filter (not o) as incoming, bool_or(v) as validated, bool_or(d) as declared from fi group by 1, 2),
    r as (select *, row_number() over (partition by model order by joins desc, neighbour) as k, count(*) over (partition by model) as n from s)
    select model, neighbour, joins, outgoing, incoming, validated, declared, greatest(n - 10, 0) as hidden from r where k <= 10""",
)
def _(e: Estate) -> DataFrame:
    return detail.model_star(_pairs(e), e.sql(_STAGED))


@suite(
    "l16_starting_points",
    f"""{_ROLL.replace('with en', 'with en', 1)}, a as (select 'model' as kind, f as node_id, count(distinct t) as n from rolled where f like 'model%' and t like 'mb_card%' group by f union all select 'dashboard', t, count(distinct f) from rolled where f like 'mb_card%' and t like 'mb_dash%' group by t)
    select *, cast(row_number() over (partition by kind order by n desc, node_id) as int) as place from a qualify place <= 6""",
)
def _(e: Estate) -> DataFrame:
    return detail.starting_points(walk.roll_up(e.nodes, e.edges), e.nodes)


_COVER = "select 'columns traced' as kind, count(distinct t) as value, (select count(*) from e_columns) as total from e_feeds union all select 'fields bound', count(distinct t), (select count(*) from e_fields) from e_binds union all select 'cards on dashboards', count(distinct card_id), (select count(*) from e_cards) from e_dashcards"


@suite("l17_coverage_rows", f"select kind, value, total, total - value as gap, round(100.0::double * value / total, 1) as percent, case when total = 0 then 'nothing to cover' when value = total then 'complete' else (total - value) || ' left' end as note from ({_COVER})")
def _(e: Estate) -> DataFrame:
    return detail.coverage_rows(e.sql(_COVER))


_LEFT = "select node_id from e_columns where node_id not in (select t from e_feeds) union all select 'model.gone::' || k from e_models"


@suite("l18_coverage_list", f"select l.node_id, coalesce(n.name, l.node_id) as name, n.node_id is not null as known from ({_LEFT}) l left join e_nodes n on n.node_id = l.node_id")
def _(e: Estate) -> DataFrame:
    return detail.coverage_list(e.sql(_LEFT), e.nodes)


@suite("l19_untraced_groups_by_reason", f"with {_REASONS}, g as (select coalesce(reason, 'unknown') as reason, count(*) as n, string_agg(distinct output, ', ' order by output) as columns from rs group by 1) select *, row_number() over (order by n desc, reason) as place from g")
def _(e: Estate) -> DataFrame:
    return detail.untraced_groups(_traces(e), "reason")


@suite("l19_untraced_groups_by_model", f"with {_REASONS}, g as (select model, count(*) as n, string_agg(distinct output, ', ' order by output) as columns from rs where reason is not null group by 1) select *, row_number() over (order by n desc, model) as place from g")
def _(e: Estate) -> DataFrame:
    return detail.untraced_groups(_traces(e).where("reason is not null"), "model")


@suite("l20_manager_of", "select node_id, case when node_type like 'mb\\_%' escape '\\' then 'metabase' when node_type = 'source' or (node_type = 'column' and owner_id like 'source.%') then 'snowflake' else 'dbt' end as manager from e_nodes")
def _(e: Estate) -> DataFrame:
    return detail.manager_of(e.nodes)


@suite("l21_display_names", "select node_id, case when node_type not in ('model', 'source') then name when name like 'stg\\_%' escape '\\' or name like 'int\\_%' escape '\\' then substr(name, 5) when name like 'r_%' and node_type = 'source' then substr(name, 2) else name end as display from e_nodes")
def _(e: Estate) -> DataFrame:
    return detail.display_names(e.nodes, ["STG_", "int_", "r"])
