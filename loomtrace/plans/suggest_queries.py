"""Queries of suggestion, search and discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators import suggest, walk
from loomtrace.plans.estate import Estate
from loomtrace.plans.graph_queries import _BELOW
from loomtrace.plans.suite import Suite

suite = Suite()

_AT = "at1 as (select f.field_id, m.name as model, c.name as col from e_binds b join e_fields f on f.node_id = b.t join e_columns c on c.node_id = b.f join e_models m on m.node_id = c.owner_id and m.materialization <> 'semantic_view')"
_IMPLICIT = f"""{_AT}, ij as (select a.model as from_model, a.col as from_column, b.model as to_model, b.col as to_column, count(distinct u.card_id)::double as score, 'implicit_join' as source
      from e_consumed u join e_fields f on f.field_id = u.field_id join at1 a on a.field_id = f.field_id join at1 b on b.field_id = f.fk_target_field_id where u.implicit_join and a.model <> b.model group by 1, 2, 3, 4)"""
_SING = "case when {0} like '%ies' and length({0}) > 3 then left({0}, -3) || 'y' when regexp_matches({0}, '(ses|xes|zes|ches|shes)$') then left({0}, -2) when {0} like '%s' and {0} not like '%ss' then left({0}, -1) else {0} end"
_GRAINS = f"""gm as (select name, lower(name) as n, coalesce(nullif(regexp_replace(lower(name), '^(viz_|stg_|int_|fct_|dim_|mart_|bdg_|base_|agg_|rpt_)+', ''), ''), lower(name)) as s from e_models where materialization <> 'semantic_view'),
    gr as (select distinct name as model, {_SING.format('n')} as grain from gm union select name, {_SING.format('s')} from gm)"""
_NAMING = f"""{_GRAINS}, mc as (select m.name as model, c.name as name from e_columns c join e_models m on m.node_id = c.owner_id and m.materialization <> 'semantic_view'),
    np as (select a.model as from_model, a.name as from_column, g.model as to_model, coalesce((select min(x.name) from mc x where x.model = g.model and lower(x.name) = lower(a.name)), (select min(x.name) from mc x where x.model = g.model and lower(x.name) = 'id')) as to_column, 0.5::double as score, 'naming' as source
      from mc a join gr g on g.grain = left(lower(a.name), -3) and lower(a.name) like '%\\_id' escape '\\' where a.model <> g.model and not exists (select 1 from gr o where o.model = a.model and o.grain = g.grain))"""
_DECLARED = "select m.name as from_model, c.name as from_column, tm.name as to_model, t.name as to_column from e_relates r join e_columns c on c.node_id = r.f join e_columns t on t.node_id = r.t join e_models m on m.node_id = c.owner_id join e_models tm on tm.node_id = t.owner_id"
_ALL = f"""{_IMPLICIT}, {_NAMING}, pr as (select * from ij union all select * from np where to_column is not null), pi as (select *, left(sha256(lower(from_model || '.' || from_column || '->' || to_model || '.' || to_column)), 12) as id from pr),
    de as ({_DECLARED}), xp as (select * from pi p where not exists (select 1 from de d where (lower(d.from_model || '.' || d.from_column), lower(d.to_model || '.' || d.to_column)) in ((lower(p.from_model || '.' || p.from_column), lower(p.to_model || '.' || p.to_column)), (lower(p.to_model || '.' || p.to_column), lower(p.from_model || '.' || p.from_column)))) and id not like 'a%'),
    bs as (select * from xp qualify row_number() over (partition by id order by score desc, source) = 1), sg as (select *, row_number() over (order by score desc, lower(from_model), lower(from_column), lower(to_model), lower(to_column), id) as place from bs)"""


def _models(e: Estate) -> DataFrame:
    return suggest.eligible_models(e.models)


def _implicit(e: Estate) -> DataFrame:
    binds = e.sql("select b.f as col_id, f.field_id from e_binds b join e_fields f on f.node_id = b.t")
    return suggest.implicit_join_pairs(e.consumed, e.fields, binds, e.columns, _models(e))


def _naming(e: Estate) -> DataFrame:
    return suggest.naming_pairs(_models(e), e.columns)


def _kept(e: Estate) -> DataFrame:
    pairs = _implicit(e).unionByName(_naming(e))
    ids = suggest.exclude_pairs(pairs, e.sql(_DECLARED), e.spark.createDataFrame([], "id string")).select("id").where("id like 'a%'")
    return suggest.exclude_pairs(pairs, e.sql(_DECLARED), ids)


@suite("j1_implicit_join_pairs", f"with {_IMPLICIT} select * from ij")
def _(e: Estate) -> DataFrame:
    return _implicit(e)


@suite("j2_grains", f"with {_GRAINS} select * from gr")
def _(e: Estate) -> DataFrame:
    return suggest.grains(_models(e))


@suite("j3_naming_pairs", f"with {_NAMING} select * from np where to_column is not null")
def _(e: Estate) -> DataFrame:
    return _naming(e)


@suite("j4_eligible_models", "select node_id, name from e_models where materialization <> 'semantic_view'")
def _(e: Estate) -> DataFrame:
    return _models(e).select("node_id", "name")


@suite("j5_exclude_pairs", f"with {_ALL} select * from xp")
def _(e: Estate) -> DataFrame:
    return _kept(e)


@suite("j6_suggest", f"with {_ALL} select * from sg")
def _(e: Estate) -> DataFrame:
    return suggest.suggest(_kept(e))


@suite("j7_suggestions_by_source", f"with {_ALL} select source, count(*) as n from sg group by source")
def _(e: Estate) -> DataFrame:
    return suggest.suggestions_by_source(suggest.suggest(_kept(e)))


_SCOPE = "select name as model from e_models where schema_name in ('S1', 'S2', 'S3')"


@suite("j7_suggestions_in_scope", f"with {_ALL} select id, from_model, to_model, place from sg where from_model in ({_SCOPE}) and to_model in ({_SCOPE})")
def _(e: Estate) -> DataFrame:
    return suggest.suggestions_in_scope(suggest.suggest(_kept(e)), e.sql(_SCOPE)).select("id", "from_model", "to_model", "place")


_Q = "select 'c_1' as query union all select ' Key of ' union all select 'stg' union all select 'E3s' union all select 'board 19961' union all select '4-not' union all select 'c_77_' union all select ''"
_FZ = "case when greatest(length({0}), length({1})) = 0 then 1.0::double else 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1})) end"
_HITS = f"""q as (select distinct query, lower(trim(query)) as q from ({_Q}) where trim(query) <> ''), n as (select node_id, node_type, name, lower(name) as low, lower(split_part(split_part(node_id, '::', -1), '.', -1)) as tail, lower(description) as txt from e_nodes),
    h as (select *, {_FZ.format('q', 'low')} as ratio, case when low = q then 5 when starts_with(low, q) then 4 when contains(low, q) and len(list_filter(range(1, length(low) + 1), lambda i: substr(low, i::bigint, length(q)) = q and (i = 1 or not regexp_matches(substr(low, i::bigint - 1, 1), '[\\p{{L}}\\p{{N}}]')))) > 0 then 3 when contains(low, q) or contains(tail, q) or coalesce(contains(txt, q), false) then 2 when {_FZ.format('q', 'low')} >= 0.6 then 1 end as tier from n, q),
    s as (select *, case when tier <> 2 or contains(low, q) then 'name' when contains(tail, q) then 'node_id' else 'description' end as field, case when tier > 1 then tier::double else round(ratio, 3) end as score from h where tier is not null),
    hits as (select query, node_id, node_type, name, tier, field, score, cast(row_number() over (partition by query order by tier desc, score desc, low, node_id) as int) as place from s qualify place <= 20)"""


def _hits(e: Estate) -> DataFrame:
    tags = e.sql("select uid as node_id, tag from e_entities")
    return suggest.search(suggest.searchable(e.nodes, e.collections, tags), e.sql(_Q))


@suite("k1_search", f"with {_HITS} select * from hits")
def _(e: Estate) -> DataFrame:
    return _hits(e)


@suite("k2_fuzzy_score", f"select a.name as a, b.name as b, {_FZ.format('a.name', 'b.name')} as ratio from e_models a join e_models b on a.k < b.k")
def _(e: Estate) -> DataFrame:
    return e.sql("select a.name as a, b.name as b from e_models a join e_models b on a.k < b.k").withColumn("ratio", suggest.fuzzy_score(F.col("a"), F.col("b")))


@suite(
    "k3_node_context",
    """select n.node_id, case when n.node_type = 'column' then coalesce(o.name, split_part(n.owner_id, '.', -1)) when n.node_type in ('mb_card', 'mb_dashboard') then c.name else concat_ws('.', n.schema_name, n.table_name) end as context
    from e_nodes n left join e_nodes o on o.node_id = n.owner_id left join e_collections c on c.collection_id = n.collection_id""",
)
def _(e: Estate) -> DataFrame:
    return suggest.node_context(e.nodes, e.collections)


@suite("k4_group_hits", f"with {_HITS} select query, node_type, count(*) as n, string_agg(node_id, ', ' order by place) as ids from hits group by query, node_type")
def _(e: Estate) -> DataFrame:
    return suggest.group_hits(_hits(e))


@suite("k5_search_with_consequence", f"with recursive {_HITS}, {_BELOW} select h.*, c.cards, c.dashboards from hits h left join counted c on c.node_id = h.node_id")
def _(e: Estate) -> DataFrame:
    return suggest.search_with_consequence(_hits(e), walk.consequence_counts(e.nodes, e.edges))


@suite("o1_model_inventory", "select db, schema_name, count(*) as relations from e_entities where not is_ephemeral group by db, schema_name")
def _(e: Estate) -> DataFrame:
    return suggest.model_inventory(e.entities)


@suite("o2_mart_schemas", "select distinct schema_name, 'prefix' as evidence from e_models where name like 'fct\\_%' escape '\\' or name like 'dim\\_%' escape '\\'")
def _(e: Estate) -> DataFrame:
    return suggest.mart_schemas(e.models.withColumnRenamed("node_id", "uid"), e.sql("select f as upstream from e_references"))


@suite("o2_mart_schemas_leaves", "select distinct schema_name, 'leaves' as evidence from e_models where name not like 'fct%' and name not like 'dim%' and node_id not in (select f from e_references)")
def _(e: Estate) -> DataFrame:
    models = e.models.where("name not like 'fct%' and name not like 'dim%'").withColumnRenamed("node_id", "uid")
    return suggest.mart_schemas(models, e.sql("select f as upstream from e_references"))


_DBS = "select n_name as dbt_db from nation"
_BI = "select lower(replace(n_name, '_', case when n_nationkey % 3 = 0 then '-' when n_nationkey % 3 = 1 then '_' else 'x' end)) as name, case when n_nationkey % 4 = 0 then n_name end as details_db, n_nationkey % 6 = 5 as is_sample from nation"


@suite(
    "o3_propose_database_mapping",
    f"""with r as (select dbt_db, name, round((case when lower(details_db) = lower(dbt_db) then 1.0::double when lower(name) = lower(dbt_db) then 0.95 when regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(dbt_db), '[^a-z0-9]', '', 'g') then 0.92 else ({_FZ.format('lower(dbt_db)', 'lower(name)')}) * 0.85 end)
      * case when is_sample then 0.1::double else 1.0 end, 6) as score from ({_DBS}), ({_BI})), w as (select *, row_number() over (partition by dbt_db order by score desc, name) as k, lead(score) over (partition by dbt_db order by score desc, name) as nx from r)
    select dbt_db, name as bi_db, score, score >= 0.9 and score - coalesce(nx, 0) >= 0.15 as confident from w where k = 1""",
)
def _(e: Estate) -> DataFrame:
    return suggest.propose_database_mapping(e.sql(_DBS), e.sql(_BI))


@suite("o4_propose_schemas", "select distinct case when schema_name in ('S1', 'S2') then lower(schema_name) else schema_name end as schema_name from e_models")
def _(e: Estate) -> DataFrame:
    return suggest.propose_schemas(e.models.select("schema_name").distinct(), e.sql("select distinct lower(schema_name) as schema_name from e_models where schema_name in ('S1', 'S2')"))


_SHORT = "select substr(name, 5) as table_name from e_models where k % 4 = 0 or k % 7 = 1"


@suite(
    "o5_derive_table_prefix",
    f"""with m as (select distinct lower(name) as t from e_models where k % 4 = 0 or k = 1), b as (select distinct lower(table_name) as b from ({_SHORT})), u as (select t from m where t not in (select b from b)),
    v as (select left(t, i::int) as prefix, count(distinct t) as hits from u, range(1, 40) r(i) where i < length(t) and substr(t, i::int + 1) in (select b from b) group by 1), z as (select prefix, hits from v order by hits desc, length(prefix), prefix limit 1)
    select coalesce((select prefix from z where hits >= 2 and 2 * hits >= (select count(*) from u) and 2 * (select count(*) from u) >= (select count(*) from m)), '') as prefix""",
)
def _(e: Estate) -> DataFrame:
    return suggest.derive_table_prefix(e.sql("select name as tbl from e_models where k % 4 = 0 or k = 1"), e.sql(_SHORT))
