"""Queries of the project side, of binding and of types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators import bind, dbt
from loomtrace.plans.estate import Estate
from loomtrace.plans.suite import Suite

suite = Suite()

_MODELS = "select * from e_entities where kind = 'model'"
_DEPS = "select t as model, f as upstream from e_references union all select t, f from e_references where f like 'source%' union all select node_id, 'seed.shop.s' || k from e_models where k % 4 = 1"


@suite(
    "b1_entity_nodes",
    """select uid as node_id, kind as node_type, name, db, schema_name, tbl as table_name, case when kind = 'model' then materialization end as materialization, path, package,
    case when kind = 'model' then is_ephemeral end as is_ephemeral, case when kind = 'model' then tag end as tag from e_entities""",
)
def _(e: Estate) -> DataFrame:
    return dbt.entity_nodes(e.entities)


_SPECS = """d as (select uid, lower(col) as k, description from e_docs),
    specs as (select c.uid, lower(c.col) as col, c.col as warehouse_name, c.dtype, d.description, true as in_catalog from e_catalog c join e_entities e on e.uid = c.uid left join d on d.uid = c.uid and d.k = lower(c.col)
      union all select d.uid, d.k, cast(null as varchar), cast(null as varchar), d.description, false from d join e_entities e on e.uid = d.uid where not exists (select 1 from e_catalog c where c.uid = d.uid))"""


@suite("b2_catalog_specs", f"with {_SPECS} select * from specs")
def _(e: Estate) -> DataFrame:
    return dbt.catalog_specs(e.entities, e.catalog, e.docs)


#: Projections with some outputs that have no usable name.
_PJ = "select model, case when ordinal % 800 = 7 then '_col_' || (ordinal % 3) when ordinal % 900 = 11 then 'a b' else output end as output, ordinal, kind, is_star, failed, leaf_schema, leaf_table, leaf_column from e_pj"
_USABLE = f"pj as ({_PJ}), us as (select m.uid as model, coalesce(bool_and(regexp_full_match(output, '[A-Za-z_][A-Za-z0-9_$]*') and not regexp_full_match(output, '_col_[0-9]+')), false) as usable from ({_MODELS}) m left join pj on pj.model = m.uid group by m.uid)"


@suite(
    "b3_model_columns",
    f"""with {_SPECS}, {_USABLE},
    u as (select pj.model, lower(output) as col, output as s, cast(null as varchar) as dn, 0 as tier, ordinal from pj join us on us.model = pj.model and usable union all select uid, lower(d.col), cast(null as varchar), d.col, 1, d.ordinal from e_docs d join us on us.model = d.uid and usable),
    f as (select * from u qualify row_number() over (partition by model, col order by tier, ordinal, s nulls first, dn nulls first) = 1),
    n as (select f.model, f.col, coalesce(s, dn) as name, c.dtype, tier, f.ordinal from f left join e_catalog c on c.uid = f.model and lower(c.col) = f.col
      union all select s.uid, s.col, case when s.warehouse_name = upper(s.warehouse_name) then lower(s.warehouse_name) else coalesce(s.warehouse_name, s.col) end, s.dtype, 2, 0 from specs s join us on us.model = s.uid and not usable)
    select model, col, name, dtype, row_number() over (partition by model order by tier, ordinal, col) as place from n""",
)
def _(e: Estate) -> DataFrame:
    return dbt.model_columns(e.sql(_PJ), e.docs, e.catalog, e.sql(_MODELS))


@suite("b4_usable_projection", f"with {_USABLE} select * from us")
def _(e: Estate) -> DataFrame:
    return dbt.usable_projection(e.sql(_PJ), e.sql(_MODELS))


_SPELT = "select owner_id as uid, name as col, case when k % 3 = 0 then name end as sql_name, case when k % 4 = 0 then 'Doc_' || k end as doc_name, case when k % 2 = 0 then upper(name) else 'Mixed_' || coalesce(k, 0) end as warehouse_name from e_columns"


@suite(
    "b5_column_spelling",
    f"""with s as (select *, coalesce(sql_name, doc_name, case when upper(warehouse_name) = warehouse_name then lower(warehouse_name) else warehouse_name end) as shown from ({_SPELT}))
    select uid, col, shown as name, case when warehouse_name <> shown then warehouse_name end as warehouse_name from s""",
)
def _(e: Estate) -> DataFrame:
    return dbt.column_spelling(e.sql(_SPELT))


_REL = "rel as (select lower(db) as db, lower(schema_name) as schema_name, lower(tbl) as tbl, arg_max(uid, ordinal) as uid from e_entities where not is_ephemeral group by all)"
_LEAVES = f"{_REL}, lv as (select p.*, r.uid as leaf_owner from e_pj p left join rel r on r.schema_name = lower(p.leaf_schema) and r.tbl = lower(p.leaf_table))"
_FALL = f"fb as (select distinct s.uid || '::' || s.col as f, p.model || '::' || s.col as t, 'feeds' as edge_type, 'inferred' as confidence from (select distinct model, lower(output) as col from e_pj where failed and is_star) p join (select distinct model, upstream from ({_DEPS})) d on d.model = p.model join specs s on s.uid = d.upstream and s.col = p.col)"
_REASONS = f"""{_SPECS}, {_LEAVES}, {_FALL}, fo as (select model, coalesce(bool_or(leaf_schema is not null and leaf_owner is null), false) as is_foreign, bool_or(is_star) as any_star from lv group by model),
    fl as (select model, output, bool_or(failed) as failed, bool_or(is_explicit) as named, bool_or(is_star) as star, bool_or(leaf_owner is not null and leaf_column <> '*') as found, bool_or(leaf_schema is not null and leaf_owner is null) as outside, bool_or(leaf_column = '*') as ph from lv group by model, output),
    rs as (select fl.model, output, case when coalesce(found, false) or exists (select 1 from fb where fb.t = fl.model || '::' || lower(output)) then null when failed and named then 'lineage_failed' when failed and not fo.any_star then 'column_not_in_sql' when failed or star then 'star_not_expandable'
      when outside then 'upstream_not_in_project' when ph then case when is_foreign then 'upstream_not_in_project' else 'upstream_not_in_schema_map' end else 'no_upstream_columns' end as reason from fl join fo on fo.model = fl.model)"""


def _relations(e: Estate) -> DataFrame:
    return dbt.relation_map(e.entities)


def _specs(e: Estate) -> DataFrame:
    return dbt.catalog_specs(e.entities, e.catalog, e.docs)


def _fallback(e: Estate) -> DataFrame:
    return dbt.star_fallback_edges(e.pj, e.sql(_DEPS), _specs(e))


def _traces(e: Estate) -> DataFrame:
    return dbt.trace_reasons(e.pj, _relations(e), _fallback(e))


@suite(
    "b6_column_nodes",
    f"""with {_REASONS} select s.uid || '::' || s.col as node_id, s.col as name, s.dtype as data_type, case when s.dtype is null then case when s.uid in (select uid from e_catalog) then 'column_not_in_catalog' else 'relation_not_in_catalog' end end as unknown_type_reason,
    case when e.kind = 'model' then case when r.reason is null then 'traced' else 'untraced' end end as trace_status, case when e.kind = 'model' then r.reason end as trace_reason
    from specs s join e_entities e on e.uid = s.uid left join (select distinct model, lower(output) as col, reason from rs) r on r.model = s.uid and r.col = s.col""",
)
def _(e: Estate) -> DataFrame:
    return dbt.column_nodes(_specs(e), e.entities, e.catalog, _traces(e))


@suite("b7_references_edges", f"select distinct upstream as f, model as t, 'references' as edge_type, 'exact' as confidence from ({_DEPS}) where upstream in (select uid from e_entities)")
def _(e: Estate) -> DataFrame:
    return dbt.references_edges(e.sql(_DEPS), e.entities)[0]


@suite("b7_other_dependencies", f"select count(*) as other from ({_DEPS}) where upstream not in (select uid from e_entities)")
def _(e: Estate) -> DataFrame:
    return dbt.references_edges(e.sql(_DEPS), e.entities)[1]


@suite("b8_relation_map", f"with {_REL} select * from rel")
def _(e: Estate) -> DataFrame:
    return _relations(e)


@suite(
    "b9_schema_inventory",
    """with a as (select distinct lower(schema_name) as schema_name, lower(tbl) as tbl, lower(col) as col, true as from_catalog from e_entities join e_catalog using (uid))
    select * from a union all select distinct lower(schema_name), lower(tbl), lower(col), false from e_entities e join e_docs d on d.uid = e.uid where not exists (select 1 from a where a.schema_name = lower(e.schema_name) and a.tbl = lower(e.tbl))""",
)
def _(e: Estate) -> DataFrame:
    return dbt.schema_inventory(e.entities, e.catalog, e.docs)


@suite(
    "b10_feeds_edges",
    f"""with {_LEAVES}, g as (select leaf_owner || '::' || lower(leaf_column) as f, model || '::' || lower(output) as t, min(case when is_star and leaf_owner not in (select uid from e_catalog) then 2 when kind = 'column' then 5 else 3 end) as g
      from lv where leaf_owner is not null and leaf_column <> '*' group by 1, 2) select f, t, 'feeds' as edge_type, case g when 5 then 'exact' when 3 then 'parsed' else 'inferred' end as confidence from g""",
)
def _(e: Estate) -> DataFrame:
    return dbt.feeds_edges(e.pj, _relations(e), e.catalog)


#: Every dependency of a star query, for the fallback: its models read all that feed them.
@suite("b11_star_fallback_edges", f"with {_SPECS}, {_FALL.replace(_DEPS, 'select m.uid as model, n.uid as upstream from e_entities m join e_entities n on n.ordinal % 5 = m.ordinal % 5 and n.kind = m.kind').replace('failed and is_star', 'failed')} select * from fb")
def _(e: Estate) -> DataFrame:
    deps = e.sql("select m.uid as model, n.uid as upstream from e_entities m join e_entities n on n.ordinal % 5 = m.ordinal % 5 and n.kind = m.kind")
    return dbt.star_fallback_edges(e.pj.withColumn("is_star", F.lit(True)), deps, _specs(e))


@suite("b12_trace_reasons", f"with {_REASONS} select * from rs")
def _(e: Estate) -> DataFrame:
    return _traces(e)


@suite("b12_untraceable_models", f"with {_SPECS} select s.uid as model, s.col as output, case when trim(coalesce(e.compiled, '')) = '' then 'no_compiled_code' else 'unparseable_sql' end as reason from specs s join e_entities e on e.uid = s.uid where e.kind = 'model' and (trim(coalesce(e.compiled, '')) = '' or e.ordinal % 7 = 1)")
def _(e: Estate) -> DataFrame:
    return dbt.untraceable_models(e.sql(_MODELS).withColumn("parsed", F.col("ordinal") % 7 != 1), _specs(e))


@suite("b13_foreign_relations", f'with {_LEAVES} select model, coalesce(bool_or(leaf_schema is not null and leaf_owner is null), false) as "foreign" from lv group by model')
def _(e: Estate) -> DataFrame:
    return dbt.foreign_relations(e.pj, _relations(e))


_EXPR = "select distinct model, output, '  sum(a)\n  +  ' || repeat(output || ' ', cast(coalesce(ordinal, 1) % 60 as int)) as sql from e_pj where ordinal % 3 <> 1"


@suite(
    "b14_defined_as",
    f"""with u as (select model, output, count(distinct leaf_schema || '.' || lower(leaf_table) || '.' || leaf_column) as n, min(leaf_schema || '.' || lower(leaf_table) || '.' || leaf_column) as one, bool_or(is_star) as star, bool_and(kind = 'column') as plain from e_pj group by model, output),
    x as (select model, output, trim(regexp_replace(sql, '\\s+', ' ', 'g')) as s from ({_EXPR}))
    select u.model, u.output, case when star then 'star' when plain and n = 1 then 'passthrough' else 'expression' end as kind, case when n = 1 then one end as upstream, case when length(s) > 240 then rtrim(substr(s, 1, 239)) || '…' else s end as sql
    from u left join x on x.model = u.model and x.output = u.output""",
)
def _(e: Estate) -> DataFrame:
    return dbt.defined_as(e.pj, e.sql(_EXPR))


_PTR = "select node_id as id, case when k % 50 = 0 then 'gone' when node_id in (select t from e_feeds where confidence = 'exact') then (select min(f) from e_feeds x where x.t = node_id and x.confidence = 'exact') end as upstream from e_columns where k is not null"
_PTR = "select c.node_id as id, case when c.k % 50 = 49 then 'gone' else x.f end as upstream from e_columns c left join (select t, min(f) as f from e_feeds where confidence = 'exact' group by t) x on x.t = c.node_id where c.k is not null union all select 'loop' || k, 'loop' || ((k + 1) % 3) from e_sources where k < 3"


@suite(
    "b15_column_origin",
    f"""with recursive p as (select * from ({_PTR})), w as (select id, id as at_id, 0 as hops from p union all select w.id, p.upstream, w.hops + 1 from w join p on p.id = w.at_id where p.upstream is not null and w.hops < 100),
    z as (select w.id, at_id, hops from w join p on p.id = w.at_id where p.upstream is null) select p.id, z.at_id as origin, z.hops from p left join z on z.id = p.id""",
)
def _(e: Estate) -> DataFrame:
    return dbt.column_origin(e.sql(_PTR))


_CYCLIC = "select model, upstream from (select t as model, f as upstream from e_references where f like 'model%' union all select 'model.shop.x' || k, 'model.shop.x' || ((k + 1) % 3) from e_sources where k < 3)"
_ALL = "select uid from e_entities where kind = 'model' union all select 'model.shop.x' || k from e_sources where k < 3"


@suite(
    "b16_model_levels",
    f"""with recursive d as (select distinct * from ({_CYCLIC})), l as (select uid, 0 as level from ({_ALL}) where uid not like '%.x_' union select d.model, l.level + 1 from l join d on d.upstream = l.uid),
    m as (select a.uid, max(l.level) as level from ({_ALL}) a left join l on l.uid = a.uid group by a.uid) select uid, level, row_number() over (order by level nulls last, uid) as place from m""",
)
def _(e: Estate) -> DataFrame:
    return dbt.model_levels(e.sql(_ALL), e.sql(_CYCLIC))


@suite("b17_compiled_counts", f"select count(*) filter (trim(coalesce(compiled, '')) <> '') as with_sql, count(*) filter (trim(coalesce(compiled, '')) = '') as without_sql from ({_MODELS})")
def _(e: Estate) -> DataFrame:
    return dbt.compiled_counts(e.sql(_MODELS))


#: Targets by name, by schema and name, unknown, empty and ambiguous.
_REFS = "select model, col, target, field, ordinal, case when ordinal % 2 = 0 then 'one-to-one' end as cardinality from e_declared union all select uid, 'x', upper(schema_name) || '.' || name, null, ordinal, null from e_entities where kind = 'model' union all select uid, 'y', 'twin', null, ordinal, null from e_entities"
_TWINS = f"select * from ({_MODELS}) union all select 'model.pkg.twin' || k, 'model', 'twin', 'ANALYTICS', 'S' || k, 'twin', false, k, 'pkg', null, null, null, null from e_sources"


def _resolved(refs: str) -> str:
    return f"""mm as ({_TWINS}), nm as (select distinct uid, unnest([lower(name), lower(tbl), lower(schema_name || '.' || name), lower(schema_name || '.' || tbl)]) as key from mm), ky as (select key, count(distinct uid) as n, min(uid) as one from nm group by key),
    rv as (select r.*, case when ky.n = 1 then one end as to_model, case when trim(coalesce(r.target, '')) = '' then 'empty target' when ky.n is null then 'target model not found' when ky.n > 1 then 'ambiguous' end as error from ({refs}) r left join ky on ky.key = lower(trim(coalesce(r.target, ''))))"""


@suite("b18_resolve_targets", f"with {_resolved(_REFS)} select * from rv")
def _(e: Estate) -> DataFrame:
    return dbt.resolve_targets(e.sql(_REFS), e.sql(_TWINS))


@suite("b19_fk_from_column_meta", f"with {_resolved(_REFS)} select model, col, to_model, coalesce(field, col) as to_column, coalesce(cardinality, 'many-to-one') as cardinality, error from rv")
def _(e: Estate) -> DataFrame:
    return dbt.fk_from_column_meta(e.sql(_REFS), e.sql(_TWINS))


_CONS = """select model, col, case when ordinal % 3 = 0 then 'ref(' || chr(39) || target || chr(39) || ')' when ordinal % 3 = 1 then target end as `to`, case when ordinal % 7 = 3 then array() else array(field, 'other') end as to_columns,
    case when ordinal % 3 = 2 then case when ordinal % 5 = 0 then 'no columns' else target || ' (' || coalesce(field, col) || ', z)' end end as expression, ordinal from e_declared"""


@suite(
    "b20_fk_from_constraints",
    f"""with {_resolved("select model, col, case when ordinal % 3 = 0 and target <> '' then target when ordinal % 3 = 0 then 'ref(' || chr(39) || chr(39) || ')' when ordinal % 3 = 1 then target when ordinal % 5 = 0 or target = '' then '' else target end as target, case when ordinal % 3 < 2 then case when ordinal % 7 <> 3 then field end when ordinal % 5 = 0 then null else coalesce(field, col) end as to_column from e_declared")}
    select model, col, case when target is null or target = '' or to_column is null then null else to_model end as to_model, to_column, case when target is null or target = '' or to_column is null then 'unreadable constraint' else error end as error from rv""",
)
def _(e: Estate) -> DataFrame:
    return dbt.fk_from_constraints(e.sql(_CONS), e.sql(_TWINS))


_COMP = "select model, target, case when ordinal % 5 = 4 then array() when ordinal % 5 = 3 then array(col || ':a', 'bad') else array(col || ':' || coalesce(field, 'id'), 'u:v') end as columns from e_declared"


@suite(
    "b21_composite_relationships",
    f"""with {_resolved("select model, target, case when ordinal % 5 = 4 then null when ordinal % 5 = 3 then [col || ':a', 'bad'] else [col || ':' || coalesce(field, 'id'), 'u:v'] end as cols from e_declared")},
    x as (select model, to_model, error, i as place, cols[i + 1] as pair from rv, range(2) r(i) where cols is not null union all select model, to_model, error, null, null from rv where cols is null),
    y as (select *, case when pair is null then 'no columns' when not contains(pair, ':') then 'malformed pair' else error end as bad from x)
    select model, case when bad is null then split_part(pair, ':', 1) end as col, case when bad is null then to_model end as to_model, case when bad is null then split_part(pair, ':', 2) end as to_column, place::int as place, bad as error from y""",
)
def _(e: Estate) -> DataFrame:
    return dbt.composite_relationships(e.sql(_COMP), e.sql(_TWINS))


_CONC = "select model, target, case when ordinal % 2 = 0 then 'related' else 'fk' end as type, 'note ' || ordinal as note from e_declared"


@suite("b22_conceptual_relationships", f"""with {_resolved(f"select * from ({_CONC}) where type = 'related'")} select model as f, to_model as t, note, error from rv""")
def _(e: Estate) -> DataFrame:
    return dbt.conceptual_relationships(e.sql(_CONC), e.sql(_TWINS))


_TESTS = """select 'test.' || ordinal as test_id, col, case when ordinal % 4 = 0 then 'source(' || chr(39) || 'x' || chr(39) || ')' else 'ref(' || chr(39) || target || chr(39) || ')' end as `to`, coalesce(field, 'id') as field,
    case when ordinal % 3 <> 0 then model end as attached, case when ordinal % 8 = 7 then array(model) else array(model, 'model.shop.dim_e3s') end as deps from e_declared"""


@suite(
    "b23_relationship_tests",
    f"""with {_resolved("select 'test.' || ordinal as test_id, model, col, case when ordinal % 4 <> 0 then target end as target, coalesce(field, 'id') as field, ordinal % 3 <> 0 as att, case when ordinal % 8 = 7 then [model] else [model, 'model.shop.dim_e3s'] end as deps from e_declared")},
    a as (select *, list_filter(deps, lambda d: d is distinct from to_model) as o1 from rv), b as (select *, case when att then model when len(o1) = 1 then o1[1] end as m from a),
    c as (select *, list_filter(deps, lambda d: d is distinct from m) as o2 from b), f as (select test_id, m as model, col, coalesce(to_model, case when len(o2) = 1 then o2[1] end) as to_model, field as to_column from c)
    select * from f where model is not null and to_model is not null""",
)
def _(e: Estate) -> DataFrame:
    return dbt.relationship_tests(e.sql(_TESTS), e.sql(_TWINS))


_DECL = "select d.model, d.col, t.model as to_model, d.col as to_column, d.ordinal, case when d.ordinal % 6 = 5 then 'ambiguous' end as error, 'x' as target, case when d.ordinal % 3 = 0 then 'constraint' else 'meta' end as source, case when d.ordinal % 2 = 0 then 'many_to_one' when d.ordinal % 7 = 1 then 'one_to_one' end as arity from e_declared d join e_declared t on t.ordinal <> d.ordinal and (t.ordinal % 5 = d.ordinal % 5 or t.ordinal = 0)"
_TST = "select c.owner_id as model, c.name as col, t.owner_id as to_model, t.name as to_column from e_columns c join e_columns t on t.name = c.name and c.k is null and t.owner_id > c.owner_id and c.owner_id like '%e1%'"
_ENDS = f"p as (select model || '::' || lower(col) as f, to_model || '::' || lower(to_column) as t, false as tested, ordinal::bigint as ordinal, source, arity from ({_DECL}) union all select model || '::' || col, to_model || '::' || to_column, true, 0, 'test', null from ({_TST}))"


@suite("b24_relates_to_edges", f"with {_ENDS} select f, t, 'relates_to' as edge_type, case when bool_or(tested) then 'validated' else 'declared' end as confidence, arg_min(struct_pack(s := source), (tested, ordinal)).s as source, arg_min(struct_pack(a := arity), (tested, ordinal)).a as arity from p where f in (select node_id from e_columns) and t in (select node_id from e_columns) group by f, t")
def _(e: Estate) -> DataFrame:
    return dbt.relates_to_edges(e.sql(_DECL), e.sql(_TST), e.columns)


@suite(
    "b25_dangling_relationships",
    f"""with d as (select *, case when error is not null then error when model || '::' || col not in (select node_id from e_columns) then 'column not found' when to_model || '::' || to_column not in (select node_id from e_columns) then 'target column not found' end as reason from ({_DECL}))
    select split_part(model, '.', -1) || '.' || col || ' -> ' || target || '.' || to_column as label, reason from d where reason is not null""",
)
def _(e: Estate) -> DataFrame:
    return dbt.dangling_relationships(e.sql(_DECL), e.columns)


@suite(
    "b26_dbt_coverage",
    """with b as (select t, bool_and(confidence = 'inferred') as weak from e_feeds group by t) select count(distinct node_id) as total, count(*) filter (not weak) as traced, count(*) filter (weak) as inferred, count(*) filter (weak is null) as untraced
    from e_columns c left join b on b.t = c.node_id where c.owner_id like 'model%'""",
)
def _(e: Estate) -> DataFrame:
    return dbt.dbt_coverage(e.columns.where("owner_id like 'model%'"), e.feeds)


#: BI tables of which some lack the project's prefix and some lie in another schema spelling.
_FIELDS = "select node_id as field, field_id, 'W' || (field_id % 3) as bi_db, case when field_id % 4 = 0 then lower(schema_name) else schema_name end as schema_name, case when field_id % 11 = 0 then substr(table_name, 5) when field_id % 3 = 0 then upper(table_name) else table_name end as table_name, column_name from e_fields"
#: One project database behind three BI databases, two of them with a prefix.
_DB_MAP = "select 'w0' as bi_db, 'analytics' as dbt_db, 'stg_' as prefix union all select 'W1', 'Analytics', 'FCT_' union all select 'W2', 'ANALYTICS', cast(null as string)"
_BOUND = f"""tb as (select uid, lower(schema_name) as s, lower(tbl) as t, schema_name as rs, tbl as rt from e_entities where lower(db) = 'analytics' and kind = 'model' qualify row_number() over (partition by lower(schema_name), lower(tbl) order by ordinal, uid) = 1),
    fd as ({_FIELDS}), pl as (select fd.*, uid, rs, rt, cast(null as varchar) as prefix from fd join tb on tb.s = lower(schema_name) and tb.t = lower(table_name)),
    px as (select fd.*, uid, rs, rt, x.prefix from fd join ({_DB_MAP}) x on lower(x.bi_db) = lower(fd.bi_db) join tb on tb.s = lower(schema_name) and tb.t = lower(x.prefix) || lower(table_name) where fd.field_id not in (select field_id from pl)),
    mt as (select * from pl union all select * from px), cw as (select *, case when k % 9 = 0 then upper(name) else name end as spelt from e_columns),
    ex as (select c.node_id as col_id, m.field, m.field_id, 'exact' as confidence, m.prefix, (m.schema_name <> m.rs) or (m.prefix is null and m.table_name <> m.rt) or m.column_name <> c.spelt as case_mismatch, m.uid from mt m join cw c on c.owner_id = m.uid and lower(c.name) = lower(m.column_name)),
    fz as (select c.node_id as col_id, m.field, m.field_id, 'fuzzy' as confidence, m.prefix from mt m join cw c on c.owner_id = m.uid and replace(lower(c.name), '_', '') = replace(lower(m.column_name), '_', '') where m.field_id not in (select field_id from ex) qualify count(*) over (partition by m.field_id) = 1)"""


def _matched(e: Estate) -> DataFrame:
    return bind.field_relations(e.sql(_FIELDS), e.sql(_MODELS), e.sql(_DB_MAP))


def _known(e: Estate) -> DataFrame:
    return e.columns.withColumn("warehouse_name", F.when(F.col("k") % 9 == 0, F.upper("name")))


@suite("d1_bind_exact", f"with {_BOUND} select col_id, field, field_id, confidence, prefix, case_mismatch from ex where prefix is null")
def _(e: Estate) -> DataFrame:
    return bind.bind_exact(_matched(e), _known(e)).where("prefix is null")


@suite("d2_bind_prefix", f"with {_BOUND} select col_id, field, field_id, prefix from ex where prefix is not null")
def _(e: Estate) -> DataFrame:
    return bind.bind_exact(_matched(e), _known(e)).where("prefix is not null").select("col_id", "field", "field_id", "prefix")


@suite("d3_bind_fuzzy", f"with {_BOUND} select * from fz")
def _(e: Estate) -> DataFrame:
    m = _matched(e)
    return bind.bind_fuzzy(m, bind.bind_exact(m, _known(e)), _known(e))


@suite("d4_case_mismatch", f"with {_BOUND} select case_mismatch, count(*) as n from ex group by case_mismatch")
def _(e: Estate) -> DataFrame:
    return bind.bind_exact(_matched(e), _known(e)).groupBy("case_mismatch").agg(F.count(F.lit(1)).alias("n"))


@suite("d5_unverified_fields", f"with {_BOUND} select uid, count(*) as fields from mt where uid not in (select owner_id from e_columns where owner_id not like '%2s') group by uid")
def _(e: Estate) -> DataFrame:
    return bind.unverified_fields(_matched(e), e.columns.where("owner_id not like '%2s'"))


@suite(
    "d6_bind_coverage",
    f"""with {_BOUND}, m as (select uid, name, package = 'pkg' or name like 'int%' as o, uid in (select uid from ex where field_id % 2 = 0 and uid not like '%1s') as b from e_entities where kind = 'model')
    select count(*) filter (not o) as total, count(*) filter (not o and b) as bound, count(*) filter (o) as excluded, coalesce(string_agg(name, ', ' order by name) filter (not o and not b), '') as unbound from m""",
)
def _(e: Estate) -> DataFrame:
    exact = bind.bind_exact(_matched(e), _known(e)).where("field_id % 2 = 0").select(F.substring_index("col_id", "::", 1).alias("uid")).where("uid not like '%1s'")
    return bind.bind_coverage(e.sql(_MODELS), exact, ["pkg"], "^int")


@suite("d7_binding_case_norm", f"with {_BOUND} select count(*) as bindings, count(*) filter (case_mismatch) as mismatches, case when count(*) filter (case_mismatch) = 0 then 'none' when count(*) filter (case_mismatch) / count(*) > 0.9 then 'norm' else 'warning' end as verdict from ex")
def _(e: Estate) -> DataFrame:
    return bind.binding_case_norm(bind.bind_exact(_matched(e), _known(e)))


_GUESS = "select node_id, 'GUESS' as data_type from e_columns where k % 8 = 0"
_TYPED = f"""b as (select e.f as node_id, min_by(coalesce(nullif(trim(d.database_type), ''), d.base_type), e.t) as t from e_binds e join e_fields d on d.node_id = e.t where e.confidence = 'exact' group by e.f),
    ty as (select c.node_id, coalesce(c.data_type, b.t, g.data_type) as data_type, case when c.data_type is not null then 'catalog' when b.t is not null then 'metabase' when g.data_type is not null then 'inferred' end as source,
      case when coalesce(c.data_type, b.t, g.data_type) is null then 'no catalog entry for ' || c.name end as unknown_type_reason from e_columns c left join b on b.node_id = c.node_id left join ({_GUESS}) g on g.node_id = c.node_id)"""


def _typed(e: Estate) -> DataFrame:
    bound = e.binds.select(F.col("f").alias("col_id"), F.col("t").alias("field"), "confidence")
    columns = e.columns.withColumn("unknown_type_reason", F.when(F.col("data_type").isNull(), F.concat(F.lit("no catalog entry for "), "name")))
    return bind.type_waterfall(columns, bound, e.fields, e.sql(_GUESS))


@suite("e1_type_waterfall", f"with {_TYPED} select * from ty")
def _(e: Estate) -> DataFrame:
    return _typed(e)


@suite("e2_type_source_counts", f"with {_TYPED} select coalesce(source, 'unknown') as source, count(*) as n from ty group by 1")
def _(e: Estate) -> DataFrame:
    return bind.type_source_counts(_typed(e))
