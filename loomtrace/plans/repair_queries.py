"""Queries of the staged log and of card repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators import bi, graph, repair, staging
from loomtrace.operators.walk import card_dependencies
from loomtrace.plans.bi_queries import _REFS
from loomtrace.plans.estate import Estate
from loomtrace.plans.graph_queries import _DIFF, READS, VIA, layers_sql
from loomtrace.plans.suite import Suite

suite = Suite()


@suite("a7_read_staged", "with s as (select * from e_staged qualify row_number() over (partition by id order by seq) = 1) select id, seq, cardinality from s where id not like '%.error'")
def _(e: Estate) -> DataFrame:
    return staging.read_staged(e.staged, e.sql("select distinct id from e_staged where id like '%.error'")).select("id", "seq", "cardinality")


@suite("m1_stage_relationships", "select id, seq, cardinality, body from e_staged qualify row_number() over (partition by id order by seq) = 1")
def _(e: Estate) -> DataFrame:
    return staging.stage_relationships(e.staged).select("id", "seq", "cardinality", "body")


_DESC = "select cast(user_id as string) as entity, event_type as `column`, seq, body as text from e_staged"


@suite("m2_stage_descriptions", """select left(sha256('description:' || user_id || '.' || event_type), 12) as id, user_id::varchar as entity, event_type as "column", arg_max(body, seq) as text from e_staged group by user_id, event_type""")
def _(e: Estate) -> DataFrame:
    return staging.stage_descriptions(e.sql(_DESC))


_STATE = "select id, min(body) as body, min(seq) as created_at from e_staged group by id"
_EDITS = "select distinct cast(user_id as string) || '.click' as old_id, cast(case when user_id % 3 = 0 then user_id + 1 else user_id end as string) || case when user_id % 3 = 0 then '.view' else '.moved' end as id, 'edited' as body from e_staged where user_id % 5 <> 4"


@suite(
    "m3_replace_staged",
    f"""with s as ({_STATE}), ed as ({_EDITS}), u as (select id, body, created_at, 0 as tier from s where id not in (select old_id from ed) union all select ed.id, ed.body, s.created_at, 1 from ed join s on s.id = ed.old_id)
    select id, body, created_at from u qualify row_number() over (partition by id order by tier, created_at, body) = 1""",
)
def _(e: Estate) -> DataFrame:
    return staging.replace_staged(e.sql(_STATE), e.sql(_EDITS))


@suite("m4_drop_staged", f"select * from ({_STATE}) where id not like '%.error'")
def _(e: Estate) -> DataFrame:
    return staging.drop_staged(e.sql(_STATE), e.sql("select id from e_staged where id like '%.error'"))


_ENTRIES = """select c.k as id, case when c.k % 23 = 4 then '  ' when c.k % 23 = 5 then null else m.name end as from_model, c.name as from_column, case when c.k % 9 = 0 then 'nobody' when c.k % 10 = 1 then 'twin' when c.k % 5 = 2 then m.name else t.name end as to_model, case when c.k % 5 = 2 then c.name when c.k % 7 = 0 then 'none' else 'e' || t.k || '_id' end as to_column,
    case when c.k % 11 = 0 then 'some' else 'many_to_one' end as cardinality from e_columns c join e_models m on m.node_id = c.owner_id join e_models t on t.k = c.k % 25"""
_MODELS = "select node_id, name from e_models union all select node_id || 'x', 'twin' from e_models where k < 2"


@suite(
    "m5_validate_staged",
    f"""with en as ({_ENTRIES}), ms as ({_MODELS}), mn as (select lower(name) as low, count(*) as n, min(node_id) as uid from ms group by 1),
    x as (select en.*, a.n as an, b.n as bn, exists (select 1 from e_columns c where c.owner_id = a.uid and lower(c.name) = lower(from_column)) as ah, exists (select 1 from e_columns c where c.owner_id = b.uid and lower(c.name) = lower(to_column)) as bh from en left join mn a on a.low = lower(from_model) left join mn b on b.low = lower(to_model))
    select id, from_model, from_column, to_model, to_column, cardinality, case when trim(coalesce(from_model, '')) = '' then 'malformed entry' when an is null or bn is null then 'unknown model' when an > 1 or bn > 1 then 'ambiguous model' when not ah or not bh then 'column not on model' when cardinality <> 'many_to_one' then 'bad cardinality' when from_model = to_model and from_column = to_column then 'identical ends' end as reason from x""",
)
def _(e: Estate) -> DataFrame:
    return staging.validate_staged(e.sql(_ENTRIES), e.sql(_MODELS), e.columns)


_DESCRIBED = "select c.k as id, case when c.k % 9 = 0 then 'nobody' when c.k % 10 = 1 then 'twin' when c.k % 31 = 7 then null else m.name end as entity, case when c.k % 3 = 0 then null when c.k % 7 = 0 then 'none' else upper(c.name) end as column, case when c.k % 8 = 0 then ' ' || chr(10) when c.k % 13 = 5 then null else 'text ' || c.k end as body from e_columns c join e_models m on m.node_id = c.owner_id where c.k is not null"


@suite(
    "m5_validate_descriptions",
    f"""with en as ({_DESCRIBED}), mn as (select lower(name) as low, count(*) as n, min(node_id) as uid from ({_MODELS}) group by 1)
    select en.id, en.entity, en.column, en.body, case when entity is null then 'malformed entry' when trim(replace(coalesce(body, ''), chr(10), '')) = '' then 'blank text' when n is null then 'unknown model' when n > 1 then 'ambiguous model'
      when en.column is not null and not exists (select 1 from e_columns c where c.owner_id = uid and lower(c.name) = lower(en.column)) then 'column not on model' end as reason from en left join mn on low = lower(entity)""",
)
def _(e: Estate) -> DataFrame:
    return staging.validate_descriptions(e.sql(_DESCRIBED), e.sql(_MODELS), e.columns)


_ROUTE = "select k as id, case when k % 2 = 0 then 'viz_' || name when k % 3 = 0 then 'viz_gone' else name end as model from e_models"


@suite("m6_route_models", f"select r.id, r.model, coalesce(m.name, r.model) as target from ({_ROUTE}) r left join e_models m on r.model like 'viz\\_%' escape '\\' and m.name = substr(r.model, 5)")
def _(e: Estate) -> DataFrame:
    return staging.route_models(e.sql(_ROUTE), e.models, ["viz_", "rpt_"])


@suite(
    "m7_staged_edges",
    f"""with o as (select lower(name) as low, min(node_id) as uid from ({_MODELS}) group by 1 having count(*) = 1) select distinct a.uid || '::' || lower(from_column) as f, b.uid || '::' || lower(to_column) as t, 'relates_to' as edge_type, 'validated' as confidence
    from ({_ENTRIES}) x join o a on a.low = lower(from_model) join o b on b.low = lower(to_model) where a.uid || '::' || lower(from_column) in (select node_id from e_columns) and b.uid || '::' || lower(to_column) in (select node_id from e_columns)""",
)
def _(e: Estate) -> DataFrame:
    return staging.staged_edges(e.sql(_ENTRIES), e.sql(_MODELS), e.columns, as_tests=True)


_TEXTS = "select node_id, case when k % 4 = 0 then 'Key of ' || name else 'new' end as text from e_columns where k % 3 = 0 union all select 'lost::' || k, 'x' from e_sources"


@suite(
    "m8_patch_descriptions",
    f"""select n.node_id, coalesce(t.text, n.description) as description, case when t.text is null then 'kept' when t.text = n.description then 'carried' else 'changed' end as status from e_nodes n left join ({_TEXTS}) t on t.node_id = n.node_id
    union all select node_id, text, 'skipped' from ({_TEXTS}) where node_id not in (select node_id from e_nodes)""",
)
def _(e: Estate) -> DataFrame:
    return staging.patch_descriptions(e.nodes, e.sql(_TEXTS))


@suite("m9_staged_by_target", f"select to_model as target, count(*) as n, string_agg(distinct id::varchar, ', ' order by id::varchar) as ids from ({_ENTRIES}) group by 1")
def _(e: Estate) -> DataFrame:
    return staging.staged_by_target(e.sql(_ENTRIES).select(F.col("to_model").alias("target"), F.col("id").cast("string").alias("id")))


_BF = "select distinct b.f as col_id, f.field_id from e_binds b join e_fields f on f.node_id = b.t"
_USES = "select distinct field_id, card_id, cast(null as bigint) as via from e_consumed union all select distinct u.field_id, k.card_id, k.source_card_id from e_cards k join e_consumed u on u.card_id = k.source_card_id"
_GONE = f"select node_id from ({_DIFF}) where change = 'removed'"


def _removed(e: Estate) -> DataFrame:
    return graph.diff_columns(e.base, e.cand).where("change = 'removed'").select("node_id")


@suite("n1_bound_fields", f"select * from ({_BF})")
def _(e: Estate) -> DataFrame:
    return repair.bound_fields(e.sql(_BF))


_AFF = f"af as (select card_id, count(distinct field_id) as fields, coalesce(string_agg(distinct via::varchar, ', ' order by via::varchar), '') as via from ({_USES}) where field_id in (select field_id from ({_BF}) where col_id in ({_GONE})) group by card_id)"


@suite("n2_affected_cards", f"with {_AFF} select * from af")
def _(e: Estate) -> DataFrame:
    return repair.affected_cards(_removed(e), e.sql(_BF), e.sql(_USES))


_RENAMES = "select c.node_id as old, case when c.k % 4 = 3 then 'gone::x' else d.node_id end as new from e_columns c join e_columns d on d.k = c.k + 2 where c.k % 17 = 3 or c.k % 100 = 1"
_REN = f"""rn as (select r.old, r.new, case when r.old not in ({_GONE}) then 'old column was not removed' when r.new not in (select node_id from e_cand) then 'new column not found' when b.n is null then 'new column is not bound' when b.n > 1 then 'new column is bound more than once' end as complaint, b.f
      from ({_RENAMES}) r left join (select col_id, count(distinct field_id) as n, min(field_id) as f from ({_BF}) group by 1) b on b.col_id = r.new), rr as (select old, new, case when complaint is null then f end as new_field, complaint from rn)"""


def _renames(e: Estate) -> DataFrame:
    return repair.resolve_renames(e.sql(_RENAMES), _removed(e), e.cand, e.sql(_BF))


@suite("n3_resolve_renames", f"with {_REN} select * from rr")
def _(e: Estate) -> DataFrame:
    return _renames(e)


_TG = f"{_REN}, kt as (select b.col_id, 'id' as key_kind, b.field_id::varchar as key from ({_BF}) b where b.col_id in ({_GONE}) union all select node_id, 'name', lower(split_part(node_id, '::', -1)) from ({_GONE})), tg as (select kt.*, rr.new_field, rr.complaint as blocked from kt left join rr on rr.old = kt.col_id)"


def _targets(e: Estate) -> DataFrame:
    return repair.repair_targets(_removed(e), e.sql(_BF), _renames(e))


@suite("n4_repair_targets", f"with {_TG} select * from tg")
def _(e: Estate) -> DataFrame:
    return _targets(e)


_SCAN = f"{_REFS}, {_TG}, sc as (select card_id, label, count(*) filter (target in (select key from tg where key_kind = 'id') or lower(target) in (select key from tg where key_kind = 'name') or coalesce(source_field in (select key from tg where key_kind = 'id'), false)) as dead, count(*) filter (source_field in (select key from tg where key_kind = 'id')) as source_dead, count(*) as total from rf where kind = 'field' group by card_id, label)"
_ESS = f"{_SCAN}, es as (select *, dead > 0 and case regexp_replace(label, '^((source-query|stage\\d+|joins\\.source-query)\\.)+', '') when 'filter' then false when 'order-by' then false when 'fields' then dead >= total when 'breakout' then dead >= total when 'aggregation' then dead >= total when 'joins.fields' then dead >= total else true end as essential from sc)"


def _field_refs(e: Estate) -> DataFrame:
    return bi.walk_query(e.cardq).where("kind = 'field'")


@suite("n5_scan_dead_refs", f"with {_SCAN} select * from sc")
def _(e: Estate) -> DataFrame:
    return repair.scan_dead_refs(_field_refs(e), _targets(e))


@suite("n6_essential", f"with {_ESS} select * from es")
def _(e: Estate) -> DataFrame:
    return repair.essential(repair.scan_dead_refs(_field_refs(e), _targets(e)))


_FLAGS = "select card_id, card_id % 5 = 1 as blocked, card_id % 2 = 0 as orphan from e_cards where card_id % 7 <> 0"
_PLAN = f"""{_ESS}, {_AFF}, lo as (select card_id, bool_or(essential) as lost, sum(dead) as dead from es group by card_id), fg as ({_FLAGS}),
    p as (select af.card_id, k.collection_id, case when k.query_type = 'native' then 'notify' when coalesce(lo.dead, 0) = 0 then 'notify' when coalesce(blocked, false) then 'notify' when coalesce(lost, false) then 'archive' when coalesce(orphan, false) then 'strip' else 'repoint' end as a,
      case when k.query_type = 'native' then 'native query' when coalesce(lo.dead, 0) = 0 then 'only through another card' when coalesce(blocked, false) then 'rename cannot be followed' when coalesce(lost, false) then 'an essential clause is lost' when coalesce(orphan, false) then 'a column is gone' else 'all columns were renamed' end as r
      from af join e_cards k on k.card_id = af.card_id left join lo on lo.card_id = af.card_id left join fg on fg.card_id = af.card_id),
    d as (select *, case when a = 'notify' then null when collection_id in (3, 4) then 'collection is only notified' when a = 'archive' then 'action is not automatic' end as dn from p),
    pl as (select card_id, case when dn is not null then 'notify' else a end as action, case when dn is not null then a end as downgraded_from, coalesce(dn, r) as reason from d)"""


def _plan(e: Estate) -> DataFrame:
    affected = repair.affected_cards(_removed(e), e.sql(_BF), e.sql(_USES)).select("card_id")
    clauses = repair.essential(repair.scan_dead_refs(_field_refs(e), _targets(e)))
    quiet = e.sql("select distinct collection_id from e_cards where collection_id in (3, 4)")
    return repair.classify_cards(affected, clauses, e.sql(_FLAGS), e.cards.select("card_id", "query_type", "collection_id"), quiet, ["strip", "repoint"])


@suite("n7_classify_cards", f"with {_PLAN} select * from pl")
def _(e: Estate) -> DataFrame:
    return _plan(e)


_MOVES = "select field_id as old_field, field_id + 1 as new_field from e_fields where field_id % 17 = 3"


@suite("n8_repoint_refs", f"with {_REFS}, mv as ({_MOVES}) select r.card_id, r.label, coalesce(a.new_field::varchar, r.target) as target, coalesce(b.new_field::varchar, r.source_field) as source_field, a.old_field is not null or b.old_field is not null as changed from rf r left join mv a on a.old_field::varchar = r.target left join mv b on b.old_field::varchar = r.source_field where kind = 'field'")
def _(e: Estate) -> DataFrame:
    return repair.repoint_refs(_field_refs(e), e.sql(_MOVES))


_ELEM = "select card_id, case when field_id % 5 = 0 then 'source-query.filter' else clause end as label, field_id as place, 'f' || field_id as text, field_id % 3 = 0 as dead, field_id % 21 = 0 as opaque from e_consumed where clause <> 'order-by' group by card_id, clause, field_id"


@suite(
    "n9_strip_elements",
    f"""with s as (select card_id, label, coalesce(string_agg(text, ' | ' order by place, text) filter (not dead), '') as survivors, count(*) filter (not dead) as n, bool_or(dead and opaque) as blocked, bool_or(dead) as any_dead from ({_ELEM}) group by card_id, label)
    select card_id, label, survivors, case when blocked then 'blocked' when not any_dead then 'unchanged' when n = 0 then 'removed' when n = 1 and label like '%filter' then 'collapsed' else 'trimmed' end as result from s""",
)
def _(e: Estate) -> DataFrame:
    return repair.strip_elements(e.sql(_ELEM))


_AGGS = "select l_orderkey as card_id, 'L' || (l_partkey % 2) as level, row_number() over (partition by l_orderkey, l_partkey % 2 order by l_partkey, l_linenumber, l_suppkey, l_extendedprice) - 1 as `index`, l_quantity < 15 as dead from lineitem"
_AGGS_SQL = _AGGS.replace("`", '"')
_AREF = "select card_id, level, `index`, 'r' || `index` as ref_id from ({}) where card_id % 3 <> 0"


@suite(
    "n10_remap_aggregations",
    f"""with a as ({_AGGS_SQL}), s as (select *, coalesce(sum(dead::int) over (partition by card_id, level order by "index" rows between unbounded preceding and 1 preceding), 0) as before from a)
    select card_id, level, 'r' || "index" as ref_id, ("index" - before)::int as new_index from s where not dead and card_id % 3 <> 0""",
)
def _(e: Estate) -> DataFrame:
    return repair.remap_aggregations(e.sql(_AGGS), e.sql(_AREF.format(_AGGS)))


_MAP = "select d.dashcard_id, u.clause as parameter, u.field_id from e_dashcards d join (select distinct card_id, clause, field_id from e_consumed) u on u.card_id = d.card_id"
_DEADF = "select field_id from e_fields where field_id % 17 = 4"


@suite(
    "n11_dashcard_edits",
    f"""with m as (select x.dashcard_id, parameter || ':' || x.field_id as old, case when mv.new_field is not null then parameter || ':' || mv.new_field when x.field_id in ({_DEADF}) then null else parameter || ':' || x.field_id end as nw from ({_MAP}) x left join ({_MOVES}) mv on mv.old_field = x.field_id),
    g as (select dashcard_id, string_agg(old, ', ' order by old) as o, coalesce(string_agg(nw, ', ' order by nw) filter (nw is not null), '') as n from m group by 1) select dashcard_id, n as mappings from g where o <> n""",
)
def _(e: Estate) -> DataFrame:
    return repair.dashcard_edits(e.sql(_MAP), e.sql(_DEADF), e.sql(_MOVES))


_HITS = f"select u.card_id, b.col_id, u.clause as label, u.clause in ('fields', 'breakout') and u.implicit_join as essential from e_consumed u join ({_BF}) b on b.field_id = u.field_id where b.col_id like '%3'"


@suite("n12_dead_refs", f"select card_id, col_id, string_agg(distinct label, ', ' order by label) as clauses, bool_or(essential) as essential from ({_HITS}) group by card_id, col_id")
def _(e: Estate) -> DataFrame:
    return repair.dead_refs(e.sql(_HITS))


_FEW = "select card_id, 'strip' as action from e_cards where card_id % 4 = 0 union all select -1, 'strip'"


@suite(
    "n13_order_plan",
    f"""with recursive {layers_sql('select card_id as node_id from e_cards', READS)}
    select p.card_id, action, layer::int as depth, row_number() over (order by layer, p.card_id) as place from ({_FEW}) p join layered m on m.node_id = p.card_id join e_cards k on k.card_id = p.card_id where not k.archived""",
)
def _(e: Estate) -> DataFrame:
    return repair.order_plan(e.sql(_FEW), e.cards, card_dependencies(e.sql(VIA)))


_OLD = "select card_id, case when card_id % 5 = 0 then 'notify' else 'strip' end as action, 'v' || (card_id % 3) as updated_at from e_cards"
_NOW = "select card_id, case when card_id % 7 = 1 then false when card_id % 7 = 2 then null else true end as can_write, 'v' || (card_id % 4 % 3) as updated_at from e_cards where card_id % 6 <> 5"


@suite("n14_reconcile_plan", f"select p.card_id, action, case when action = 'notify' then 'notify' when n.card_id is null then 'failed' when not coalesce(can_write, true) then 'skipped' when n.updated_at <> p.updated_at then 'stale' else 'ready' end as status from ({_OLD}) p left join ({_NOW}) n on n.card_id = p.card_id")
def _(e: Estate) -> DataFrame:
    return repair.reconcile_plan(e.sql(_OLD), e.sql(_NOW))


_DONE = "select card_id, case when card_id % 3 = 0 then 'strip' else 'repoint' end as action, case card_id % 5 when 0 then 'applied' when 1 then 'notified' when 2 then 'skipped' when 3 then 'stale' else 'failed' end as status, case when card_id % 4999 = 5 then 'timeout' end as error from e_cards"


@suite("n15_outcome_rollup", f"select status, list_position(['applied', 'notified', 'skipped', 'stale', 'failed'], status)::int as place, count(*) as n, count(*) filter (action = 'strip') as strips, bool_or(status not in ('applied', 'notified', 'skipped') or error is not null) as failed from ({_DONE}) group by status")
def _(e: Estate) -> DataFrame:
    return repair.outcome_rollup(e.sql(_DONE))


_REP = "select card_id, case card_id % 4 when 0 then 'strip' when 1 then 'archive' when 2 then 'repoint' else 'notify' end as action, 'because ' || creator as reason from e_cards"


@suite(
    "n16_plan_report",
    f"""with p as (select *, list_position(['strip', 'archive', 'repoint', 'notify'], action) as p from ({_REP})), l as (select p, -1 as card_id, any_value(action) || ': ' || count(*) as line from p group by p union all select p, card_id, '  #' || card_id || ' ' || reason from p)
    select row_number() over (order by p, card_id) as line_no, line from l""",
)
def _(e: Estate) -> DataFrame:
    return repair.plan_report(e.sql(_REP))


@suite("n17_write_access_summary", f"select count(*) filter (can_write) as writable, count(*) filter (not can_write) as refused, count(*) filter (can_write is null) as unknown from ({_NOW})")
def _(e: Estate) -> DataFrame:
    return repair.write_access_summary(e.sql(_NOW))
