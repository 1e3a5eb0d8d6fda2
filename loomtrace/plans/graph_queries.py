"""Queries of the graph, the walks, impact and hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators import graph, hygiene, impact, walk
from loomtrace.plans.estate import Estate
from loomtrace.plans.suite import Suite

suite = Suite()

#: Starts of the traversals.
_EVERY = "select node_id from e_columns"
_BOARD_STARTS = "select distinct dash_id as node_id from e_dashcards"
_CONSUMERS = "select node_id from e_nodes where node_type in ('mb_card', 'mb_dashboard')"


@suite("f1_assemble_graph", "select edge_type, confidence, count(*) as n from e_edges group by edge_type, confidence")
def _(e: Estate) -> DataFrame:
    parts = graph.assemble_graph(e.feeds, e.references, e.binds, e.uses, e.sql("select distinct 'mb_card::' || card_id as f, dash_id as t, 'appears_on' as edge_type, 'exact' as confidence from e_dashcards"), e.relates)
    return parts.groupBy("edge_type", "confidence").agg(F.count(F.lit(1)).alias("n"))


_NEW = "select f, t, edge_type, 'declared' as confidence, t || '/' || f || '/' || confidence as o from (select * from e_feeds union all select t, f, edge_type, confidence from e_feeds union all select t, f, edge_type, 'parsed' from e_feeds where confidence = 'exact')"


@suite(
    "f2_merge_edges",
    f"""with n as ({_NEW}), first as (select * from n qualify row_number() over (partition by f, t, edge_type order by o) = 1)
    select *, false as added from e_feeds union all
    select f, t, edge_type, confidence, true from first x where not exists (select 1 from e_feeds y where (x.f, x.t, x.edge_type) = (y.f, y.t, y.edge_type))""",
)
def _(e: Estate) -> DataFrame:
    return graph.merge_edges(e.feeds, e.sql(_NEW), "o")


@suite(
    "f3_graphs_equal",
    """with a as (select f, t, edge_type from e_feeds), b as (select f, t, edge_type from e_feeds where confidence <> 'inferred' union all select f, t, edge_type from e_references)
    select (select count(*) from (select * from a except all select * from b)) as only_first, (select count(*) from (select * from b except all select * from a)) as only_second,
           not exists (select * from a except all select * from b) and not exists (select * from b except all select * from a) as equal""",
)
def _(e: Estate) -> DataFrame:
    key = graph.EDGE_KEY
    return graph.graphs_equal(e.feeds.select(key), e.feeds.where("confidence <> 'inferred'").select(key).union(e.references.select(key)))


_DIFF = """select coalesce(b.node_id, c.node_id) as node_id, case when c.node_id is null then 'removed' when b.node_id is null then 'added' else 'type_changed' end as change,
    b.data_type as old_type, c.data_type as new_type from e_base b full join e_cand c on b.node_id = c.node_id
    where b.node_id is null or c.node_id is null or b.data_type is distinct from c.data_type"""


@suite("f4_diff_columns", _DIFF)
def _(e: Estate) -> DataFrame:
    return graph.diff_columns(e.base, e.cand)


@suite(
    "f5_reuse_bi_side",
    """select 'node' as kind, node_type as type, count(*) as n from (select node_type from e_nodes where node_type in ('mb_field', 'mb_card', 'mb_dashboard') union all select 'column' from e_cand) group by node_type
    union all select 'edge', edge_type, count(*) from (select edge_type from e_edges where edge_type in ('consumed_by', 'appears_on') union all select edge_type from e_references
      union all select edge_type from e_binds b where exists (select 1 from e_cand c where c.node_id = b.f)) group by edge_type""",
)
def _(e: Estate) -> DataFrame:
    nodes = e.cand.withColumn("node_type", F.lit("column")).select("node_id", "node_type")
    bound = e.binds.join(e.cand.select(F.col("node_id").alias("f")), "f", "left_semi")
    n, m = graph.reuse_bi_side(e.nodes.select("node_id", "node_type"), e.edges, nodes, e.references, bound)
    count = lambda df, kind, c: df.groupBy(F.col(c).alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(n, "node", "node_type").union(count(m, "edge", "edge_type"))


@suite(
    "f6_store_snapshot",
    "with s as (select user_id as sha, max(event_id) as seq from events where event_type = 'purchase' group by user_id) select sha, seq, cast(row_number() over (order by seq desc) as int) as slot from s order by seq desc limit 20",
)
def _(e: Estate) -> DataFrame:
    return graph.store_snapshot(e.sql("select user_id as sha, event_id as seq from events where event_type = 'purchase'"))


@suite("f7_previous_snapshot", "select event_id as sha, event_id as seq, user_id, lag(event_id) over (partition by user_id order by event_id) as previous from events where event_type = 'purchase'")
def _(e: Estate) -> DataFrame:
    return graph.previous_snapshot(e.sql("select event_id as sha, event_id as seq, user_id from events where event_type = 'purchase'"), "user_id")


@suite(
    "f8_resolve_baseline",
    """with recursive b as (select sha, sha as at_sha, 0 as distance from e_commits union all
      select b.sha, c.first_parent, b.distance + 1 from b join e_commits c on c.sha = b.at_sha where not c.stored and c.first_parent is not null and b.distance < 200)
    select b.sha, b.at_sha as baseline, b.distance from b join e_commits c on c.sha = b.at_sha where c.stored""",
)
def _(e: Estate) -> DataFrame:
    return graph.resolve_baseline(e.commits)


@suite(
    "f9_dangling_endpoints",
    """with ends as (select f as id from e_edges union select t from e_edges), kept as (select * from e_nodes where node_type <> 'mb_card' and not (node_type = 'column' and name like '%7'))
    select id as node_id, case when id like 'mb_field::%' then 'mb_field' when id like 'mb_card::%' then 'mb_card' when id like 'mb_dash::%' then 'mb_dashboard' when id like '%::%' then 'column' when id like 'source.%' then 'source' else 'model' end as node_type,
      case when id like '%::%' then split_part(id, '::', 2) else split_part(id, '.', 3) end as name, o.schema_name, o.table_name
    from ends left join kept o on id like '%::%' and o.node_id = split_part(id, '::', 1) where not exists (select 1 from kept k where k.node_id = id)""",
)
def _(e: Estate) -> DataFrame:
    return graph.dangling_endpoints(e.nodes.where("node_type <> 'mb_card' and not (node_type = 'column' and name like '%7')"), e.edges)


@suite(
    "f10_graph_stats",
    """select 'node' as kind, t.type, (select count(*) from e_nodes where node_type = t.type) as n, t.place from (values ('source', 1), ('model', 2), ('column', 3), ('mb_field', 4), ('mb_card', 5), ('mb_dashboard', 6)) t(type, place)
    union all select 'edge', edge_type, count(*), row_number() over (order by edge_type) from e_edges group by edge_type""",
)
def _(e: Estate) -> DataFrame:
    return graph.graph_stats(e.nodes, e.edges)


@suite("f11_build_freshness", "select event_id, datediff('day', ts::date, date '2024-02-01')::int as age_days, datediff('day', ts::date, date '2024-02-01') >= 7 as stale from events")
def _(e: Estate) -> DataFrame:
    builds = e.sql("select event_id, ts as generated_at from events")
    return graph.build_freshness(builds, F.lit("2024-02-01")).drop("generated_at")


def _walk_sql(starts: str, depth: int = 20) -> str:
    """CTEs ``w`` (start, node, depth) of all walks and ``hit`` of the shortest."""
    return f"""w as (select node_id as start, node_id as node, 0 as depth from ({starts}) where node_id in (select node_id from e_nodes)
      union select w.start, e.t, w.depth + 1 from w join e_flow e on e.f = w.node where w.depth < {depth}),
    hit as (select start, node, min(depth) as depth from w group by start, node)"""


_CHANGED = f"select node_id from ({_DIFF}) where change <> 'added'"


@suite(
    "g1_downstream",
    f"""with recursive {_walk_sql(_CHANGED)},
    p as (select start, start as node, 0 as depth, [start] as path, cast([] as varchar[]) as kinds, cast([] as varchar[]) as o from hit where depth = 0 union all
      select start, node, depth, path, kinds, o from (select p.start, e.t as node, p.depth + 1 as depth, p.path || [e.t] as path, p.kinds || [e.edge_type] as kinds, p.o || [e.t, e.edge_type] as o,
        row_number() over (partition by p.start, e.t order by p.o || [e.t, e.edge_type]) as k from p join e_flow e on e.f = p.node join hit h on h.start = p.start and h.node = e.t and h.depth = p.depth + 1) where k = 1)
    select start, p.node as node_id, n.node_type, depth, array_to_string(path, ' > ') as path, array_to_string(kinds, ' > ') as edge_types from p join e_nodes n on n.node_id = p.node where depth > 0""",
)
def _(e: Estate) -> DataFrame:
    found = walk.downstream(e.nodes, e.edges, impact.changed(graph.diff_columns(e.base, e.cand)))
    return found.withColumns({"path": F.array_join("path", " > "), "edge_types": F.array_join("edge_types", " > ")})


@suite(
    "g2_truncated",
    f"with recursive {_walk_sql(_EVERY)} select start, coalesce(bool_or(depth = 20 and exists (select 1 from e_flow e where e.f = hit.node and not exists (select 1 from hit x where x.start = hit.start and x.node = e.t))), false) as truncated from hit group by start",
)
def _(e: Estate) -> DataFrame:
    return walk.truncated_starts(e.nodes, e.edges, e.sql(_EVERY))


_RANK = "case confidence when 'exact' then 5 when 'validated' then 4 when 'parsed' then 3 when 'declared' then 3 when 'inferred' then 2 else 1 end"
_WORD = "case {0} when 5 then 'exact' when 4 then 'validated' when 3 then 'parsed' when 2 then 'inferred' else 'fuzzy' end"


def _reach_sql(starts: str, a: str = "f", b: str = "t", where: str = "true") -> str:
    return f"""ed as (select {a} as a, {b} as b, {_RANK} as r from e_flow where {where}),
    rr as (select s.node_id as start, e.b as node, 1 as depth, e.r as r from ({starts}) s join ed e on e.a = s.node_id
      union select rr.start, e.b, rr.depth + 1, least(rr.r, e.r) from rr join ed e on e.a = rr.node where rr.depth < 30),
    reached as (select start, node as node_id, min(depth) as depth, {_WORD.format("max(r)")} as confidence from rr group by start, node)"""


@suite("g3_reach_down", f"with recursive {_reach_sql(_EVERY)} select * from reached")
def _(e: Estate) -> DataFrame:
    return walk.reach(e.edges, e.sql(_EVERY), "down")


@suite("g3_reach_up", f"with recursive {_reach_sql(_BOARD_STARTS, 't', 'f')} select * from reached")
def _(e: Estate) -> DataFrame:
    return walk.reach(e.edges, e.sql(_BOARD_STARTS), "up")


@suite("g4_reached_of_type", f"with recursive {_reach_sql(_EVERY)} select r.*, n.name from reached r join e_nodes n on n.node_id = r.node_id where n.node_type = 'mb_dashboard'")
def _(e: Estate) -> DataFrame:
    return walk.reached_of_type(walk.reach(e.edges, e.sql(_EVERY)), e.nodes, "mb_dashboard")


_LIVE = f"""live as (select node_id from ({_CONSUMERS}) union select b.f from live l join (select f, t from e_flow union all select owner_id, node_id from e_columns) b on b.t = l.node_id)"""


@suite("g5_feeds_a_consumer", f"with recursive {_LIVE} select node_id from live")
def _(e: Estate) -> DataFrame:
    return walk.feeds_a_consumer(e.nodes, e.edges)


@suite("g6_lineage_subgraph")
def _(e: Estate) -> DataFrame:
    return walk.lineage_subgraph(e.edges, e.sql(_EVERY))[1]


def layers_sql(nodes: str, edges: str) -> str:
    """CTEs that end in ``layered(node_id, layer)``: pairs that reach each other, their groups, and the longest way over these."""
    return f"""nd as (select distinct node_id from ({nodes})), ed as (select distinct f, t from ({edges}) where f <> t and f in (select node_id from nd) and t in (select node_id from nd)),
    cl as (select f as a, t as b from ed union select cl.a, ed.t from cl join ed on ed.f = cl.b),
    rt as (select n.node_id, least(n.node_id, coalesce(min(x.b), n.node_id)) as root from nd n left join (select c.a, c.b from cl c join cl d on d.a = c.b and d.b = c.a) x on x.a = n.node_id group by n.node_id),
    ce as (select distinct p.root as f, q.root as t from ed join rt p on p.node_id = ed.f join rt q on q.node_id = ed.t where p.root <> q.root),
    ly as (select distinct root as node, 0 as layer from rt union select ce.t, ly.layer + 1 from ly join ce on ce.f = ly.node),
    layered as (select rt.node_id, max(layer) as layer from rt join ly on ly.node = rt.root group by rt.node_id)"""


#: Feeds with some turned round as well, so that there are cycles, and columns behind them.
_CYCLIC = "select f, t from e_feeds union all select e.t, e.f from e_feeds e join e_columns c on c.node_id = e.t where c.k % 97 = 5"


@suite("g7_layers", f"with recursive {layers_sql('select node_id from e_columns', _CYCLIC)} select * from layered")
def _(e: Estate) -> DataFrame:
    return walk.layers(e.columns, e.sql(_CYCLIC))


_ROLL = f"""with en as (select node_id, coalesce(owner_id, node_id) as entity, node_type = 'column' as is_column from e_nodes where node_type <> 'mb_field'),
    d as (select f, t, edge_type, {_RANK} as r from e_flow where edge_type not in ('binds_to', 'consumed_by')
      union all select b.f, u.t, 'through', least({_RANK.replace('confidence', 'b.confidence')}, {_RANK.replace('confidence', 'u.confidence')}) from e_binds b join e_uses u on u.f = b.t),
    rolled as (select a.entity as f, b.entity as t, count(distinct case when a.is_column then d.f end) as weight, {_WORD.format('max(r)')} as confidence, bool_or(edge_type = 'references') as declared
      from d join en a on a.node_id = d.f join en b on b.node_id = d.t where a.entity <> b.entity group by a.entity, b.entity)"""


@suite("g8_roll_up", f"{_ROLL} select * from rolled")
def _(e: Estate) -> DataFrame:
    return walk.roll_up(e.nodes, e.edges)


@suite("g9_entity_members", "select owner_id as entity, count(*) as members from e_columns group by owner_id")
def _(e: Estate) -> DataFrame:
    return walk.entity_members(e.nodes)


_BELOW = f"""below as (select e.f as node, e.t as consumer from e_flow e join ({_CONSUMERS}) c on c.node_id = e.t union select e.f, b.consumer from below b join e_flow e on e.t = b.node),
    held as (select node, consumer from below union select c.owner_id, b.consumer from below b join e_columns c on c.node_id = b.node),
    counted as (select n.node_id, count(h.consumer) filter (h.consumer like 'mb_card::%' and h.consumer <> n.node_id) as cards, count(h.consumer) filter (h.consumer like 'mb_dash::%' and h.consumer <> n.node_id) as dashboards
      from e_nodes n left join held h on h.node = n.node_id group by n.node_id)"""


@suite("g10_consequence_counts", f"with recursive {_BELOW} select * from counted")
def _(e: Estate) -> DataFrame:
    return walk.consequence_counts(e.nodes, e.edges)


#: What cards inherit, as (card_id, via): sources, joins and metrics, some in circles.
VIA = "select card_id, upstream as via from e_deps union all select card_id, null from e_cards"
READS = "select upstream as f, card_id as t from e_deps"


@suite("g11_card_depth", f"with recursive {layers_sql('select card_id as node_id from e_cards', READS)} select node_id as card_id, layer as depth from layered")
def _(e: Estate) -> DataFrame:
    return walk.card_depth(e.cards, walk.card_dependencies(e.sql(VIA)))


@suite("g11_card_dependencies", "select distinct card_id, upstream from e_deps where card_id <> upstream")
def _(e: Estate) -> DataFrame:
    return walk.card_dependencies(e.sql(VIA))


def _impacted(e: Estate) -> tuple[DataFrame, DataFrame]:
    return impact.impact(e.nodes, e.edges, e.base, e.cand)


_HIT = f"{_walk_sql(_CHANGED)}, hits as (select h.start, h.node as node_id, n.node_type, n.name, n.owner_id from hit h join e_nodes n on n.node_id = h.node where h.depth > 0)"
_MODELS = "ms as (select distinct h.start, m.name as model from hits h join e_nodes m on m.node_id = case when h.node_type = 'column' then h.owner_id else h.node_id end where h.node_type in ('column', 'model'))"
_BOARDS = "bd as (select distinct 'mb_card::' || d.card_id as card, d.dash_id as board, n.name as board_name from e_dashcards d join e_nodes n on n.node_id = d.dash_id)"
_CARDS = """cs as (select h.start, h.node_id as card, c.card_id as card_number, c.card_id::varchar as ref, c.name, c.creator as owner, coalesce(string_agg(distinct board_name, ', ' order by board_name), '') as dashboards, count(distinct board) as n_dashboards
      from hits h join e_cards c on c.node_id = h.node_id left join bd on bd.card = h.node_id group by all)"""


@suite("h1_impact", f"with recursive {_HIT} select d.change, h.node_type, count(*) as n, count(distinct h.node_id) as distinct_nodes from hits h join ({_DIFF}) d on d.node_id = h.start group by d.change, h.node_type")
def _(e: Estate) -> DataFrame:
    diff, found = _impacted(e)
    return found.join(diff.withColumnRenamed("node_id", "start"), "start").groupBy("change", "node_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("node_id").alias("distinct_nodes"))


@suite("h2_impact_models", f"with recursive {_HIT}, {_MODELS} select * from ms")
def _(e: Estate) -> DataFrame:
    return impact.impact_models(impact.impact(e.nodes, e.edges, e.base, e.cand, kinds=["column", "model"])[1], e.nodes)


@suite("h3_impact_cards", f"with recursive {_HIT}, {_BOARDS}, {_CARDS} select start, card, ref, card_number, name, dashboards, n_dashboards, owner from cs")
def _(e: Estate) -> DataFrame:
    return impact.impact_cards(_impacted(e)[1], e.nodes, e.edges)


#: Boards that show a field and no card.
_ALONE = "select 'mb_dash::x' || (k % 40) as dash_id, 'mb_field::' || k as field from e_columns where k % 13 = 0"
_LOOSE = f"select f, t, edge_type, confidence from e_edges union all select field, dash_id, 'consumed_by', 'exact' from ({_ALONE})"
_BOARD_NODES = f"select node_id, node_type, name, owner_id from e_nodes union all select distinct dash_id, 'mb_dashboard', 'Alone ' || dash_id, cast(null as varchar(200)) from ({_ALONE})"


@suite(
    "h4_extra_dashboards",
    f"""with recursive fl as (select f, t from ({_LOOSE}) where edge_type <> 'relates_to'),
    w as (select node_id as start, node_id as node, 0 as depth from ({_CHANGED}) union select w.start, e.t, w.depth + 1 from w join fl e on e.f = w.node where w.depth < 20),
    {_BOARDS}, hits as (select distinct start, node from w where depth > 0)
    select distinct h.start, h.node as board, n.name as board_name from hits h join ({_BOARD_NODES}) n on n.node_id = h.node where n.node_type = 'mb_dashboard'
      and not exists (select 1 from hits c join bd on bd.card = c.node where c.start = h.start and bd.board = h.node)""",
)
def _(e: Estate) -> DataFrame:
    nodes, edges = e.sql(_BOARD_NODES), e.sql(_LOOSE)
    found = walk.downstream(nodes, edges, impact.changed(graph.diff_columns(e.base, e.cand)))
    return impact.extra_dashboards(found, nodes, edges)


_REPORT = f"""{_HIT}, {_MODELS}, {_BOARDS}, {_CARDS},
    m2 as (select start, string_agg(model, ', ' order by model) as models, count(*) as n from ms group by start),
    c2 as (select start, string_agg(ref, ', ' order by card_number) as cards, count(*) as n from cs group by start),
    b2 as (select start, string_agg(distinct name, ', ' order by name) as dashboards, count(distinct name) as n from hits where node_type = 'mb_dashboard' group by start),
    rep as (select d.node_id as start, o.name || '.' || c.name as label, d.change, d.old_type, d.new_type, coalesce(models, '') as models, coalesce(cards, '') as cards, coalesce(dashboards, '') as dashboards,
      coalesce(m2.n, 0) as n_models, coalesce(c2.n, 0) as n_cards, coalesce(b2.n, 0) as n_dashboards
      from ({_DIFF}) d join e_columns c on c.node_id = d.node_id join e_nodes o on o.node_id = c.owner_id left join m2 on m2.start = d.node_id left join c2 on c2.start = d.node_id left join b2 on b2.start = d.node_id where d.change <> 'added')"""


@suite("h5_impact_report", f"with recursive {_REPORT} select * from rep")
def _(e: Estate) -> DataFrame:
    return impact.impact_report(*_impacted(e), e.nodes, e.edges)


@suite("h6_impact_totals", f"with recursive {_HIT} select count(distinct node_id) filter (node_type = 'mb_card') as cards, count(distinct node_id) filter (node_type = 'mb_dashboard') as dashboards from hits")
def _(e: Estate) -> DataFrame:
    return impact.totals_below(e.nodes, e.edges, graph.diff_columns(e.base, e.cand))


@suite(
    "h7_build_summary",
    f"""with recursive {_HIT}, n as (select count(*) filter (change = 'removed') as r, count(*) filter (change = 'type_changed') as y, count(*) filter (change = 'added') as a from ({_DIFF})),
    c as (select count(distinct node_id) filter (node_type = 'mb_card') as cards, count(distinct node_id) filter (node_type = 'mb_dashboard') as boards from hits)
    select 'since last build: ' || r || ' columns removed, ' || y || ' type-changed, ' || a || ' added -> ' || cards || ' cards on ' || boards || ' dashboards affected' as summary from n, c""",
)
def _(e: Estate) -> DataFrame:
    diff = graph.diff_columns(e.base, e.cand)
    return impact.build_summary(diff, impact.totals_below(e.nodes, e.edges, diff))


@suite(
    "h8_blast_radius",
    f"""with recursive {_HIT.replace(_CHANGED, _EVERY)}, {_MODELS}, {_BOARDS},
    sh as (select h.start, h.node_id, h.node_type, n.creator, case when h.node_type = 'column' then o.name || '.' || n.name else n.name end as label from hits h join e_nodes n on n.node_id = h.node_id left join e_nodes o on o.node_id = n.owner_id where h.start <> h.node_id),
    bo as (select card as node_id, string_agg(distinct board_name, ', ' order by board_name) as boards from bd group by card),
    cd as (select start, string_agg(split_part(sh.node_id, '::', 2) || ' ' || label || coalesce(' [' || boards || ']', '') || coalesce(' by ' || creator, ''), ', ' order by split_part(sh.node_id, '::', 2)::bigint) as cards from sh left join bo on bo.node_id = sh.node_id where node_type = 'mb_card' group by start),
    li as (select start, string_agg(label, ', ' order by label, node_id) filter (node_type = 'column') as columns, string_agg(label, ', ' order by label, node_id) filter (node_type = 'mb_field') as fields, string_agg(label, ', ' order by label, node_id) filter (node_type = 'mb_dashboard') as dashboards,
      count(*) filter (node_type = 'column') as n_columns, count(*) filter (node_type = 'mb_field') as n_fields, count(*) filter (node_type = 'mb_card') as n_cards, count(*) filter (node_type = 'mb_dashboard') as n_dashboards from sh group by start),
    mo as (select start, string_agg(model, ', ' order by model) as models from ms group by start)
    select s.node_id as start, coalesce(models, '') as models, coalesce(columns, '') as columns, coalesce(fields, '') as fields, coalesce(cards, '') as cards, coalesce(dashboards, '') as dashboards,
      coalesce(n_columns, 0) as n_columns, coalesce(n_fields, 0) as n_fields, coalesce(n_cards, 0) as n_cards, coalesce(n_dashboards, 0) as n_dashboards, false as truncated
    from ({_EVERY}) s left join li on li.start = s.node_id left join cd on cd.start = s.node_id left join mo on mo.start = s.node_id""",
)
def _(e: Estate) -> DataFrame:
    return impact.blast_radius(e.nodes, e.edges, e.sql(_EVERY))


_QUERIES = """select node_id as query from e_columns where k % 40 = 0 union all select ' ' || upper(name) || ' ' from e_columns where k % 30 = 1
    union all select m.name || '.' || c.name from e_columns c join e_models m on m.node_id = c.owner_id where c.k % 20 = 2 union all select lower(m.schema_name) || '.' || m.name || '.' || c.name from e_columns c join e_models m on m.node_id = c.owner_id where c.k % 20 = 3
    union all select 'e' || k || '_id' from e_models union all select upper(name) from e_models union all select node_id || '.none' from e_models union all select 'zz' || k from e_sources union all select '  ' from region"""


@suite(
    "h9_resolve_column_refs",
    f"""with q as (select distinct query, lower(trim(query)) as q from ({_QUERIES})), s as (select *, case when contains(q, '.') then regexp_extract(q, '^(.*)\\.[^.]*$', 1) else '' end as hint, split_part(q, '.', -1) as wanted from q),
    al as (select node_id as owner_id, unnest([lower(node_id), lower(split_part(node_id, '.', -1)), lower(name), lower(schema_name || '.' || name)]) as alias from e_nodes where node_type in ('model', 'source')),
    c as (select node_id, owner_id, lower(split_part(node_id, '::', 2)) as tail from e_columns),
    a as (select query, count(*) as n, min(node_id) as id from q join e_columns on lower(node_id) = q group by query),
    b as (select s.query, count(distinct c.node_id) as n, min(c.node_id) as id from s join c on c.tail = s.wanted where s.hint = '' or exists (select 1 from al where al.owner_id = c.owner_id and al.alias = s.hint) group by s.query),
    m as (select query, arg_min(name, node_id) as model from q join e_nodes on node_type in ('model', 'source') and (lower(node_id) = q or lower(name) = q) group by query),
    o as (select q.query, a.id as id1, b.id as id2, b.n as n2, m.model, case when q = '' then 'empty' when a.n = 1 or b.n = 1 then 'resolved' when b.n > 1 then 'candidates' when m.model is not null then 'model' else 'unknown' end as outcome
      from q left join a on a.query = q.query left join b on b.query = q.query left join m on m.query = q.query)
    select query, outcome, case when outcome = 'resolved' then coalesce(id1, id2) end as node_id, case when outcome = 'candidates' then n2 else 0 end as candidates, case when outcome = 'model' then model end as model from o""",
)
def _(e: Estate) -> DataFrame:
    return impact.resolve_column_refs(e.sql(_QUERIES), e.nodes)


_ASKED = "select node_id || '.none' as query from e_models union all select 'e' || k || '_idx' from e_models union all select name from e_models where k < 9 union all select 'zz' || k from e_sources union all select name || '.c_1x' from e_models where k % 6 = 1"


@suite("h9_column_suggestions")
def _(e: Estate) -> DataFrame:
    return impact.column_suggestions(impact.resolve_column_refs(e.sql(_ASKED), e.nodes), e.nodes)


@suite(
    "h10_report_text",
    f"""with recursive {_REPORT}, ls as (select start, list_filter(['**' || label || '**' || case when change = 'removed' then ' removed' else ' type changed: ' || coalesce(old_type, 'unknown') || ' -> ' || coalesce(new_type, 'unknown') end,
      case when n_models > 0 then '  ' || n_models || case when n_models = 1 then ' downstream model: ' else ' downstream models: ' end || models end,
      case when n_cards > 0 then '  ' || n_cards || case when n_cards = 1 then ' card: ' else ' cards: ' end || cards end,
      case when n_dashboards > 0 then '  ' || n_dashboards || case when n_dashboards = 1 then ' dashboard: ' else ' dashboards: ' end || dashboards end,
      case when n_models + n_cards + n_dashboards = 0 then '  no downstream impact found' end], lambda x: x is not null) as l from rep)
    select start, unnest(range(len(l)))::int as line_no, unnest(l) as line from ls
    union all select null, 0, count(*) filter (change = 'removed') || ' columns removed or renamed, ' || count(*) filter (change = 'type_changed') || ' columns type-changed' from rep
    union all select null, 1, 'a renamed column counts as removed and added'""",
)
def _(e: Estate) -> DataFrame:
    return impact.report_text(impact.impact_report(*_impacted(e), e.nodes, e.edges))


@suite("h11_impact_gate", f"select coalesce(bool_or(change <> 'added'), false) as breaking from ({_DIFF})")
def _(e: Estate) -> DataFrame:
    return impact.impact_gate(graph.diff_columns(e.base, e.cand))


@suite(
    "h12_split_messages",
    """with recursive ln as (select case when collection_id % 5 <> 3 then collection_id end as collection_id, row_number() over (partition by case when collection_id % 5 <> 3 then collection_id end order by card_id) as k, name as line from e_cards),
    pk as (select collection_id, k, 0 as chunk, length(line) + 1 as size from ln where k = 1 union all
      select l.collection_id, l.k, case when p.size + 1 + length(l.line) <= 2900 then p.chunk else p.chunk + 1 end, case when p.size + 1 + length(l.line) <= 2900 then p.size + 1 + length(l.line) else length(l.line) + 1 end from pk p join ln l on l.collection_id is not distinct from p.collection_id and l.k = p.k + 1)
    select p.collection_id, p.chunk, string_agg(l.line, chr(10) order by l.k) as text from pk p join ln l on l.collection_id is not distinct from p.collection_id and l.k = p.k group by p.collection_id, p.chunk""",
)
def _(e: Estate) -> DataFrame:
    lines = e.sql("select case when collection_id % 5 <> 3 then collection_id end as collection_id, card_id as line_no, name as line from e_cards")
    return impact.split_messages(lines, "collection_id")


def _live(e: Estate) -> DataFrame:
    return walk.feeds_a_consumer(e.nodes, e.edges)


_DEAD = f"""{_LIVE}, dc as (select owner_id, count(*) as n_columns, count(*) filter (node_id not in (select node_id from live)) as n_dead, string_agg(name, ', ' order by name) filter (node_id not in (select node_id from live)) as columns from e_columns group by owner_id),
    dm as (select node_id, name, (select count(*) from e_columns c where c.owner_id = m.node_id) as n_columns from e_models m where node_id not in (select node_id from live)),
    ac as (select k.node_id as card, k.name, string_agg(distinct o.name || '.' || c.name, ', ' order by o.name || '.' || c.name) as columns, count(distinct c.node_id) as n_columns
      from e_cards k join e_uses u on u.t = k.node_id join e_binds b on b.t = u.f join e_columns c on c.node_id = b.f join e_nodes o on o.node_id = c.owner_id where k.archived group by k.node_id, k.name),
    sc as (select 'mb_card::' || card_id as card, count(distinct dash_id) as n_dashboards from e_dashcards where 'mb_card::' || card_id in (select node_id from e_cards where not archived) group by card_id having bool_and(dash_id like '%5'))"""


@suite("i1_unconsumed_columns", f"with recursive {_DEAD} select owner_id, n_dead, n_columns, n_dead = n_columns as whole_owner, columns from dc where n_dead > 0")
def _(e: Estate) -> DataFrame:
    return hygiene.unconsumed_columns(e.nodes, _live(e))


#: A graph in which some models feed nothing: flow out of every fourth is left out.
_CUT = "select * from e_edges where f not like '%stg_%' and f not like 'source%'"


@suite("i2_dead_models", f"with recursive {_DEAD.replace('e_flow union all select owner_id', f'({_CUT}) where edge_type <> {chr(39)}relates_to{chr(39)} union all select owner_id')} select * from dm")
def _(e: Estate) -> DataFrame:
    return hygiene.dead_models(e.nodes, walk.feeds_a_consumer(e.nodes, e.sql(_CUT)))


@suite("i3_archived_cards_bound", f"with recursive {_DEAD} select * from ac")
def _(e: Estate) -> DataFrame:
    return hygiene.archived_cards_bound(e.nodes, e.edges)


@suite("i4_cards_only_on_archived_dashboards", f"with recursive {_DEAD} select * from sc")
def _(e: Estate) -> DataFrame:
    return hygiene.cards_only_on_archived_dashboards(e.nodes, e.edges)


@suite("i5_dead_totals", f"with recursive {_DEAD} select (select coalesce(sum(n_dead), 0) from dc)::bigint as columns, (select count(*) from dm) as models, (select count(*) from ac) as archived_cards, (select count(*) from sc) as stranded_cards, false as empty, false as vacuous")
def _(e: Estate) -> DataFrame:
    live = _live(e)
    parts = hygiene.unconsumed_columns(e.nodes, live), hygiene.dead_models(e.nodes, live), hygiene.archived_cards_bound(e.nodes, e.edges), hygiene.cards_only_on_archived_dashboards(e.nodes, e.edges)
    return hygiene.dead_totals(e.nodes, *parts)
