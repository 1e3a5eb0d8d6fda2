"""The lineage estate: views over the star-schema tables, the same text in Spark and in SQL.

Sizes follow the tables. Node ids are unique within an estate; a fleet is one
large graph whose ids carry their estate in front (see ``graph.qualify``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loomtrace.plans.closure import settled

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Views in the order in which they build on each other.
VIEWS: dict[str, str] = {
    "e_models": """
select 'model.' || case when n_nationkey % 9 = 8 then 'pkg' else 'shop' end || '.' || case n_nationkey % 4 when 0 then 'stg_' when 1 then 'int_' when 2 then 'fct_' else 'dim_' end || 'e' || n_nationkey || 's' as node_id,
       case n_nationkey % 4 when 0 then 'stg_' when 1 then 'int_' when 2 then 'fct_' else 'dim_' end || 'e' || n_nationkey || 's' as name,
       'ANALYTICS' as db, 'S' || n_regionkey as schema_name, n_nationkey as k,
       case when n_nationkey % 9 = 8 then 'pkg' else 'shop' end as package,
       case when n_nationkey % 11 = 10 then 'semantic_view' when n_nationkey % 2 = 0 then 'view' else 'table' end as materialization
from nation""",
    "e_sources": """
select 'source.shop.raw.r' || r_regionkey as node_id, 'r' || r_regionkey as name, 'ANALYTICS' as db, 'RAW' as schema_name, r_regionkey as k from region""",
    "e_columns": """
select m.node_id || '::c_' || c.c_custkey as node_id, m.node_id as owner_id, 'c_' || c.c_custkey as name, c.c_custkey as k,
       case when c.c_custkey % 4 = 0 then null when c.c_custkey % 4 = 1 then 'NUMBER' else 'VARCHAR' end as data_type
from customer c join e_models m on m.k = c.c_nationkey
union all
select m.node_id || '::e' || ((m.k + o.o) % 25) || '_id', m.node_id, 'e' || ((m.k + o.o) % 25) || '_id', cast(null as bigint), 'NUMBER'
from e_models m cross join (select 0 as o union all select 1 union all select 5) o
union all
select s.node_id || '::s_' || p.s_suppkey, s.node_id, 's_' || p.s_suppkey, cast(null as bigint), 'NUMBER'
from supplier p join nation n on n.n_nationkey = p.s_nationkey join e_sources s on s.k = n.n_regionkey""",
    "e_feeds": """
select a.node_id as f, b.node_id as t, 'feeds' as edge_type, case when b.k % 10 < 6 then 'exact' when b.k % 10 < 9 then 'parsed' else 'inferred' end as confidence
from e_columns b join e_columns a on a.k = cast(floor(b.k / 2) as bigint) where b.k > 0
union
select a.node_id, b.node_id, 'feeds', 'parsed' from e_columns b join e_columns a on a.k = cast(floor(b.k / 3) as bigint)
where b.k > 0 and cast(floor(b.k / 3) as bigint) <> cast(floor(b.k / 2) as bigint)
union
select a.node_id, b.node_id, 'feeds', 'exact' from e_columns a join e_columns b on a.name = 's_' || b.k where b.k < 10""",
    "e_references": """
select distinct ma.node_id as f, mb.node_id as t, 'references' as edge_type, 'exact' as confidence
from e_feeds e join e_columns a on a.node_id = e.f join e_columns b on b.node_id = e.t
join e_models ma on ma.node_id = a.owner_id join e_models mb on mb.node_id = b.owner_id where mb.k between ma.k + 1 and ma.k + 3
union
select distinct sa.node_id, b.owner_id, 'references', 'exact'
from e_feeds e join e_columns a on a.node_id = e.f join e_columns b on b.node_id = e.t join e_sources sa on sa.node_id = a.owner_id""",
    "e_fields": """
select 'mb_field::' || p_partkey as node_id, p_partkey as field_id, 'Warehouse' as bi_db, m.schema_name, m.name as table_name,
       case p_partkey % 5 when 0 then upper('c_' || p_partkey) when 1 then 'c' || p_partkey else 'c_' || p_partkey end as column_name,
       case when p_partkey % 3 = 0 then 'NUMBER(38,0)' end as database_type, 'type/Text' as base_type,
       case when p_partkey % 7 = 0 then cast(floor(p_partkey / 2) as bigint) end as fk_target_field_id
from part p join customer c on c.c_custkey = p.p_partkey join e_models m on m.k = c.c_nationkey""",
    "e_cards": """
select 'mb_card::' || o_orderkey as node_id, o_orderkey as card_id, 'Card ' || o_orderpriority || ' ' || o_orderkey as name,
       o_orderstatus = 'P' as archived, o_custkey % 20 as collection_id, 'user' || (o_custkey % 50) as creator,
       case when o_orderkey % 13 = 0 then 'native' else 'query' end as query_type,
       case when o_orderkey % 3 = 1 then cast(floor(o_orderkey / 3) as bigint) end as source_card_id
from orders""",
    "e_consumed": """
select distinct l_partkey as field_id, l_orderkey as card_id,
       case l_linenumber when 1 then 'fields' when 2 then 'breakout' when 3 then 'aggregation' when 4 then 'filter' else 'order-by' end as clause,
       l_returnflag = 'R' as implicit_join
from lineitem""",
    "e_dashcards": """
select 'mb_dash::' || (extract(year from o_orderdate) * 10 + cast(substr(o_orderpriority, 1, 1) as int)) as dash_id, o_orderkey as card_id, o_orderkey as dashcard_id from orders where o_orderkey % 4 <> 3""",
    "e_binds": """
select c.node_id as f, f.node_id as t, 'binds_to' as edge_type, case when lower(c.name) = lower(f.column_name) then 'exact' else 'fuzzy' end as confidence
from e_fields f join e_models m on m.schema_name = f.schema_name and m.name = f.table_name
join e_columns c on c.owner_id = m.node_id and replace(lower(c.name), '_', '') = replace(lower(f.column_name), '_', '')""",
    "e_uses": """
select distinct 'mb_field::' || u.field_id as f, 'mb_card::' || u.card_id as t, 'consumed_by' as edge_type, case when k.query_type = 'native' then 'parsed' else 'exact' end as confidence
from e_consumed u join e_cards k on k.card_id = u.card_id join e_fields f on f.field_id = u.field_id""",
    "e_relates": """
select c.node_id as f, t.node_id as t, 'relates_to' as edge_type, case when m.k % 3 = 0 then 'validated' else 'declared' end as confidence
from e_columns c join e_models m on c.owner_id = m.node_id join e_models tm on c.name = 'e' || tm.k || '_id' and tm.k % 5 = 0 and tm.node_id <> m.node_id
join e_columns t on t.owner_id = tm.node_id and t.name = c.name""",
    "e_flow": """
select f, t, edge_type, confidence from e_feeds
union all select f, t, edge_type, confidence from e_references
union all select f, t, edge_type, confidence from e_binds
union all select f, t, edge_type, confidence from e_uses
union all select distinct 'mb_card::' || card_id, dash_id, 'appears_on', 'exact' from e_dashcards""",
    "e_edges": """
select f, t, edge_type, confidence from e_flow union all select f, t, edge_type, confidence from e_relates""",
    "e_nodes": """
select node_id, 'model' as node_type, name, cast(null as string) as owner_id, db, schema_name, name as table_name, cast(null as string) as data_type,
       cast(null as boolean) as archived, cast(null as string) as creator, cast(null as bigint) as collection_id, package, materialization, 'Model ' || name as description from e_models
union all select node_id, 'source', name, null, db, schema_name, name, null, null, null, null, 'shop', null, null from e_sources
union all select c.node_id, 'column', c.name, c.owner_id, 'ANALYTICS', coalesce(m.schema_name, 'RAW'), coalesce(m.name, s.name), c.data_type, null, null, null, null, null, case when c.k % 6 = 0 then 'Key of ' || c.name end
  from e_columns c left join e_models m on m.node_id = c.owner_id left join e_sources s on s.node_id = c.owner_id
union all select node_id, 'mb_field', column_name, null, bi_db, schema_name, table_name, database_type, null, null, null, null, null, null from e_fields
union all select node_id, 'mb_card', name, null, null, null, null, null, archived, creator, collection_id, null, null, null from e_cards
union all select distinct dash_id, 'mb_dashboard', 'Board ' || substr(dash_id, 10), null, null, null, null, null, dash_id like '%5', null, cast(3 as bigint), null, null, null from e_dashcards""",
    "e_base": "select node_id, owner_id, name, data_type from e_columns",
    "e_cand": """
select node_id, owner_id, name, case when k % 13 = 0 then 'TEXT' else data_type end as data_type from e_columns where k is null or k % 17 <> 3
union all select owner_id || '::new_' || k, owner_id, 'new_' || k, 'NUMBER' from e_columns where k % 19 = 0""",
    "e_proj": """
select b.owner_id as model, b.name as output, row_number() over (partition by b.owner_id order by b.k, b.name, e.f) as ordinal,
       case when b.k % 23 = 0 then null else a.owner_id end as leaf_owner, case when b.k % 23 = 0 then null else a.name end as leaf_column,
       case e.confidence when 'exact' then 'column' when 'parsed' then 'expression' else 'star' end as kind, b.k as k
from e_feeds e join e_columns a on a.node_id = e.f join e_columns b on b.node_id = e.t""",
    "e_entities": """
select node_id as uid, 'model' as kind, name, db, schema_name, name as tbl, k % 7 = 6 as is_ephemeral, cast(k as bigint) as ordinal, package, materialization, 'models/' || name || '.sql' as path, 'tier' || (k % 3) as tag,
       case when k % 5 = 4 then ' ' when k % 6 = 5 then null else 'select 1' end as compiled from e_models
union all select node_id, 'source', name, db, schema_name, name, false, cast(1000 + k as bigint), 'shop', null, 'models/raw.yml', null, null from e_sources
union all select 'source.shop.dup.' || name, 'source', name, lower(db), schema_name, upper(name), false, cast(2000 + k as bigint), 'shop', null, 'models/dup.yml', null, null from e_models where k % 8 = 3""",
    "e_catalog": """
select owner_id as uid, upper(name) as col, coalesce(data_type, 'VARIANT') as dtype, coalesce(k, 0) as ordinal from e_columns where coalesce(k, 1) % 5 <> 2 and owner_id not like '%4s'""",
    "e_docs": """
select owner_id as uid, case when k % 9 = 0 then 'C_' || k when k % 14 = 2 then 'Extra' || k else name end as col, 'doc ' || name as description, coalesce(k, 0) as ordinal from e_columns where coalesce(k, 0) % 2 = 0""",
    "e_pj": """
select b.owner_id as model, b.name as output, b.k as ordinal, case e.confidence when 'exact' then 'column' when 'parsed' then 'expression' else 'star' end as kind, e.confidence = 'inferred' as is_star, b.k % 23 = 0 as failed, b.k % 46 = 0 as is_explicit,
       case when b.k % 23 = 0 then null when b.k % 29 = 0 then 'EXT' else o.schema_name end as leaf_schema, case when b.k % 23 = 0 then null when b.k % 29 = 0 then 'elsewhere' when b.k % 3 = 0 then upper(o.name) else o.name end as leaf_table,
       case when b.k % 23 = 0 then null when b.k % 31 = 0 then '*' else a.name end as leaf_column, e.f as leaf_id
from e_feeds e join e_columns a on a.node_id = e.f join e_columns b on b.node_id = e.t join e_nodes o on o.node_id = a.owner_id""",
    "e_declared": """
select 'model' as src, k as ordinal, node_id as model, 'e' || k || '_id' as col, case when k % 6 = 0 then '' when k % 4 = 1 then 'S' || ((k + 1) % 5) || '.' || 'none' when k % 4 = 2 then name else case (k + 5) % 25 % 4 when 0 then 'stg_' when 1 then 'int_' when 2 then 'fct_' else 'dim_' end || 'e' || ((k + 5) % 25) || 's' end as target,
       case when k % 3 = 0 then null else 'e' || ((k + 5) % 25) || '_id' end as field from e_models""",
    "e_slots": """
select k.card_id, k.query_type, max(case when clause = 'fields' then field_id end) as a, max(case when clause = 'breakout' then field_id end) as b, max(case when clause = 'aggregation' then field_id end) as g,
       max(case when clause = 'filter' then field_id end) as w, max(case when clause = 'order-by' then field_id end) as o, max(k.source_card_id) as source_card_id
from e_cards k left join e_consumed u on u.card_id = k.card_id group by k.card_id, k.query_type""",
    "e_cardq": """
select card_id, query_type, case
  when query_type = 'native' then '{"type":"native","native":{"query":"select 1"}}'
  when card_id % 11 = 0 then '{}'
  when card_id % 5 = 0 then '{"lib/type":"mbql/query","stages":[{' || coalesce('"source-card":' || source_card_id, '"source-table":' || (card_id % 30)) || ',"fields":[["field",{"lib/uuid":"u"},' || coalesce(a, 1) || ']],"filters":[["=",{},["field",{"source-field":' || (card_id % 50) || '},' || coalesce(w, 2) || '],1]]},{"breakout":[["field",{"base-type":"type/Text"},"c_' || (card_id % 90) || '"]],"joins":[{"alias":"J","conditions":[["=",{},["field",{},' || coalesce(b, 3) || '],["field",{"join-alias":"J"},' || coalesce(o, 4) || ']]]}]}]}'
  else '{"type":"query","query":{"source-table":' || coalesce('"card__' || source_card_id || '"', cast(card_id % 30 as string)) || ',"fields":[["field",' || coalesce(a, 1) || ',null]],"filter":["and",["=",["field",' || coalesce(w, 2) || ',{"source-field":' || (card_id % 50) || '}],1],[">",["field","c_' || (card_id % 90) || '",{"base-type":"type/Integer"}],2]],"aggregation":[["count"],["sum",["field",' || coalesce(g, 5) || ',null]],["metric",' || (card_id % 40) || ']],"order-by":[["asc",["field",' || coalesce(o, 99999) || ',null]]],"joins":[{"alias":"J1","source-table":3,"condition":["=",["field",' || coalesce(b, 3) || ',null],["field","c_' || (card_id % 70) || '",{"join-alias":"J1"}]]},{"alias":"J2","source-table":"card__' || (card_id % 60) || '","condition":["=",["field","c_2",{"join-alias":"J2"}],["field",7,{"join-alias":"J1"}]]}]'
    || case when card_id % 4 = 0 then ',"source-query":{"source-table":' || (card_id % 25) || ',"joins":[{"alias":"J1","source-table":' || (card_id % 11) || ',"condition":["=",["field","c_' || (card_id % 70) || '",{"join-alias":"J1"}],3]}],"filter":["=",["field",' || coalesce(a, 1) || ',null],3]}' else '' end || '}}' end as dataset_query
from e_slots""",
    "e_deps": """
select card_id, source_card_id as upstream, '1' as ord from e_cards where source_card_id is not null
union all select card_id, card_id % 40, '2' from e_cards where card_id % 5 = 0
union all select card_id, card_id + 1, '0' from e_cards where card_id % 64 = 1
union all select card_id, card_id - 1, '3' from e_cards where card_id % 64 = 2""",
    "e_tables": "select distinct k as table_id, name as table_name, schema_name, 1 as db_id from e_models union all select 100 + k, name, 'OTHER', 1 from e_models where k % 6 = 0",
    "e_collections": """
select c as collection_id, case when c % 7 = 6 then 'Home ' || c else 'Team ' || c end as name, case when c < 5 then '/' when c < 12 then '/' || (c % 5) || '/' else '/' || (c % 5) || '/' || (5 + c % 7) || '/' || case when c = 19 then '999/' else '' end end as location, c % 7 = 6 as personal
from (select distinct collection_id as c from e_cards) x""",
    "e_native": """
select card_id, 'select a.c_' || card_id || ' from ' || case card_id % 3 when 0 then 'S1.' || 'stg_e' || (card_id % 25) || 's' when 1 then 'fct_e' || (card_id % 25) || 's a' else 'nowhere' end || ' join {{#' || (card_id % 900) || '-top-cards}} q on true where {{region}} [[and {{ since }} > 1]] and {{ pick}} = 2 and {{snippet: part ' || (card_id % 4) || '}} and x = {{n}} and {{#' || (card_id % 77) || '}} is null' as sql from e_cards where query_type = 'native'""",
    "e_tags": """
select card_id, 'region' as tag, 'dimension' as kind, card_id % 3000 as field_id, cast(null as bigint) as ref_card from e_cards where query_type = 'native' union all select card_id, 'since', 'date', null, null from e_cards where query_type = 'native'
union all select card_id, 'n', 'number', null, null from e_cards where query_type = 'native' union all select card_id, 'pick', 'card', null, card_id % 60 from e_cards where query_type = 'native' and card_id % 2 = 0""",
    "e_snippets": "select r_regionkey as snippet_id, 'part ' || r_regionkey as name, 'p' || r_regionkey || ' = 1' || case when r_regionkey < 3 then ' and {{snippet: part ' || (r_regionkey + 1) || '}}' when r_regionkey = 3 then ' and {{snippet: missing}}' else '' end as content from region",
    "e_staged": """
select event_id as seq, cast(user_id as string) || '.' || event_type as id, user_id, event_type, ts, value,
       case when event_id % 3 = 0 then 'many_to_one' else 'one_to_one' end as cardinality, 'text ' || event_id as body from events""",
    "e_commits": """
select event_id as sha, lag(event_id) over (partition by user_id order by event_id) as first_parent, event_type = 'purchase' as stored, user_id from events""",
}

#: Views from which several others read.
KEPT = ("e_columns", "e_feeds", "e_flow", "e_nodes")

#: Bytes in memory, about, for a byte in a compressed file, as keys in a hash table. Spark compares
#: file sizes with its bound for broadcasts, a few columns of a wide file by their share, so that
#: keys of millions of rows pass for a few MB and are built on the driver.
UNPACKED = 16

_NAME = re.compile(r"\be_\w+\b")
_SOURCE = re.compile(rf"\b(?:e_\w+|{'|'.join(TABLES)})\b")


def with_views(body: str) -> str:
    """``body`` as one statement, with the views that it needs in front."""
    need, todo = set(), _NAME.findall(body)
    while todo:
        name = todo.pop()
        if name in VIEWS and name not in need:
            need.add(name)
            todo += _NAME.findall(VIEWS[name])
    views = ", ".join(f"{n} as ({VIEWS[n]}\n)" for n in VIEWS if n in need)
    body = body.strip()
    if m := re.match(r"with\s+(recursive\s+)?", body, re.I):
        body = body[m.end() :]
        return f"with recursive {views}{', ' if views else ''}{body}"
    return f"with recursive {views} {body}" if views else body


class Estate:
    """The views of one folder of tables as DataFrames: ``estate.edges`` is view ``e_edges``.

    Only what is asked for is defined. Views in ``KEPT``, on which many others
    build, are written once, so plans above them start from files.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(UNPACKED))
        self._ready: dict[str, DataFrame] = {}

    def _define(self, text: str) -> None:
        for name in dict.fromkeys(_SOURCE.findall(text)):
            if name in self._ready or (name not in VIEWS and name not in TABLES):
                continue
            if name in TABLES:
                found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._define(VIEWS[name])
                found = self.spark.sql(VIEWS[name])
            self._ready[name] = settled(found) if name in KEPT else found
            self._ready[name].createOrReplaceTempView(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        view = f"e_{name}" if f"e_{name}" in VIEWS else name
        self._define(view)
        return self._ready[view]

    def sql(self, text: str) -> DataFrame:
        """A projection of the views that stands in for an input table."""
        self._define(text)
        return self.spark.sql(text)
