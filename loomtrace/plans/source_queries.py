"""Queries of reading artifacts and of keeping graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators import staging
from loomtrace.plans.closure import run_folder
from loomtrace.plans.estate import Estate
from loomtrace.plans.suite import Suite
from loomtrace.sources import artifacts, history

suite = Suite()


def _folder(e: Estate, name: str) -> str:
    return f"{run_folder(e.spark)}/{name}-{uuid.uuid4().hex}"


#: Entries of one artifact file; an artifact is one JSON object, which one task reads.
FILE_ENTRIES = 200


def _files(df: DataFrame, key: str) -> DataFrame:
    """``df`` with a file number each, for files of about ``FILE_ENTRIES`` rows however many there are."""
    return df.withColumn("file", F.pmod(F.xxhash64(key), F.lit(-(-df.count() // FILE_ENTRIES) or 1)))


def _manifest(e: Estate) -> str:
    """Manifests of bounded size, written by Spark from the estate."""
    path = _folder(e, "manifest")
    cols = e.docs.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct(F.col("col").alias("name"), "description")))).alias("columns"))
    one = F.struct(F.col("kind").alias("resource_type"), "name", F.col("tbl").alias("alias"), F.col("db").alias("database"), F.col("schema_name").alias("schema"), F.col("compiled").alias("compiled_code"), "columns", F.struct(F.col("materialization").alias("materialized")).alias("config"))
    both = _files(e.entities, "uid").join(cols, "uid", "left").groupBy("file").agg(*(F.map_from_entries(F.collect_list(F.when(F.col("kind") == k, F.struct("uid", one)))).alias(n) for k, n in (("model", "nodes"), ("source", "sources"))))
    both.write.partitionBy("file").option("maxRecordsPerFile", 1).json(path)  # an artifact is one object in a file of its own
    return path


@suite("a1_read_manifests", "select uid, col, description from e_docs join e_entities using (uid)")
def _(e: Estate) -> DataFrame:
    return artifacts.read_manifests(e.spark, _manifest(e))["doc_columns"].select("uid", "col", "description")


@suite("a1_manifest_models", "select uid, name, db, schema_name, tbl, coalesce(materialization, '') as materialization from e_entities where kind = 'model'")
def _(e: Estate) -> DataFrame:
    return artifacts.read_manifests(e.spark, _manifest(e))["models"].select("uid", "name", "db", "schema_name", "tbl", F.coalesce("materialization", F.lit("")).alias("materialization"))


@suite("a2_read_catalogs", "select uid, lower(col) as col, col as warehouse_name, dtype from e_catalog")
def _(e: Estate) -> DataFrame:
    path = _folder(e, "catalog")
    rel = e.catalog.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct(F.col("col").alias("name"), F.col("dtype").alias("type"))))).alias("columns"))
    _files(rel, "uid").groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("uid", F.struct("columns")))).alias("nodes")).write.partitionBy("file").option("maxRecordsPerFile", 1).json(path)
    return artifacts.read_catalogs(e.spark, path).select("uid", "col", "warehouse_name", "dtype")


def _snapshot(e: Estate) -> dict[str, DataFrame]:
    """A snapshot written from the estate in files of bounded size, and read."""
    path = _folder(e, "snapshot")
    boards = e.dashcards.groupBy(F.substring("dash_id", 10, 20).cast("bigint").alias("id")).agg(F.collect_list(F.struct(F.col("dashcard_id").alias("id"), "card_id")).alias("cards"))
    new = F.col("id") % 2 == 0
    boards.select("id", F.when(new, F.col("cards")).alias("dashcards"), F.when(~new, F.col("cards")).alias("ordered_cards")).write.option("maxRecordsPerFile", 1).json(f"{path}/dashboard_all.json")
    e.sql("select r_regionkey as id, 'W' || r_regionkey as name, 'db' as engine, r_regionkey = 3 as is_sample, named_struct('db', 'ANALYTICS') as details from region where r_regionkey < 4").write.option("maxRecordsPerFile", 1).json(f"{path}/databases.json")
    fields = e.sql("select field_id % 5 as db, table_name, schema_name, field_id as id, column_name as name from e_fields").groupBy("db", "table_name", "schema_name").agg(F.collect_list(F.struct("id", "name")).alias("fields"))
    metadata = _files(fields, "table_name").groupBy("db", "file").agg(F.collect_list(F.struct(F.lit(1).alias("id"), F.col("table_name").alias("name"), F.col("schema_name").alias("schema"), "fields")).alias("tables"))
    metadata.select(F.col("db").alias("id"), F.lit("own").alias("name"), "tables").write.option("maxRecordsPerFile", 1).json(f"{path}/database_metadata_1.json")
    for name, rows in {"cards.json": "select card_id as id, name from e_cards", "collections.json": "select collection_id as id, name, location from e_collections", "snippets.json": "select snippet_id as id, name, content from e_snippets"}.items():
        wrapped = _files(e.sql(rows), "id").groupBy("file").agg(F.collect_list(F.struct("id", "name")).alias("data")).select("data")
        wrapped.write.option("maxRecordsPerFile", 1).json(f"{path}/{name}")
    return artifacts.read_bi_snapshot(e.spark, path)


@suite("a3_read_bi_snapshot", "select dash_id, card_id, dashcard_id from (select cast(substr(dash_id, 10) as bigint) as dash_id, card_id, dashcard_id from e_dashcards)")
def _(e: Estate) -> DataFrame:
    return _snapshot(e)["dashcards"].select("dash_id", "card_id", "dashcard_id")


@suite(
    "a3_bi_fields_and_cards",
    """select 'field' as kind, field_id as id, column_name as name, schema_name || '.' || table_name as place, field_id % 5 as database_id, case when field_id % 5 = 4 then 'own' else 'W' || (field_id % 5) end as bi_db, field_id % 5 = 3 as is_sample from e_fields
    union all select 'card', card_id, name, null, null, null, null from e_cards""",
)
def _(e: Estate) -> DataFrame:
    parts = _snapshot(e)
    fields = parts["fields"].join(parts["databases"].select("database_id", "is_sample"), "database_id", "left")
    fields = fields.select(F.lit("field").alias("kind"), "id", "name", F.concat_ws(".", "schema_name", "table_name").alias("place"), "database_id", "bi_db", F.coalesce("is_sample", F.lit(False)).alias("is_sample"))
    return fields.union(parts["cards"].select(F.lit("card"), "id", "name", *(F.lit(None).cast(t) for t in ("string", "bigint", "string", "boolean"))))


_RUNS = "select user_id as estate, event_id as run_id, ts, event_type <> 'error' as usable from events"


@suite("a4_latest_payload", "select user_id as estate, arg_max(event_id, ts) as run_id, max(ts) as ts from events where event_type <> 'error' group by user_id")
def _(e: Estate) -> DataFrame:
    return artifacts.latest_payload(e.sql(_RUNS))


@suite("a4_prune_payloads", "select user_id as estate, event_id as run_id, ts, event_type <> 'error' as usable from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 3")
def _(e: Estate) -> DataFrame:
    return artifacts.prune_payloads(e.sql(_RUNS))


_GRAPH = "select 'node' as kind, node_id as a, node_type as b, name as c, owner_id as d from e_nodes union all select 'edge', f, t, edge_type, confidence from e_edges"


def _both(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.col("node_type").alias("b"), F.col("name").alias("c"), F.col("owner_id").alias("d")).union(edges.select(F.lit("edge"), "f", "t", "edge_type", "confidence"))


@suite("a5_write_graph", _GRAPH)
def _(e: Estate) -> DataFrame:
    path = _folder(e, "graph")
    artifacts.write_graph(e.nodes, e.edges, path)
    return _both(*artifacts.read_graph(e.spark, path))


#: Twenty-five snapshots of two estates, each without other columns, and one of them stored once more as another.
_SNAPS = """select 'e' || (coalesce(c.k, 0) % 2) as estate_id, 's' || n.n_nationkey as snapshot_id, c.node_id, 'column' as node_type, c.data_type from e_columns c cross join nation n where coalesce(c.k, 1) % 25 <> n.n_nationkey"""
_LINES = """select 'e0' as estate_id, 's' || n.n_nationkey as snapshot_id, r.f, r.t, r.edge_type, r.confidence from e_references r cross join nation n"""
_HEADS = "select 'e' || (r_regionkey) as estate_id, 's' || n_nationkey as snapshot_id, n_nationkey as seq, n_name as sha, '2024-01-01' as generated_at from nation cross join region where r_regionkey < 2"
_AGAIN = """select 'e' || (coalesce(c.k, 0) % 2) as estate_id, 's7' as snapshot_id, c.node_id, 'column' as node_type, c.data_type from e_columns c where coalesce(c.k, 0) % 3 = 0"""
_HEAD7 = "select 'e' || r_regionkey as estate_id, 's7' as snapshot_id, 99 as seq, 'again' as sha, '2024-02-01' as generated_at from region where r_regionkey < 2"


@suite(
    "a5_history",
    f"""with n as (select * from ({_SNAPS}) where snapshot_id <> 's7' union all select * from ({_AGAIN})), m as (select * from ({_LINES}) where snapshot_id <> 's7'),
    h as (select * from ({_HEADS}) where snapshot_id <> 's7' union all select * from ({_HEAD7})),
    b as (select h.*, (select count(*) from n where n.estate_id = h.estate_id and n.snapshot_id = h.snapshot_id) as nodes, (select count(*) from m where m.estate_id = h.estate_id and m.snapshot_id = h.snapshot_id) as edges from h),
    r as (select *, row_number() over (partition by estate_id order by seq desc) as slot from b)
    select estate_id, snapshot_id, seq::bigint as seq, sha, generated_at, nodes, edges, 0::bigint as traced, nodes as total, slot::int as slot, lead(snapshot_id) over (partition by estate_id order by slot) as previous from r where slot <= 20""",
)
def _(e: Estate) -> DataFrame:
    path = _folder(e, "history")
    history.store(e.sql(_SNAPS), e.sql(_LINES), e.sql(_HEADS), path)
    history.store(e.sql(_AGAIN), e.sql(_LINES).limit(0), e.sql(_HEAD7), path)
    history.drop_old(e.spark, path)
    return history.ranked(history.read_builds(e.spark, path))


@suite(
    "f7_read_previous",
    f"select node_id, node_type, data_type from ({_SNAPS}) where snapshot_id = 's23' and estate_id = 'e1'",
)
def _(e: Estate) -> DataFrame:
    path = _folder(e, "previous")
    history.store(e.sql(_SNAPS), e.sql(_LINES), e.sql(_HEADS), path)
    return history.read_previous(e.spark, path, "e1", "s24")[0].select("node_id", "node_type", "data_type")


@suite("a6_export_jsonl", _GRAPH)
def _(e: Estate) -> DataFrame:
    path = _folder(e, "jsonl")
    artifacts.export_jsonl(e.nodes, e.edges, path)
    return _both(e.spark.read.schema("node_id string, node_type string, name string, owner_id string").json(f"{path}/nodes"), e.spark.read.schema("f string, t string, edge_type string, confidence string").json(f"{path}/edges"))


@suite("a7_read_dismissed", "select distinct cast(user_id as string) || '.' || event_type as id from events where event_type in ('error', 'view')")
def _(e: Estate) -> DataFrame:
    return staging.read_dismissed(e.sql("select case when event_type in ('error', 'view') then cast(user_id as string) || '.' || event_type end as id from events"))
