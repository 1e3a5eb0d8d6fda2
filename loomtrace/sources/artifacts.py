"""Reading project artifacts and BI snapshots as tables, and writing the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_COLUMN = "struct<name:string,description:string,data_type:string,meta:map<string,string>,config:struct<meta:map<string,string>>,constraints:array<struct<type:string,`to`:string,to_columns:array<string>,expression:string>>>"
_ENTITY = (
    "struct<resource_type:string,name:string,alias:string,identifier:string,source_name:string,database:string,schema:string,description:string,tags:array<string>,meta:map<string,string>,"
    "config:struct<materialized:string,meta:map<string,string>>,original_file_path:string,package_name:string,depends_on:struct<nodes:array<string>>,compiled_code:string,compiled_sql:string,"
    f"columns:map<string,{_COLUMN}>,test_metadata:struct<name:string,kwargs:map<string,string>>,attached_node:string,column_name:string>"
)
MANIFEST = f"metadata struct<project_name:string,adapter_type:string,invocation_id:string>, nodes map<string,{_ENTITY}>, sources map<string,{_ENTITY}>"
_RELATION = "struct<metadata:struct<database:string,schema:string,name:string,type:string,owner:string>,columns:map<string,struct<name:string,type:string,index:int,comment:string>>>"
CATALOG = f"nodes map<string,{_RELATION}>, sources map<string,{_RELATION}>"
_FIELD = "struct<id:bigint,name:string,display_name:string,base_type:string,database_type:string,semantic_type:string,fk_target_field_id:bigint,visibility_type:string,description:string>"
_DASHCARD = "struct<id:bigint,card_id:bigint,parameter_mappings:string>"
#: Parts of a BI snapshot: file name pattern and schema. A list may be wrapped in ``data``.
BI = {
    "databases": ("databases.json", "id bigint, name string, engine string, is_sample boolean, details struct<db:string>"),
    "tables": ("database_metadata_*.json", f"id bigint, name string, tables array<struct<id:bigint,name:string,schema:string,fields:array<{_FIELD}>>>"),
    "cards": ("cards*.json", "id bigint, name string, description string, collection_id bigint, archived boolean, display string, updated_at string, creator struct<id:bigint,common_name:string,email:string>, dataset_query string, result_metadata string"),
    "dashboards": ("dashboard_*.json", f"id bigint, name string, collection_id bigint, archived boolean, dashcards array<{_DASHCARD}>, ordered_cards array<{_DASHCARD}>"),
    "collections": ("collections.json", "id bigint, name string, location string, personal_owner_id bigint"),
    "snippets": ("snippets.json", "id bigint, name string, content string"),
}


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def _there(spark: SparkSession, path: str) -> bool:
    """Whether any file or folder fits ``path``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return len(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place) or []) > 0


def _entries(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.explode(name).alias("uid", "e")).where("e is not null")


def _merged(a: Column, b: Column) -> Column:
    """Two maps, the second over the first."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def read_manifests(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``models``, ``sources``, ``tests``, ``doc_columns`` and ``depends_on`` of the manifests at ``path``.

    A physical table is the alias, else the identifier, else the name; ``config.meta`` lies over ``meta``.
    """
    manifest = _json(spark, path, MANIFEST)
    nodes, sources = _entries(manifest, "nodes"), _entries(manifest, "sources")
    table = F.coalesce("e.alias", "e.identifier", "e.name")
    shared = ["uid", F.col("e.name").alias("name"), F.col("e.database").alias("db"), F.col("e.schema").alias("schema_name"), table.alias("tbl"), "e.description", "e.tags", _merged(F.col("e.meta"), F.col("e.config.meta")).alias("meta"), F.col("e.original_file_path").alias("path")]
    models = nodes.where("e.resource_type = 'model'").select(*shared, F.col("e.config.materialized").alias("materialization"), (F.col("e.config.materialized") == "ephemeral").alias("is_ephemeral"), F.coalesce("e.compiled_code", "e.compiled_sql").alias("compiled"))
    kept = nodes.where("e.resource_type = 'model'").union(sources)
    columns = kept.select("uid", F.explode("e.columns").alias("key", "c"))
    doc = columns.select("uid", F.coalesce("c.name", "key").alias("col"), "c.description", F.col("c.data_type").alias("dtype"), _merged(F.col("c.meta"), F.col("c.config.meta")).alias("meta"), "c.constraints")
    tests = nodes.where("e.resource_type = 'test'").select(F.col("uid").alias("test_id"), F.col("e.test_metadata.name").alias("kind"), F.col("e.test_metadata.kwargs").alias("kwargs"), F.col("e.attached_node").alias("attached"), F.col("e.column_name").alias("col"), F.col("e.depends_on.nodes").alias("deps"))
    deps = nodes.where("e.resource_type = 'model'").select(F.col("uid").alias("model"), F.explode("e.depends_on.nodes").alias("upstream"))
    return {"models": models, "sources": sources.select(*shared, F.col("e.source_name").alias("source_name")), "tests": tests, "doc_columns": doc, "depends_on": deps}


def read_catalogs(spark: SparkSession, path: str) -> DataFrame:
    """(uid, col, warehouse_name, dtype, ordinal) of every column in the catalogs at ``path``."""
    catalog = _json(spark, path, CATALOG)
    both = _entries(catalog, "nodes").union(_entries(catalog, "sources"))
    name = F.coalesce("c.name", "key")
    return both.select("uid", F.explode("e.columns").alias("key", "c")).select("uid", F.lower(name).alias("col"), name.alias("warehouse_name"), F.col("c.type").alias("dtype"), F.col("c.index").alias("ordinal"))


def read_bi_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``databases``, ``tables``, ``fields``, ``cards``, ``dashboards``, ``dashcards``, ``collections`` and ``snippets`` of a snapshot folder.

    Entries without an id are passed over, and a part without a file is empty. ``dataset_query`` and ``result_metadata`` stay text, to be parsed by the operators.
    """
    parts = {}
    for name, (pattern, schema) in BI.items():
        if not _there(spark, f"{path}/{pattern}"):
            parts[name] = spark.createDataFrame([], schema)
            continue
        rows = _json(spark, f"{path}/{pattern}", f"{schema}, data array<struct<{_typed(schema)}>>")
        flat = rows.where("data is not null").select(F.inline("data"))
        parts[name] = rows.drop("data").unionByName(flat).where("id is not null")
    databases = parts["databases"].select(F.col("id").alias("database_id"), F.col("name").alias("bi_db"), "engine", F.coalesce("is_sample", F.lit(False)).alias("is_sample"), F.col("details.db").alias("warehouse_db"))
    held = parts["tables"].select(F.col("id").alias("database_id"), F.col("name").alias("own"), F.explode("tables").alias("t"))
    # A table's database goes by the name in the list of databases, else by its own.
    tables = held.join(databases.select("database_id", "bi_db"), "database_id", "left").select("database_id", F.coalesce("bi_db", "own").alias("bi_db"), "t")
    dashcards = parts["dashboards"].select(F.col("id").alias("dash_id"), F.explode(F.coalesce("dashcards", "ordered_cards")).alias("d"))
    return {
        "databases": databases,
        "tables": tables.select("database_id", "bi_db", F.col("t.id").alias("table_id"), F.col("t.name").alias("table_name"), F.col("t.schema").alias("schema_name")),
        "fields": tables.select("database_id", "bi_db", F.col("t.id").alias("table_id"), F.col("t.name").alias("table_name"), F.col("t.schema").alias("schema_name"), F.inline("t.fields")),
        "cards": parts["cards"], "dashboards": parts["dashboards"].drop("dashcards", "ordered_cards"), "collections": parts["collections"], "snippets": parts["snippets"],
        "dashcards": dashcards.select("dash_id", F.col("d.id").alias("dashcard_id"), F.col("d.card_id").alias("card_id"), F.col("d.parameter_mappings").alias("mappings")),
    }


def _typed(schema: str) -> str:
    """A column list as the fields of a struct."""
    fields, start, depth = [], 0, 0
    for i, ch in enumerate(schema + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            fields.append(":".join(schema[start:i].strip().split(" ", 1)))
            start = i + 1
    return ",".join(fields)


def latest_payload(runs: DataFrame) -> DataFrame:
    """Each estate's newest usable run."""
    return runs.where("usable").groupBy("estate").agg(F.max_by("run_id", "ts").alias("run_id"), F.max("ts").alias("ts"))


def prune_payloads(runs: DataFrame, retain: int = 3) -> DataFrame:
    """Each estate's newest ``retain`` runs."""
    return runs.withColumn("k", F.row_number().over(Window.partitionBy("estate").orderBy(F.desc("ts"), F.desc("run_id")))).where(F.col("k") <= retain).drop("k")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Both tables as Parquet in their canonical order, in ranges of the sort key; ``by`` names partition columns."""
    for name, df, key in (("nodes", nodes, ["node_id"]), ("edges", edges, ["f", "t", "edge_type"])):
        keys = [*(by or []), *key]
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(*(by or [])).parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def export_jsonl(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON object a line, nulls left out, nodes before edges in their order."""
    nodes.orderBy("node_id").write.mode("overwrite").option("ignoreNullFields", True).json(f"{path}/nodes")
    edges.orderBy("f", "t", "edge_type").write.mode("overwrite").option("ignoreNullFields", True).json(f"{path}/edges")
