"""Binding columns to BI fields, and data types that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of bindings that differ in case above which that is the norm.
NORM = 0.9


def _squash(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("_"), F.lit(""))


def _tables(relations: DataFrame, db_map: DataFrame) -> DataFrame:
    """Relations under their BI database's name; the first relation of a key wins."""
    held = relations.join(db_map.select("bi_db", "dbt_db").distinct(), F.lower("db") == F.lower("dbt_db")).select("uid", F.lower("bi_db").alias("b"), F.lower("schema_name").alias("s"), F.lower("tbl").alias("t"), "ordinal", F.col("schema_name").alias("rel_schema"), F.col("tbl").alias("rel_table"))
    return held.withColumn("_k", F.row_number().over(Window.partitionBy("b", "s", "t").orderBy("ordinal", "uid"))).where("_k = 1").drop("_k")


def field_relations(fields: DataFrame, relations: DataFrame, db_map: DataFrame) -> DataFrame:
    """Fields with the relation that their table stands for and the prefix that had to be stripped, if any.

    ``db_map(bi_db, dbt_db, prefix)`` names the project's database behind a BI database,
    and the prefix, if any, that its tables bear in the project only. A plain match of
    the table wins; else the project's table is that prefix and the BI table's name.
    """
    keyed = fields.withColumns({"b": F.lower("bi_db"), "s": F.lower("schema_name"), "t": F.lower("table_name")})
    tables = _tables(relations, db_map)
    plain = keyed.join(tables, ["b", "s", "t"]).withColumn("prefix", F.lit(None).cast("string"))
    left = keyed.join(tables, ["b", "s", "t"], "left_anti")
    marks = db_map.where("prefix <> ''").groupBy(F.lower("bi_db").alias("b")).agg(F.min("prefix").alias("prefix"))
    tried = left.join(marks, "b").withColumn("t", F.concat(F.lower("prefix"), "t"))
    return plain.unionByName(tried.join(tables, ["b", "s", "t"]).select(plain.columns))


def bind_exact(matched: DataFrame, columns: DataFrame) -> DataFrame:
    """(col_id, field, field_id, confidence, prefix, case_mismatch): equal names without regard to case."""
    c = columns.select("node_id", "owner_id", "name", F.coalesce("warehouse_name", "name").alias("spelt"), F.lower("name").alias("low"))
    rows = matched.join(c, (F.col("uid") == F.col("owner_id")) & (F.lower("column_name") == F.col("low")))
    odd = (F.col("schema_name") != F.col("rel_schema")) | (F.col("prefix").isNull() & (F.col("table_name") != F.col("rel_table"))) | (F.col("column_name") != F.col("spelt"))
    return rows.select(F.col("node_id").alias("col_id"), "field", "field_id", F.lit("exact").alias("confidence"), "prefix", odd.alias("case_mismatch"))


def bind_fuzzy(matched: DataFrame, exact: DataFrame, columns: DataFrame) -> DataFrame:
    """(col_id, field, field_id, confidence, prefix): equal but for case and underscores, in the same table, and the only one so."""
    c = columns.select("node_id", "owner_id", _squash(F.col("name")).alias("flat"))
    rows = matched.join(exact.select("field_id"), "field_id", "left_anti").join(c, (F.col("uid") == F.col("owner_id")) & (_squash(F.col("column_name")) == F.col("flat")))
    alone = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("field_id"))).where("n = 1")
    return alone.select(F.col("node_id").alias("col_id"), "field", "field_id", F.lit("fuzzy").alias("confidence"), "prefix")


def unverified_fields(matched: DataFrame, columns: DataFrame) -> DataFrame:
    """(uid, fields): fields of relations of which no column is known; they are never bound."""
    return matched.join(columns.select(F.col("owner_id").alias("uid")), "uid", "left_anti").groupBy("uid").agg(F.count(F.lit(1)).alias("fields"))


def bind_coverage(models: DataFrame, bound: DataFrame, packages: list[str], pattern: str) -> DataFrame:
    """One row: models bound, not bound and excluded; exclusion by package or name takes models from the total only."""
    out = F.col("package").isin(packages) | F.col("name").rlike(pattern)
    rows = models.join(bound.select("uid").distinct().withColumn("b", F.lit(True)), "uid", "left")
    listed = F.array_join(F.array_sort(F.collect_set(F.when(~out & F.col("b").isNull(), F.col("name")))), ", ")
    return rows.agg(F.count_if(~out).alias("total"), F.count_if(~out & F.col("b").isNotNull()).alias("bound"), F.count_if(out).alias("excluded"), listed.alias("unbound"))


def binding_case_norm(exact: DataFrame) -> DataFrame:
    """One row: exact bindings whose spelling differs, and whether that is the norm or a warning."""
    share = F.col("mismatches") / F.col("bindings")
    return exact.agg(F.count(F.lit(1)).alias("bindings"), F.count_if("case_mismatch").alias("mismatches")).withColumn("verdict", F.when(F.col("mismatches") == 0, "none").when(share > NORM, "norm").otherwise("warning"))


def type_waterfall(columns: DataFrame, bindings: DataFrame, fields: DataFrame, inferred: DataFrame) -> DataFrame:
    """(node_id, data_type, source, unknown_type_reason): the column's own type, else that of the first exactly bound field with one, else an inferred one.

    The reason why a type is unknown stays only where none is found; columns without that property have none.
    """
    typed = fields.select(F.col("node_id").alias("field"), F.coalesce(F.when(F.trim("database_type") != "", F.col("database_type")), "base_type").alias("t")).where("t is not null")
    bound = bindings.where("confidence = 'exact'").join(typed, "field").groupBy(F.col("col_id").alias("node_id")).agg(F.min_by("t", "field").alias("bound"))
    rows = columns.join(bound, "node_id", "left").join(inferred.select("node_id", F.col("data_type").alias("guess")), "node_id", "left")
    source = F.when(F.col("data_type").isNotNull(), "catalog").when(F.col("bound").isNotNull(), "metabase").when(F.col("guess").isNotNull(), "inferred")
    why = F.col("unknown_type_reason") if "unknown_type_reason" in columns.columns else F.lit(None).cast("string")
    return rows.select("node_id", F.coalesce("data_type", "bound", "guess").alias("data_type"), source.alias("source"), F.when(source.isNull(), why).alias("unknown_type_reason"))


def type_source_counts(typed: DataFrame) -> DataFrame:
    return typed.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
