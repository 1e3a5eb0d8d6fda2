"""The staged change log: what is staged now, whether it is valid, and the graph with it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.text import joined, short_hash

CARDINALITIES = ("many_to_one", "one_to_one", "one_to_many", "many_to_many")


def stage_relationships(log: DataFrame) -> DataFrame:
    """The first write of each id."""
    return log.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).where("_k = 1").drop("_k")


def stage_descriptions(log: DataFrame) -> DataFrame:
    """(id, entity, column, text): the last write for each entity and column."""
    last = log.groupBy("entity", "column").agg(F.max_by("text", "seq").alias("text"))
    return last.select(short_hash(F.concat(F.lit("description:"), "entity", F.lit("."), "column")).alias("id"), "entity", "column", "text")


def replace_staged(state: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, body, created_at) after ``edits(old_id, id, body)``: an edited entry moves and keeps its date; an entry already at the new id wins."""
    moved = edits.join(state.select(F.col("id").alias("old_id"), "created_at"), "old_id").select("id", "body", "created_at", F.lit(1).alias("tier"))
    stay = state.join(edits.select(F.col("old_id").alias("id")), "id", "left_anti").select("id", "body", "created_at", F.lit(0).alias("tier"))
    return stay.union(moved).withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("tier", "created_at", "body"))).where("_k = 1").drop("_k", "tier")


def drop_staged(state: DataFrame, ids: DataFrame) -> DataFrame:
    """The entries whose id is not dropped."""
    return state.join(ids.select("id").distinct(), "id", "left_anti")


def read_staged(relationships: DataFrame, dropped: DataFrame) -> DataFrame:
    """The entries staged now, the first write of each id, without dropped ones."""
    return drop_staged(stage_relationships(relationships), dropped)


def read_dismissed(log: DataFrame) -> DataFrame:
    """The ids of dismissed suggestions, each once; nulls are none. Order them where they are shown."""
    return log.where("id is not null").select("id").distinct()


def validate_staged(entries: DataFrame, models: DataFrame, columns: DataFrame) -> DataFrame:
    """``entries`` with the first reason why each is invalid, or null."""
    names = models.groupBy(F.lower("name").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("uid"))
    cols = columns.select(F.col("owner_id").alias("uid"), F.lower("name").alias("col_low"), F.lit(True).alias("has")).distinct()
    rows = entries
    for end in ("from", "to"):
        rows = rows.withColumn("low", F.lower(f"{end}_model")).join(names, "low", "left").withColumn("col_low", F.lower(f"{end}_column")).join(cols, ["uid", "col_low"], "left")
        rows = rows.withColumnsRenamed({"n": f"{end}_n", "has": f"{end}_has"}).drop("low", "col_low", "uid")
    same = (F.lower("from_model") == F.lower("to_model")) & (F.lower("from_column") == F.lower("to_column"))
    ends = ("from_model", "from_column", "to_model", "to_column")
    blank = reduce(Column.__or__, (F.trim(F.coalesce(c, F.lit(""))) == "" for c in ends))
    reason = (
        F.when(blank, "malformed entry").when(F.col("from_n").isNull() | F.col("to_n").isNull(), "unknown model").when((F.col("from_n") > 1) | (F.col("to_n") > 1), "ambiguous model")
        .when(F.col("from_has").isNull() | F.col("to_has").isNull(), "column not on model").when(~F.coalesce(F.col("cardinality"), F.lit("")).isin(*CARDINALITIES), "bad cardinality").when(same, "identical ends")
    )
    return rows.select(*entries.columns, reason.alias("reason"))


def validate_descriptions(entries: DataFrame, models: DataFrame, columns: DataFrame) -> DataFrame:
    """``entries(id, entity, column, body)`` of staged descriptions with the first reason why each is invalid, or null.

    Blank text comes first, then an unknown or ambiguous entity; without a column the entity itself is described.
    """
    names = models.groupBy(F.lower("name").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("uid"))
    cols = columns.select(F.col("owner_id").alias("uid"), F.lower("name").alias("col_low"), F.lit(True).alias("has")).distinct()
    rows = entries.withColumn("low", F.lower("entity")).join(names, "low", "left").withColumn("col_low", F.lower("column")).join(cols, ["uid", "col_low"], "left")
    blank = F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"\s", "")) == ""
    reason = (
        F.when(F.col("entity").isNull(), "malformed entry").when(blank, "blank text").when(F.col("n").isNull(), "unknown model").when(F.col("n") > 1, "ambiguous model")
        .when(F.col("column").isNotNull() & F.col("has").isNull(), "column not on model")
    )
    return rows.select(*entries.columns, reason.alias("reason"))


def route_models(entries: DataFrame, models: DataFrame, prefixes: list[str]) -> DataFrame:
    """``entries`` with the model that a write goes to: without a presentation prefix where such a model exists."""
    low = F.lower("model")
    bare = F.lit(None).cast("string")
    for p in reversed(prefixes):
        bare = F.when(low.startswith(p), F.expr(f"substring(lower(model), {len(p) + 1})")).otherwise(bare)
    known = models.select(F.lower("name").alias("bare"), F.col("name").alias("routed")).distinct()
    return entries.withColumn("bare", bare).join(known, "bare", "left").select(*entries.columns, F.coalesce("routed", "model").alias("target"))


def staged_edges(entries: DataFrame, models: DataFrame, columns: DataFrame, as_tests: bool) -> DataFrame:
    """(f, t, edge_type, confidence) of entries whose models are named once and whose columns exist."""
    once = models.groupBy(F.lower("name").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("uid")).where("n = 1").select("low", "uid")
    ids = columns.select("node_id")
    rows = entries
    for end, out in (("from", "f"), ("to", "t")):
        rows = rows.withColumn("low", F.lower(f"{end}_model")).join(once, "low").withColumn(out, F.concat("uid", F.lit("::"), F.lower(f"{end}_column"))).drop("low", "uid").join(ids.withColumnRenamed("node_id", out), out, "left_semi")
    return rows.select("f", "t", F.lit("relates_to").alias("edge_type"), F.lit("validated" if as_tests else "declared").alias("confidence")).distinct()


def patch_descriptions(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """(node_id, description, status): carried where the text is there already, else changed; entries without a node are skipped."""
    e = entries.select("node_id", F.col("text").alias("new"))
    rows = nodes.select("node_id", "description").join(e, "node_id", "left")
    status = F.when(F.col("new").isNull(), "kept").when(F.col("new").eqNullSafe(F.col("description")), "carried").otherwise("changed")
    done = rows.select("node_id", F.coalesce("new", "description").alias("description"), status.alias("status"))
    lost = e.join(nodes.select("node_id"), "node_id", "left_anti").select("node_id", F.col("new"), F.lit("skipped"))
    return done.union(lost)


def staged_by_target(entries: DataFrame) -> DataFrame:
    """(target, n, ids): entries by the model they point to."""
    return entries.groupBy("target").agg(F.count(F.lit(1)).alias("n"), joined(F.col("id")).alias("ids"))
