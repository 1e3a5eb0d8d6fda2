"""The project side: entities, columns, column lineage and declared relationships.

Lineage is graded from a projection table: one row for each model, output column
and leaf upstream column (``model, output, ordinal, kind, is_star, failed,
leaf_schema, leaf_table, leaf_column``). Relations are matched without regard to case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.numbering import numbered
from loomtrace.functions.text import last_segment
from loomtrace.operators.condense import longest_layers
from loomtrace.operators.graph import EDGE_KEY
from loomtrace.plans.closure import relax, settled

#: Characters of a defining expression that are kept.
SHOWN = 240


def _first(df: DataFrame, key: list, order: list) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def entity_nodes(entities: DataFrame) -> DataFrame:
    """Model and source rows; a view's and a source's own attributes are null on the other."""
    model = F.col("kind") == "model"
    return entities.select(F.col("uid").alias("node_id"), F.col("kind").alias("node_type"), "name", "db", "schema_name", F.col("tbl").alias("table_name"), F.when(model, F.col("materialization")).alias("materialization"), "path", "package", F.when(model, F.col("is_ephemeral")).alias("is_ephemeral"), F.when(model, F.col("tag")).alias("tag"))


def catalog_specs(entities: DataFrame, catalog: DataFrame, docs: DataFrame) -> DataFrame:
    """(uid, col, warehouse_name, dtype, description, in_catalog): an entity's catalog columns if it has any, else the documented ones."""
    known = catalog.join(entities.select("uid"), "uid", "left_semi")
    doc = docs.join(entities.select("uid"), "uid", "left_semi").select("uid", F.col("col").alias("doc_col"), F.lower("col").alias("key"), "description")
    from_catalog = known.withColumn("key", F.lower("col")).join(doc, ["uid", "key"], "left").select("uid", F.col("key").alias("col"), F.col("col").alias("warehouse_name"), "dtype", "description", F.lit(True).alias("in_catalog"))
    none = F.lit(None).cast("string")
    from_docs = doc.join(known.select("uid").distinct(), "uid", "left_anti").select("uid", F.col("key"), none, none, "description", F.lit(False))
    return from_catalog.union(from_docs)


def usable_projection(projections: DataFrame, models: DataFrame) -> DataFrame:
    """(model, usable): whether all outputs have real names; a model without outputs is not usable."""
    ok = F.col("output").rlike("^[A-Za-z_][A-Za-z0-9_$]*$") & ~F.col("output").rlike("^_col_[0-9]+$")
    found = projections.groupBy("model").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("usable"))
    return models.select(F.col("uid").alias("model")).join(found, "model", "left").select("model", F.coalesce("usable", F.lit(False)).alias("usable"))


def spelling(sql_name: Column, doc_name: Column, warehouse_name: Column) -> Column:
    """The name shown: as in SQL, else as documented, else the warehouse's, lower-cased only if it is all capitals."""
    return F.coalesce(sql_name, doc_name, F.when(F.upper(warehouse_name) == warehouse_name, F.lower(warehouse_name)).otherwise(warehouse_name))


def model_columns(projections: DataFrame, docs: DataFrame, catalog: DataFrame, models: DataFrame) -> DataFrame:
    """(model, col, name, dtype, place): the SQL's outputs, then documented columns; the catalog gives types only.

    Models whose projection cannot be used have the columns of :func:`catalog_specs`.
    """
    fit = usable_projection(projections, models)
    good = fit.where("usable").select("model")
    outputs = projections.join(good, "model", "left_semi").select("model", F.lower("output").alias("col"), F.col("output").alias("sql_name"), F.lit(None).cast("string").alias("doc_name"), F.lit(0).alias("tier"), "ordinal")
    documented = docs.withColumnRenamed("uid", "model").join(good, "model", "left_semi").select("model", F.lower("col").alias("col"), F.lit(None).cast("string").alias("sql_name"), F.col("col").alias("doc_name"), F.lit(1).alias("tier"), "ordinal")
    first = _first(outputs.union(documented), ["model", "col"], ["tier", "ordinal", "sql_name", "doc_name"])
    types = catalog.select(F.col("uid").alias("model"), F.lower("col").alias("col"), F.col("col").alias("warehouse_name"), "dtype")
    shown = first.join(types, ["model", "col"], "left").select("model", "col", spelling(F.col("sql_name"), F.col("doc_name"), F.col("warehouse_name")).alias("name"), "dtype", "tier", "ordinal")
    rest = fit.where("not usable").select(F.col("model").alias("uid"))
    specs = catalog_specs(rest, catalog, docs).select(F.col("uid").alias("model"), "col", spelling(F.lit(None).cast("string"), F.lit(None).cast("string"), F.coalesce("warehouse_name", "col")).alias("name"), "dtype", F.lit(2).alias("tier"), F.lit(0).cast("bigint").alias("ordinal"))
    place = F.row_number().over(Window.partitionBy("model").orderBy("tier", "ordinal", "col"))
    return shown.union(specs).select("model", "col", "name", "dtype", place.alias("place"))


def column_spelling(columns: DataFrame) -> DataFrame:
    """(uid, col, name, warehouse_name): the shown name of each column; the warehouse's is kept where it differs."""
    shown = spelling(F.col("sql_name"), F.col("doc_name"), F.col("warehouse_name"))
    return columns.select("uid", "col", shown.alias("name"), F.when(F.col("warehouse_name") != shown, F.col("warehouse_name")).alias("warehouse_name"))


def column_nodes(specs: DataFrame, entities: DataFrame, catalog: DataFrame, traces: DataFrame) -> DataFrame:
    """(node_id, name, data_type, unknown_type_reason, trace_status, trace_reason); only columns of models have a trace."""
    had = catalog.select("uid").distinct().withColumn("catalogued", F.lit(True))
    rows = specs.join(entities.select("uid", "kind"), "uid").join(had, "uid", "left").join(traces.select(F.col("model").alias("uid"), F.lower("output").alias("col"), "reason").distinct(), ["uid", "col"], "left")
    why = F.when(F.col("dtype").isNull(), F.when(F.col("catalogued"), F.lit("column_not_in_catalog")).otherwise(F.lit("relation_not_in_catalog")))
    model = F.col("kind") == "model"
    status = F.when(model, F.when(F.col("reason").isNull(), F.lit("traced")).otherwise(F.lit("untraced")))
    return rows.select(F.concat("uid", F.lit("::"), "col").alias("node_id"), F.col("col").alias("name"), F.col("dtype").alias("data_type"), why.alias("unknown_type_reason"), status.alias("trace_status"), F.when(model, F.col("reason")).alias("trace_reason"))


def references_edges(depends_on: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct edges from known upstreams, and one row with the number of other dependencies."""
    known = depends_on.join(entities.select(F.col("uid").alias("upstream")), "upstream", "left_semi")
    edges = known.select(F.col("upstream").alias("f"), F.col("model").alias("t"), F.lit("references").alias("edge_type"), F.lit("exact").alias("confidence")).dropDuplicates(EDGE_KEY)
    other = depends_on.join(entities.select(F.col("uid").alias("upstream")), "upstream", "left_anti").agg(F.count(F.lit(1)).alias("other"))
    return edges, other


def relation_map(entities: DataFrame) -> DataFrame:
    """(db, schema_name, tbl, uid), folded: who owns a relation, the last entity of several; ephemeral ones own none."""
    held = entities.where("not coalesce(is_ephemeral, false)")
    return held.groupBy(F.lower("db").alias("db"), F.lower("schema_name").alias("schema_name"), F.lower("tbl").alias("tbl")).agg(F.max_by("uid", "ordinal").alias("uid"))


def schema_inventory(entities: DataFrame, catalog: DataFrame, docs: DataFrame) -> DataFrame:
    """(schema_name, tbl, col, from_catalog): known columns of each relation; documents only fill what the catalog does not claim."""
    where = entities.select("uid", F.lower("schema_name").alias("schema_name"), F.lower("tbl").alias("tbl"))
    a = where.join(catalog, "uid").select("schema_name", "tbl", F.lower("col").alias("col"), F.lit(True).alias("from_catalog")).distinct()
    b = where.join(docs, "uid").select("schema_name", "tbl", F.lower("col").alias("col"), F.lit(False).alias("from_catalog")).distinct()
    return a.union(b.join(a, ["schema_name", "tbl"], "left_anti"))


def _leaves(projections: DataFrame, relations: DataFrame) -> DataFrame:
    """Projection rows with the owner of their leaf's relation, if the project has one."""
    owned = relations.select(F.col("schema_name").alias("ls"), F.col("tbl").alias("lt"), F.col("uid").alias("leaf_owner"))
    return projections.join(owned, (F.lower("leaf_schema") == F.col("ls")) & (F.lower("leaf_table") == F.col("lt")), "left").drop("ls", "lt")


def feeds_edges(projections: DataFrame, relations: DataFrame, catalogued: DataFrame) -> DataFrame:
    """One edge for each distinct leaf: exact over plain columns, inferred where a star met a relation that only documents describe, else parsed."""
    real = _leaves(projections, relations).where("leaf_owner is not null and leaf_column <> '*'").join(catalogued.select(F.col("uid").alias("leaf_owner"), F.lit(True).alias("sure")).distinct(), "leaf_owner", "left")
    grade = F.when(F.col("is_star") & F.col("sure").isNull(), 2).when(F.col("kind") == "column", 5).otherwise(3)
    edges = real.groupBy(F.concat("leaf_owner", F.lit("::"), F.lower("leaf_column")).alias("f"), F.concat("model", F.lit("::"), F.lower("output")).alias("t")).agg(F.min(grade).alias("g"))
    return edges.select("f", "t", F.lit("feeds").alias("edge_type"), F.when(F.col("g") == 5, "exact").when(F.col("g") == 3, "parsed").otherwise("inferred").alias("confidence"))


def star_fallback_edges(projections: DataFrame, depends_on: DataFrame, specs: DataFrame) -> DataFrame:
    """Inferred edges by name, from every dependency, for columns of star queries that could not be walked."""
    lost = projections.where("failed and is_star").select("model", F.lower("output").alias("col")).distinct()
    upstream = depends_on.select("model", F.col("upstream").alias("uid")).distinct().join(specs.select("uid", "col"), "uid")
    return lost.join(upstream, ["model", "col"]).select(F.concat("uid", F.lit("::"), "col").alias("f"), F.concat("model", F.lit("::"), "col").alias("t"), F.lit("feeds").alias("edge_type"), F.lit("inferred").alias("confidence")).distinct()


def foreign_relations(projections: DataFrame, relations: DataFrame) -> DataFrame:
    """(model, foreign): whether a model reads a schema-qualified relation that the project does not own."""
    outside = _leaves(projections, relations)
    return outside.groupBy("model").agg(F.coalesce(F.bool_or(F.col("leaf_schema").isNotNull() & F.col("leaf_owner").isNull()), F.lit(False)).alias("foreign"))


def trace_reasons(projections: DataFrame, relations: DataFrame, fallback: DataFrame) -> DataFrame:
    """(model, output, reason) of every output; null where lineage was found.

    Where the walk failed: an output that the query names (``is_explicit``) is a limit
    of the walk, else it came by a star of the query, else the query does not have it.
    """
    foreign = foreign_relations(projections, relations).join(projections.groupBy("model").agg(F.bool_or("is_star").alias("any_star")), "model")
    saved = fallback.select(F.col("t").alias("id"), F.lit(True).alias("saved")).distinct()
    flags = _leaves(projections, relations).groupBy("model", "output").agg(
        F.bool_or("failed").alias("failed"), F.bool_or("is_explicit").alias("named"), F.bool_or("is_star").alias("star"), F.bool_or(F.col("leaf_owner").isNotNull() & (F.col("leaf_column") != "*")).alias("found"),
        F.bool_or(F.col("leaf_schema").isNotNull() & F.col("leaf_owner").isNull()).alias("outside"), F.bool_or(F.col("leaf_column") == "*").alias("placeholder")
    )
    rows = flags.withColumn("id", F.concat("model", F.lit("::"), F.lower("output"))).join(saved, "id", "left").join(foreign, "model")
    reason = (
        F.when(F.coalesce("found", F.lit(False)) | F.col("saved"), None)
        .when(F.col("failed"), F.when(F.col("named"), F.lit("lineage_failed")).when(F.col("any_star"), F.lit("star_not_expandable")).otherwise(F.lit("column_not_in_sql")))
        .when(F.col("star"), F.lit("star_not_expandable"))
        .when(F.col("outside"), F.lit("upstream_not_in_project"))
        .when(F.col("placeholder"), F.when(F.col("foreign"), F.lit("upstream_not_in_project")).otherwise(F.lit("upstream_not_in_schema_map")))
        .otherwise(F.lit("no_upstream_columns"))
    )
    return rows.select("model", "output", reason.alias("reason"))


def untraceable_models(models: DataFrame, specs: DataFrame) -> DataFrame:
    """(model, output, reason) for columns of models without compiled SQL, or with SQL that was not ``parsed``."""
    reason = F.when(F.trim(F.coalesce("compiled", F.lit(""))) == "", "no_compiled_code").when(~F.col("parsed"), "unparseable_sql")
    return models.select("uid", reason.alias("reason")).where("reason is not null").join(specs, "uid").select(F.col("uid").alias("model"), F.col("col").alias("output"), "reason")


def defined_as(projections: DataFrame, expressions: DataFrame) -> DataFrame:
    """(model, output, kind, upstream, sql): how a column comes about; upstream only if it is exactly one."""
    leaf = F.concat("leaf_schema", F.lit("."), F.lower("leaf_table"), F.lit("."), "leaf_column")
    up = projections.groupBy("model", "output").agg(F.count_distinct(leaf).alias("n"), F.min(leaf).alias("one"), F.bool_or("is_star").alias("star"), F.bool_and(F.col("kind") == "column").alias("plain"))
    text = F.trim(F.regexp_replace("sql", r"\s+", " "))
    short = F.when(F.length(text) > SHOWN, F.concat(F.rtrim(F.substring(text, 1, SHOWN - 1)), F.lit("…"))).otherwise(text)
    kind = F.when(F.col("star"), "star").when(F.col("plain") & (F.col("n") == 1), "passthrough").otherwise("expression")
    return up.join(expressions, ["model", "output"], "left").select("model", "output", kind.alias("kind"), F.when(F.col("n") == 1, F.col("one")).alias("upstream"), short.alias("sql"))


def column_origin(pointers: DataFrame) -> DataFrame:
    """(id, origin, hops): where a chain of single-upstream columns ends.

    ``pointers(id, upstream)``: null upstream marks an end. Pointers double, so
    rounds grow with the logarithm of the depth; cycles and pointers to unknown ids give a null origin.
    """
    pointers = settled(pointers, "pointers")
    state = pointers.select("id", F.coalesce("upstream", "id").alias("at"), F.when(F.col("upstream").isNull(), 0).otherwise(1).alias("hops"), F.col("upstream").isNull().alias("done"))
    limit = pointers.count()

    def step(s: DataFrame) -> DataFrame:
        ahead = s.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"), F.col("done").alias("end"))
        return s.join(ahead, "at", "left").select("id", F.when(F.col("done"), F.col("at")).otherwise(F.col("next")).alias("at"), F.when(F.col("done"), F.col("hops")).otherwise(F.least(F.col("hops") + F.coalesce("more", F.lit(0)), F.lit(limit + 1))).alias("hops"), (F.col("done") | F.coalesce("end", F.lit(False))).alias("done"))

    ended = relax(state, step, F.struct(F.count_if("done"), F.count("at"), F.sum("hops")), max_rounds=max(2, limit.bit_length() + 1))
    return ended.select("id", F.when(F.col("done"), F.col("at")).alias("origin"), F.when(F.col("done"), F.col("hops")).alias("hops"))


def model_levels(models: DataFrame, depends_on: DataFrame) -> DataFrame:
    """(uid, level, place): upstream-first order, ties by id; members of cycles, and what lies behind them, come last with no level."""
    found = longest_layers(models.select(F.col("uid").alias("node_id")), depends_on.select(F.col("upstream").alias("f"), F.col("model").alias("t")), cycles=False)
    level = F.col("layer").alias("level")
    return numbered(found.select(F.col("node_id").alias("uid"), level), F.col("level").asc_nulls_last(), F.col("uid"), out="place")


def compiled_counts(models: DataFrame) -> DataFrame:
    has = F.trim(F.coalesce("compiled", F.lit(""))) != ""
    return models.agg(F.count_if(has).alias("with_sql"), F.count_if(~has).alias("without_sql"))


def resolve_targets(refs: DataFrame, models: DataFrame) -> DataFrame:
    """``refs(target)`` with the model meant and an error: by ``schema.name`` or by name alone, whatever the case."""
    names = models.select("uid", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("tbl"), F.lower(F.concat("schema_name", F.lit("."), "name")), F.lower(F.concat("schema_name", F.lit("."), "tbl"))))).alias("key")).distinct()
    found = names.groupBy("key").agg(F.count_distinct("uid").alias("n"), F.min("uid").alias("one"))
    rows = refs.withColumn("key", F.lower(F.trim(F.coalesce("target", F.lit(""))))).join(found, "key", "left")
    error = F.when(F.col("key") == "", "empty target").when(F.col("n").isNull(), "target model not found").when(F.col("n") > 1, "ambiguous")
    return rows.select(*refs.columns, F.when(F.col("n") == 1, F.col("one")).alias("to_model"), error.alias("error"))


def fk_from_column_meta(declared: DataFrame, models: DataFrame) -> DataFrame:
    """(model, col, to_model, to_column, cardinality, error) of keys declared in column metadata; the field defaults to the column's name."""
    rows = resolve_targets(declared, models)
    return rows.select("model", "col", "to_model", F.coalesce("field", "col").alias("to_column"), F.coalesce("cardinality", F.lit("many-to-one")).alias("cardinality"), "error")


def fk_from_constraints(constraints: DataFrame, models: DataFrame) -> DataFrame:
    """(model, col, to_model, to_column, error) of contract foreign keys.

    ``to`` is ``ref('name')`` or a literal with ``to_columns``; else ``expression`` is ``target (column, ..)``.
    """
    ref = F.regexp_extract("to", r"ref\(\s*['\"]([^'\"]+)['\"]\s*\)", 1)
    target = F.when(F.col("to").isNotNull(), F.when(ref != "", ref).otherwise(F.col("to"))).otherwise(F.trim(F.regexp_extract("expression", r"^\s*([^()\s]+)\s*\(", 1)))
    column = F.when(F.col("to").isNotNull(), F.get("to_columns", F.lit(0))).otherwise(F.nullif(F.trim(F.regexp_extract("expression", r"\(\s*([^,)]+)", 1)), F.lit("")))
    rows = resolve_targets(constraints.select("model", "col", target.alias("target"), column.alias("to_column")), models)
    error = F.when(F.col("target").isNull() | (F.col("target") == "") | F.col("to_column").isNull(), F.lit("unreadable constraint")).otherwise(F.col("error"))
    return rows.select("model", "col", F.when(error.isNull(), F.col("to_model")).alias("to_model"), "to_column", error.alias("error"))


def composite_relationships(declared: DataFrame, models: DataFrame) -> DataFrame:
    """(model, col, to_model, to_column, place, error): one row for each pair of ``columns``, a list of ``from:to`` texts."""
    rows = resolve_targets(declared, models)
    pairs = rows.select("model", "target", "to_model", "error", F.posexplode_outer("columns").alias("place", "pair"))
    halves = F.split("pair", ":")
    bad = F.when(F.col("pair").isNull(), "no columns").when(F.size(halves) != 2, "malformed pair").otherwise(F.col("error"))
    return pairs.select("model", F.when(bad.isNull(), halves[0]).alias("col"), F.when(bad.isNull(), F.col("to_model")).alias("to_model"), F.when(bad.isNull(), halves[1]).alias("to_column"), "place", bad.alias("error"))


def conceptual_relationships(declared: DataFrame, models: DataFrame) -> DataFrame:
    """(f, t, note, error) of model-to-model relations that name no column."""
    rows = resolve_targets(declared.where("type = 'related'"), models)
    return rows.select(F.col("model").alias("f"), F.col("to_model").alias("t"), "note", "error")


def relationship_tests(tests: DataFrame, models: DataFrame) -> DataFrame:
    """(test_id, model, col, to_model, to_column) of relationship tests.

    The model is the attached one, else the only dependency that is not the target;
    the target is what ``to`` refers to, else the only other dependency.
    """
    ref = F.nullif(F.regexp_extract("to", r"ref\(\s*['\"]([^'\"]+)['\"]\s*\)", 1), F.lit(""))
    rows = resolve_targets(tests.withColumn("target", ref), models).drop("error").withColumnRenamed("to_model", "named")
    only = lambda other: F.when(F.size(F.filter("deps", lambda d: ~d.eqNullSafe(other))) == 1, F.get(F.filter("deps", lambda d: ~d.eqNullSafe(other)), F.lit(0)))
    rows = rows.withColumn("model", F.coalesce("attached", only(F.col("named"))))
    rows = rows.withColumn("to_model", F.coalesce("named", only(F.col("model"))))
    return rows.where("model is not null and to_model is not null").select("test_id", "model", "col", "to_model", F.col("field").alias("to_column"))


def relates_to_edges(declared: DataFrame, tests: DataFrame, columns: DataFrame) -> DataFrame:
    """(f, t, edge_type, confidence, source, arity) of declared relationships whose ends exist; a matching test validates, and tests alone count too.

    Where a pair is declared, and with which arity, is what its first declaration by
    ``ordinal`` says; a pair that only a test names has the source ``test`` and no arity.
    """
    end = lambda m, c: F.concat(m, F.lit("::"), F.lower(c))
    said = [F.col(c) if c in declared.columns else F.lit(None).cast("string").alias(c) for c in ("source", "arity")]
    d = declared.where("to_model is not null").select(end("model", "col").alias("f"), end("to_model", "to_column").alias("t"), F.col("ordinal").cast("long").alias("ordinal"), F.lit(False).alias("tested"), *said)
    t = tests.select(end("model", "col").alias("f"), end("to_model", "to_column").alias("t"), F.lit(0).cast("long"), F.lit(True), F.lit("test"), F.lit(None).cast("string"))
    ids = columns.select("node_id")
    both = d.union(t).join(ids.withColumnRenamed("node_id", "f"), "f", "left_semi").join(ids.withColumnRenamed("node_id", "t"), "t", "left_semi")
    rows = both.groupBy("f", "t").agg(F.bool_or("tested").alias("tested"), F.min_by(F.struct("source", "arity"), F.struct("tested", "ordinal")).alias("first"))
    return rows.select("f", "t", F.lit("relates_to").alias("edge_type"), F.when(F.col("tested"), F.lit("validated")).otherwise(F.lit("declared")).alias("confidence"), "first.source", "first.arity")


def dangling_relationships(declared: DataFrame, columns: DataFrame) -> DataFrame:
    """(label, reason) of every declaration that gives no edge."""
    ids = columns.select("node_id", F.lit(True).alias("there"))
    end = lambda m, c: F.concat(m, F.lit("::"), F.lower(c))
    rows = declared.withColumns({"a": end("model", "col"), "b": end("to_model", "to_column")})
    rows = rows.join(ids.toDF("a", "has_a"), "a", "left").join(ids.toDF("b", "has_b"), "b", "left")
    reason = F.coalesce("error", F.when(F.col("has_a").isNull(), F.lit("column not found")).when(F.col("has_b").isNull(), F.lit("target column not found")))
    label = F.concat(last_segment(F.col("model")), F.lit("."), "col", F.lit(" -> "), F.coalesce("target", F.lit("?")), F.lit("."), F.coalesce("to_column", F.lit("?")))
    return rows.select(label.alias("label"), reason.alias("reason")).where("reason is not null")


def dbt_coverage(columns: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row over columns of models: total, traced, inferred, untraced; inferred ones have nothing better."""
    best = feeds.groupBy(F.col("t").alias("node_id")).agg(F.bool_and(F.col("confidence") == "inferred").alias("weak"))
    rows = columns.join(best, "node_id", "left")
    return rows.agg(F.count_distinct("node_id").alias("total"), F.count_if(~F.col("weak")).alias("traced"), F.count_if("weak").alias("inferred"), F.count_if(F.col("weak").isNull()).alias("untraced"))
