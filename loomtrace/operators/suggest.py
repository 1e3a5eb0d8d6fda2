"""Undeclared relationships, search, and the discovery of mappings between catalogs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.numbering import numbered
from loomtrace.functions.text import relationship_id, singular
from loomtrace.plans.closure import settled
from loomtrace.plans.placed import small

#: Layer prefixes of model names, and the score of a guess from a name.
LAYERS = r"^(viz_|stg_|int_|fct_|dim_|mart_|bdg_|base_|agg_|rpt_)+"
NAMING = 0.5
#: The lowest ratio of a fuzzy hit, and what a database mapping needs to be sure.
FUZZY, SURE, LEAD = 0.6, 0.9, 0.15
#: Characters of a run by which texts are found.
GRAM = 3
#: Texts that are searched behind name and id, and how a hit in each is called.
TEXTS = {"description": "description", "title": "properties.title", "collection_name": "properties.collection_name", "tags": "properties.tags"}


def implicit_join_pairs(uses: DataFrame, fields: DataFrame, binds: DataFrame, columns: DataFrame, models: DataFrame) -> DataFrame:
    """(from_model, from_column, to_model, to_column, score, source): joins that cards make through a key field.

    ``uses(field_id, card_id, implicit_join)``; both ends go through the bindings to
    columns of models. The score is the number of distinct cards; a model is not paired with itself.
    """
    keys = uses.where("implicit_join").join(fields.where("fk_target_field_id is not null").select("field_id", "fk_target_field_id"), "field_id")
    at = binds.join(columns.select(F.col("node_id").alias("col_id"), "owner_id", "name"), "col_id").join(models.select(F.col("node_id").alias("owner_id"), F.col("name").alias("model")), "owner_id")
    a = at.select("field_id", F.col("model").alias("from_model"), F.col("name").alias("from_column"))
    b = at.select(F.col("field_id").alias("fk_target_field_id"), F.col("model").alias("to_model"), F.col("name").alias("to_column"))
    pairs = keys.join(a, "field_id").join(b, "fk_target_field_id").where("from_model <> to_model")
    return pairs.groupBy("from_model", "from_column", "to_model", "to_column").agg(F.count_distinct("card_id").cast("double").alias("score")).withColumn("source", F.lit("implicit_join"))


def grains(models: DataFrame) -> DataFrame:
    """(model, grain): what a model may hold one row of, by its name with and without layer prefixes."""
    low = F.lower("name")
    bare = F.coalesce(F.nullif(F.regexp_replace(low, LAYERS, ""), F.lit("")), low)
    return models.select(F.col("name").alias("model"), F.explode(F.array_distinct(F.array(singular(low), singular(bare)))).alias("grain"))


def eligible_models(models: DataFrame) -> DataFrame:
    """Models that take part in relationships; semantic views do not."""
    return models.where("coalesce(materialization, '') <> 'semantic_view'")


def naming_pairs(models: DataFrame, columns: DataFrame) -> DataFrame:
    """Pairs by name: ``<entity>_id`` and a model of that grain, not the own one; the target column is of the same name, else ``id``."""
    g = grains(models)
    c = columns.join(models.select(F.col("node_id").alias("owner_id"), F.col("name").alias("model")), "owner_id").select("model", "name")
    ids = c.where(F.lower("name").endswith("_id") & (F.length("name") > 3)).withColumn("entity", F.expr("lower(substring(name, 1, length(name) - 3))"))
    own = g.select("model", F.col("grain").alias("entity"))
    pairs = ids.join(own, ["model", "entity"], "left_anti").join(g.select(F.col("model").alias("to_model"), F.col("grain").alias("entity")), "entity").where("model <> to_model")
    same = c.select(F.col("model").alias("to_model"), F.lower("name").alias("low"), F.col("name").alias("same"))
    plain = c.where("lower(name) = 'id'").groupBy(F.col("model").alias("to_model")).agg(F.min("name").alias("plain"))
    found = pairs.withColumn("low", F.lower("name")).join(same, ["to_model", "low"], "left").join(plain, "to_model", "left")
    target = F.coalesce("same", "plain")
    return found.where(target.isNotNull()).select(F.col("model").alias("from_model"), F.col("name").alias("from_column"), "to_model", target.alias("to_column"), F.lit(NAMING).alias("score"), F.lit("naming").alias("source"))


def exclude_pairs(pairs: DataFrame, declared: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Pairs, with their id, that are neither declared in either direction nor dismissed by id."""
    def ends(df: DataFrame) -> DataFrame:
        a, b = (F.lower(F.concat(m, F.lit("."), c)) for m, c in (("from_model", "from_column"), ("to_model", "to_column")))
        return df.withColumn("ends", F.array_sort(F.array(a, b)))

    ided = ends(pairs).withColumn("id", relationship_id(F.col("from_model"), F.col("from_column"), F.col("to_model"), F.col("to_column")))
    return ided.join(ends(declared).select("ends").distinct(), "ends", "left_anti").join(dismissed.select("id").distinct(), "id", "left_anti").drop("ends")


def suggest(pairs: DataFrame) -> DataFrame:
    """The best row of each id with its place: by score, then names."""
    best = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "source"))).where("_k = 1").drop("_k")
    order = [F.desc("score"), *(F.lower(c) for c in ("from_model", "from_column", "to_model", "to_column")), F.col("id")]
    return numbered(best, *order, out="place")


def suggestions_by_source(found: DataFrame) -> DataFrame:
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def suggestions_in_scope(found: DataFrame, members: DataFrame) -> DataFrame:
    """Suggestions with both models among ``members(model)``."""
    return found.join(members.select(F.col("model").alias("from_model")), "from_model", "left_semi").join(members.select(F.col("model").alias("to_model")), "to_model", "left_semi")


def fuzzy_score(a: Column, b: Column) -> Column:
    """1 less the share of edits; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def searchable(nodes: DataFrame, collections: DataFrame, tags: DataFrame) -> DataFrame:
    """Nodes with their ``title`` (null where they have none), the name of their collection and their tags as one text."""
    named = collections.select("collection_id", F.col("name").alias("collection_name"))
    tagged = tags.where("tag is not null").groupBy("node_id").agg(F.array_join(F.sort_array(F.collect_set("tag")), " ").alias("tags"))
    titled = nodes if "title" in nodes.columns else nodes.withColumn("title", F.lit(None).cast("string"))
    return titled.join(named, "collection_id", "left").join(tagged, "node_id", "left")


def searchable_alone(nodes: DataFrame) -> DataFrame:
    """Nodes to search where collections and tags are not at hand."""
    return nodes.withColumns({c: F.lit(None).cast("string") for c in TEXTS if c not in nodes.columns})


def _grams(text: Column, size: int) -> Column:
    """All runs of ``size`` characters."""
    return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def parts_holding(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, node_id): texts of ``texts(node_id, whole)`` that a query of ``queries(q)`` is a part of, and perhaps others.

    A text is looked at if it holds the query's rarest run of three characters; only
    queries shorter than that meet all texts.
    """
    long = settled(queries.where(F.length("q") >= GRAM).select("q", F.explode(F.array_distinct(_grams(F.col("q"), GRAM))).alias("gram")))
    posted = settled(texts.select("node_id", F.explode(F.array_distinct(_grams(F.col("whole"), GRAM))).alias("gram")).join(small(long.select("gram").distinct()), "gram", "left_semi"))
    often = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = long.join(often, "gram", "left").groupBy("q").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    found = posted.join(small(rarest), "gram").select("q", "node_id")
    short = settled(queries.where(F.length("q") < GRAM))
    return found.union(small(short).join(texts.select("node_id", "whole"), F.col("whole").contains(F.col("q"))).select("q", "node_id"))


def names_like(names: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, low): names of ``names(low)`` that may be within the ratio of a query, and perhaps others.

    One edit spoils at most two pairs of neighbouring characters, so names within the
    ratio have more than a fifth of the longer one's pairs in common; ends count as characters.
    """
    def pairs(rows: DataFrame, c: str) -> DataFrame:
        edged = F.concat(F.lit("\x01"), c, F.lit("\x01"))
        return rows.select(c, F.explode(_grams(edged, 2)).alias("gram")).groupBy(c, "gram").agg(F.count(F.lit(1)).alias(f"n_{c}"))

    mine = settled(pairs(queries, "q"))
    longest = F.greatest(F.length("q"), F.length("low"))
    near = F.least(F.length("q"), F.length("low")) >= F.ceil(FUZZY * longest - F.lit(1e-9))
    met = pairs(names, "low").join(small(mine), "gram").where(near).groupBy("q", "low").agg(F.sum(F.least("n_q", "n_low")).alias("common"))
    edits = F.floor((1 - FUZZY) * longest + F.lit(1e-9))
    return met.where(F.col("common") >= longest + 1 - 2 * edits).select("q", "low")


def search(nodes: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query, node_id, node_type, name, tier, field, score, place): the best hits of each query.

    ``nodes`` are those of :func:`searchable`. Tiers: the name itself, its beginning,
    a word's beginning, a part of name, id, description, title, collection or tags
    (the first of these is the field), a similar name. Queries meet only the nodes that
    share their characters; a null or blank query has no hits.
    """
    asked = settled(queries.select("query", F.lower(F.trim("query")).alias("q")).where("q <> ''").distinct())
    n = nodes.select("node_id", "node_type", "name", F.lower("name").alias("low"), F.lower(F.substring_index(F.substring_index("node_id", "::", -1), ".", -1)).alias("tail"), *(F.lower(c).alias(f"in_{c}") for c in TEXTS))
    n = settled(n)
    parts = ["low", "tail", *(f"in_{c}" for c in TEXTS)]
    words = asked.select("q").distinct()
    # No text holds the mark, so a query never runs over two of them.
    holding = parts_holding(n.select("node_id", F.concat_ws("\x00", *parts).alias("whole")), words)
    alike = names_like(n.select("low").where("low is not null").distinct(), words).join(n.select("low", "node_id"), "low").select("q", "node_id")
    met = holding.union(alike).distinct()
    word = F.expr("low rlike concat('(?s)(^|[^\\\\p{L}\\\\p{N}])\\\\Q', q, '\\\\E')")
    has = lambda c: F.coalesce(F.col(c).contains(F.col("q")), F.lit(False))
    hits = met.join(n, "node_id").join(small(asked), "q")
    tier = F.when(F.col("low") == F.col("q"), 5).when(F.col("low").startswith(F.col("q")), 4).when(word, 3).when(reduce(Column.__or__, map(has, parts)), 2)
    hits = hits.withColumn("tier", tier)
    # The distance is only taken where no other tier holds.
    ratio = F.when(F.col("tier").isNull(), fuzzy_score(F.col("q"), F.col("low")))
    hits = hits.withColumn("ratio", ratio).withColumn("tier", F.when(F.col("tier").isNull() & (F.col("ratio") >= FUZZY), 1).otherwise(F.col("tier")))
    field = F.when((F.col("tier") != 2) | has("low"), "name").when(has("tail"), "node_id")
    for c, label in TEXTS.items():
        field = field.when(has(f"in_{c}"), label)
    score = F.when(F.col("tier") > 1, F.col("tier").cast("double")).otherwise(F.round("ratio", 3))
    rows = hits.where("tier is not null").withColumns({"field": field, "score": score})
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("tier"), F.desc("score"), "low", "node_id"))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("query", "node_id", "node_type", "name", "tier", "field", "score", "place")


def node_context(nodes: DataFrame, collections: DataFrame) -> DataFrame:
    """(node_id, context): a column's owner, a card's or dashboard's collection, else schema and table."""
    owners = nodes.select(F.col("node_id").alias("owner_id"), F.col("name").alias("owner_name"))
    rows = nodes.join(owners, "owner_id", "left").join(collections.select("collection_id", F.col("name").alias("collection")), "collection_id", "left")
    kind = F.col("node_type")
    text = F.when(kind == "column", F.coalesce("owner_name", F.substring_index("owner_id", ".", -1))).when(kind.isin("mb_card", "mb_dashboard"), F.col("collection")).otherwise(F.concat_ws(".", "schema_name", "table_name"))
    return rows.select("node_id", text.alias("context"))


def group_hits(hits: DataFrame) -> DataFrame:
    """(query, node_type, n, ids): hits by type, the order of the hits kept."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "node_id"))), lambda x: x["node_id"])
    return hits.groupBy("query", "node_type").agg(F.count(F.lit(1)).alias("n"), F.array_join(ids, ", ").alias("ids"))


def search_with_consequence(hits: DataFrame, counts: DataFrame) -> DataFrame:
    """Hits with the distinct cards and dashboards below each."""
    return hits.join(counts, "node_id", "left")


def model_inventory(entities: DataFrame) -> DataFrame:
    """(db, schema_name, relations): by number of relations; ephemeral ones are none."""
    return entities.where("not is_ephemeral").groupBy("db", "schema_name").agg(F.count(F.lit(1)).alias("relations"))


def mart_schemas(models: DataFrame, depends_on: DataFrame) -> DataFrame:
    """(schema_name, evidence): by the first evidence that names any: model prefix, a word in the schema, models that none depends on, all."""
    leaf = models.join(depends_on.select(F.col("upstream").alias("uid")).distinct(), "uid", "left_anti")
    kinds = [models.where(F.col("name").rlike("^(fct_|dim_|mart_)")), models.where(F.lower("schema_name").rlike("mart|presentation|reporting")), leaf, models]
    names = ["prefix", "word", "leaves", "all"]
    found = None
    for place, (rows, name) in enumerate(zip(kinds, names)):
        part = rows.select("schema_name").distinct().withColumns({"evidence": F.lit(name), "place": F.lit(place)})
        found = part if found is None else found.union(part)
    first = found.agg(F.min("place").alias("best"))
    return found.join(F.broadcast(first), F.col("place") == F.col("best")).select("schema_name", "evidence")


def propose_database_mapping(dbt_dbs: DataFrame, bi_dbs: DataFrame) -> DataFrame:
    """(dbt_db, bi_db, score, confident): the best BI database for each project database; both lists are short."""
    a, b = F.lower("dbt_db"), F.lower("name")
    flat = lambda c: F.regexp_replace(c, "[^a-z0-9]", "")
    score = F.when(F.lower("details_db") == a, 1.0).when(b == a, 0.95).when(flat(b) == flat(a), 0.92).otherwise(fuzzy_score(a, b) * 0.85) * F.when(F.col("is_sample"), 0.1).otherwise(1.0)
    rows = dbt_dbs.crossJoin(small(settled(bi_dbs))).withColumn("score", F.round(score, 6))
    w = Window.partitionBy("dbt_db").orderBy(F.desc("score"), "name")
    ranked = rows.withColumns({"k": F.row_number().over(w), "next": F.lead("score").over(w)}).where("k = 1")
    sure = (F.col("score") >= SURE) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= LEAD)
    return ranked.select("dbt_db", F.col("name").alias("bi_db"), "score", sure.alias("confident"))


def propose_schemas(marts: DataFrame, available: DataFrame) -> DataFrame:
    """(schema_name): the BI side's spelling where it agrees, else the project's."""
    bi = available.groupBy(F.lower("schema_name").alias("low")).agg(F.min("schema_name").alias("theirs"))
    return marts.withColumn("low", F.lower("schema_name")).join(bi, "low", "left").select(F.coalesce("theirs", "schema_name").alias("schema_name")).distinct()


def derive_table_prefix(dbt_tables: DataFrame, bi_tables: DataFrame) -> DataFrame:
    """One row: the most frequent text in front of a BI table's name in the project's names; empty without good evidence.

    At least half of the project's tables are unmatched, and the prefix explains two
    of them and half. Ties go to the shortest, then the first by code point. Names
    are cut at every place, so the match is an equi-join.
    """
    mine = dbt_tables.select(F.lower("tbl").alias("t")).distinct()
    theirs = bi_tables.select(F.lower("table_name").alias("b")).distinct()
    unmatched = mine.join(theirs, F.col("t") == F.col("b"), "left_anti")
    cuts = unmatched.where("length(t) > 1").withColumn("at", F.explode(F.sequence(F.lit(1), F.length("t") - 1)))
    cut = cuts.select("t", F.expr("substring(t, 1, at)").alias("prefix"), F.expr("substring(t, at + 1)").alias("b"))
    votes = cut.join(theirs, "b").groupBy("prefix").agg(F.count_distinct("t").alias("hits"))
    best = votes.agg(F.min(F.struct((-F.col("hits")).alias("h"), F.length("prefix").alias("l"), "prefix")).alias("best"))
    counts = mine.agg(F.count(F.lit(1)).alias("n")).join(unmatched.agg(F.count(F.lit(1)).alias("u")))
    ok = (F.col("u") * 2 >= F.col("n")) & (-F.col("best.h") >= 2) & (-F.col("best.h") * 2 >= F.col("u"))
    return counts.join(best).select(F.when(F.coalesce(ok, F.lit(False)), F.col("best.prefix")).otherwise(F.lit("")).alias("prefix"))


