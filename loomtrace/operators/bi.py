"""The BI side: fields, collections, the queries of cards, native SQL and dashboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.text import joined
from loomtrace.operators import packed
from loomtrace.operators.condense import reached_back
from loomtrace.plans.closure import settled, settled_rows
from loomtrace.plans.placed import Hops, small, spread_in_buckets

#: The literal that stands for a template tag of each kind, and the deepest nesting of snippets.
LITERALS = {"number": "1", "boolean": "TRUE", "date": "'1970-01-01'", "datetime": "'1970-01-01'", "temporal-unit": "'day'", "dimension": "1 = 1"}
DEFAULT_LITERAL = "'tag'"
CARD_PLACEHOLDER = "(select 1)"
SNIPPET_DEPTH = 3
#: Keys under which a query holds the queries that it reads.
READS = ("query", "source-query", "stages", "joins")
#: The order in which the parts of a query are read; its own source comes first, keys of other names last.
PLACES = {"condition": "05", "conditions": "05", "query": "10", "fields": "11", "breakout": "12", "aggregation": "13", "filter": "14", "filters": "14", "expressions": "15", "order-by": "16", "joins": "50", "stages": "60", "source-query": "60"}
OWN_SOURCE = "00"
#: A query's path: its level of nesting, or its stage.
LEVEL = r"^((?:\.query|\.stages#\d+)(?:(?:\.joins#\d+)?\.source-query|\.joins#\d+\.stages#\d+)*)"


def bi_field_nodes(fields: DataFrame, schemas: list[str] | None = None) -> DataFrame:
    """Field rows, of the given schemas only if there are any given."""
    return fields if schemas is None else fields.where(F.lower("schema_name").isin([s.lower() for s in schemas]))


def collection_paths(collections: DataFrame) -> DataFrame:
    """(collection_id, path): names of the ancestors in ``location`` and its own; unknown ancestors are skipped."""
    parts = collections.select("collection_id", F.posexplode(F.filter(F.split("location", "/"), lambda p: p != "")).alias("place", "part"))
    names = collections.select(F.col("collection_id").cast("string").alias("part"), F.col("name").alias("ancestor"))
    above = parts.join(names, "part").groupBy("collection_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ancestor"))), lambda x: x["ancestor"]).alias("names"))
    return collections.join(above, "collection_id", "left").select("collection_id", F.array_join(F.concat(F.coalesce("names", F.array()), F.array("name")), "/").alias("path"))


def collections_matching(collections: DataFrame, paths: DataFrame, globs: DataFrame) -> DataFrame:
    """(collection_id, glob): collections whose name or path a glob fits; personal ones also answer to ``Personal``.

    A glob meets only names that begin with its text before the first wildcard, cut to the
    lengths that occur; those that begin with a wildcard are tried against all.
    """
    rx = F.concat(F.lit("(?is)^"), F.replace(F.replace(F.regexp_replace("glob", r"([.+^$(){}|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    called = F.array_compact(F.array("name", "path", F.when(F.col("personal"), F.lit("Personal"))))
    rows = collections.join(paths, "collection_id").select("collection_id", F.explode(called).alias("called"))
    globs = settled(globs.select("glob", rx.alias("rx"), F.lower(F.regexp_extract("glob", r"(?s)^([^*?]*)", 1)).alias("anchor")).distinct())
    held = globs.where("anchor <> ''").select(F.length("anchor").alias("n")).distinct()
    lengths = held.agg(F.coalesce(F.sort_array(F.collect_set("n")), F.array().cast("array<int>")).alias("lengths"))
    begun = rows.crossJoin(F.broadcast(lengths)).select("collection_id", "called", F.explode(F.transform("lengths", lambda n: F.lower(F.substring("called", F.lit(1), n)))).alias("anchor")).distinct()
    anchored = begun.join(globs.where("anchor <> ''"), "anchor")
    free = rows.crossJoin(small(globs.where("anchor = ''").drop("anchor")))
    both = anchored.select("collection_id", "called", "glob", "rx").union(free.select("collection_id", "called", "glob", "rx"))
    return both.where(F.expr("called rlike rx")).select("collection_id", "glob").distinct()


def scope_cards(cards: DataFrame, excluded: DataFrame) -> DataFrame:
    """Cards (or dashboards) outside the excluded collections; those in no collection stay."""
    return cards.join(excluded.select("collection_id").distinct(), "collection_id", "left_anti")


def query_kind(cards: DataFrame) -> DataFrame:
    """(card_id, kind): legacy, stages, native or null, by the query's own shape."""
    v = F.try_parse_json("dataset_query")
    text = lambda path: F.try_variant_get(v, path, "string")
    staged = F.try_variant_get(v, "$.stages", "variant").isNotNull()
    native = (text("$.type") == "native") | (staged & (text("$.stages[0]['lib/type']") == "mbql.stage/native"))
    kind = F.when(native, "native").when(staged, "stages").when(F.try_variant_get(v, "$.query", "variant").isNotNull(), "legacy")
    return cards.select("card_id", kind.alias("kind"))


def _started(cards: DataFrame, column: str = "dataset_query") -> DataFrame:
    return cards.select("card_id", F.lit("").alias("path"), F.lit("").alias("ord"), F.try_parse_json(column).alias("v")).where("v is not null")


def _exploded(level: DataFrame) -> DataFrame:
    return level.sparkSession.sql("select t.card_id, t.path, t.ord, e.pos, e.key, e.value as v from {level} t, lateral variant_explode(t.v) e", level=level)


def _stepped(items: DataFrame) -> DataFrame:
    """Exploded items with their path, by keys and the places of stages and joins, and their place in reading order."""
    placed = F.col("path").endswith(".stages") | F.col("path").endswith(".joins")
    step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).when(placed, F.concat(F.lit("#"), F.col("pos").cast("string"))).otherwise(F.lit(""))
    known = F.element_at(F.create_map(*(F.lit(x) for kv in PLACES.items() for x in kv)), F.col("key"))
    place = F.when(F.col("key").isNotNull(), F.coalesce(known, F.concat(F.lit("90"), "key", F.lit(".")))).otherwise(F.lpad(F.col("pos").cast("string"), 6, "0"))
    return items.select("card_id", F.concat("path", step).alias("path"), F.concat("ord", place).alias("ord"), "v")


def walk_query(cards: DataFrame) -> DataFrame:
    """(card_id, label, level, ord, kind, target, source_field, join_alias) of every field and metric reference.

    One explode for each level of nesting; a reference is not entered. The label is
    the clause with its levels in front, in the singular; ``level`` is the path of the
    query, nested query or stage that it stands in, and ``ord`` its place in reading order
    (keys of objects other than queries are read by name). Both argument orders of a
    reference are read: an object in second place holds the options.
    """
    level = _started(cards)
    found = []
    while True:
        kind = F.schema_of_variant("v")
        nested = settled(_stepped(_exploded(level)).where(kind.startswith("OBJECT") | kind.startswith("ARRAY")))
        if nested.isEmpty():
            break
        head = F.try_variant_get("v", "$[0]", "string")
        is_ref = head.isin("field", "metric") & F.schema_of_variant("v").startswith("ARRAY")
        found.append(nested.where(is_ref))
        level = nested.where(~F.coalesce(is_ref, F.lit(False)))
    if not found:
        return cards.select("card_id", *(F.lit("").alias(c) for c in ("label", "level", "ord", "kind", "target", "source_field", "join_alias"))).limit(0)
    return normalise_refs(reduce(DataFrame.union, found))


def normalise_refs(refs: DataFrame) -> DataFrame:
    """References as columns, whichever order their target and options stand in."""
    late = F.schema_of_variant(F.try_variant_get("v", "$[1]", "variant")).startswith("OBJECT")
    pick = lambda a, b: F.when(late, F.try_variant_get("v", a, "string")).otherwise(F.try_variant_get("v", b, "string"))
    label = F.col("path")
    for pattern, text in ((r"\.joins#\d+", ".joins"), (r"\.joins\.stages#0\.", ".joins.source-query."), (r"\.joins\.stages#(\d+)\.", ".joins.source-query.stage$1."), (r"^\.(?:query|stages#0)\.", ""), (r"^\.stages#(\d+)\.", "stage$1."), ("filters", "filter"), ("conditions", "condition")):
        label = F.regexp_replace(label, pattern, text)
    return refs.select("card_id", label.alias("label"), F.regexp_extract("path", LEVEL, 1).alias("level"), "ord", F.try_variant_get("v", "$[0]", "string").alias("kind"), pick("$[2]", "$[1]").alias("target"), pick("$[1]['source-field']", "$[2]['source-field']").alias("source_field"), pick("$[1]['join-alias']", "$[2]['join-alias']").alias("join_alias"))


def implicit_join_refs(refs: DataFrame) -> DataFrame:
    """References and, flagged, one more for each ``source-field`` option."""
    plain = refs.withColumn("implicit_join", F.lit(False))
    return plain.unionByName(plain.where("source_field is not null").withColumns({"target": F.col("source_field"), "implicit_join": F.lit(True)}))


def query_objects(cards: DataFrame) -> DataFrame:
    """(card_id, path, ord, v) of every query, stage and join in a card, as a written table.

    One explode for each level of nesting, which enters only the keys that hold queries.
    """
    level, found = _started(cards), []
    while True:
        items = _exploded(level).where(F.col("key").isNull() | F.col("key").isin(*READS))
        level, rows = settled_rows(_stepped(items).where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")))
        if not rows:
            break
        found.append(level.where(F.schema_of_variant("v").startswith("OBJECT")))
    return reduce(DataFrame.union, found) if found else level


def _source(v: str | Column = "v") -> tuple[Column, Column]:
    """(table, card) that an object reads; a source card wins over a table, and ``card__N`` is a card."""
    source = F.try_variant_get(v, "$['source-table']", "string")
    card = F.coalesce(F.try_variant_get(v, "$['source-card']", "bigint"), F.regexp_extract(source, r"^card__(\d+)$", 1).try_cast("bigint"))
    return F.when(card.isNull(), source.try_cast("bigint")), card


def query_sources(cards: DataFrame) -> DataFrame:
    """(card_id, path, ord, table_id, source_card): what each query in a card reads, through all source queries, stages and joins."""
    table, card = _source()
    return query_objects(cards).select("card_id", "path", F.concat("ord", F.lit(OWN_SOURCE)).alias("ord"), table.alias("table_id"), card.alias("source_card"))


def join_scopes(cards: DataFrame) -> DataFrame:
    """(card_id, level, alias, table_id): what each alias means in the query, nested query or stage whose join it is.

    Of several joins with one alias in a level the first counts. ``table_id`` is null
    for an alias of a card or of a query. A join of stages reads what its first stage reads.
    """
    joins = query_objects(cards).where(F.col("path").rlike(r"\.joins#\d+$")).where(F.schema_of_variant(F.try_variant_get("v", "$.alias", "variant")) == "STRING")
    staged = F.try_variant_get("v", "$.stages[0]", "variant")
    plain, inner = _source()[0], _source(staged)[0]
    table = F.when(F.col("path").startswith(".stages"), inner).otherwise(plain)
    rows = joins.select("card_id", F.regexp_extract("path", LEVEL, 1).alias("level"), F.try_variant_get("v", "$.alias", "string").alias("alias"), "ord", table.alias("table_id"))
    return rows.groupBy("card_id", "level", "alias").agg(F.min_by(F.struct("table_id"), "ord").alias("first")).select("card_id", "level", "alias", "first.table_id")


def upstream_cards(cards: DataFrame, refs: DataFrame) -> DataFrame:
    """(card_id, upstream, ord): cards named as source table, source card, join source or metric, however deep, each at the first place that names it."""
    named = query_sources(cards).select("card_id", F.col("source_card").alias("upstream"), "ord")
    metric = refs.where("kind = 'metric'").select("card_id", F.col("target").try_cast("bigint"), "ord")
    return named.union(metric).where("upstream is not null").groupBy("card_id", "upstream").agg(F.min("ord").alias("ord"))


def source_context(cards: DataFrame) -> DataFrame:
    """(card_id, table_id, source_card): what the innermost query reads: the deepest source query, or the first stage."""
    rows = query_sources(cards).where(F.col("path").rlike(r"^(\.query(\.source-query)*|\.stages#\d+)$"))
    stage = F.regexp_extract("path", r"#(\d+)$", 1).try_cast("int")
    inner = rows.groupBy("card_id").agg(F.max_by(F.struct("table_id", "source_card"), F.struct(stage.isNotNull(), F.coalesce(-stage, F.length("path")))).alias("s"))
    return cards.select("card_id").join(inner, "card_id", "left").select("card_id", "s.table_id", "s.source_card")


def resolve_refs_by_id(refs: DataFrame, fields: DataFrame) -> DataFrame:
    """Field references with a numeric target and whether the field is known; ``status``: resolved, unknown or by_name."""
    ids = fields.select("field_id", F.lit(True).alias("known"))
    rows = refs.where("kind = 'field'").withColumn("field_id", F.col("target").try_cast("bigint")).join(ids, "field_id", "left")
    status = F.when(F.col("known"), "resolved").when(F.col("field_id").isNotNull(), "unknown").when(F.col("target").isNull(), "malformed").otherwise("by_name")
    return rows.select("card_id", "label", "target", "field_id", "source_field", "join_alias", status.alias("status"))


def result_fields(cards: DataFrame) -> DataFrame:
    """(source_card, name, field_id): columns of a card's ``result_metadata`` that stand for a field, each as often as it is there."""
    level = _started(cards, "result_metadata").where(F.schema_of_variant("v").startswith("ARRAY"))
    at = lambda i: F.try_variant_get("v", f"$.field_ref[{i}]", "variant")
    target = F.when(F.schema_of_variant(at(1)).startswith("OBJECT"), at(2)).otherwise(at(1))
    rows = _exploded(level).where(F.try_variant_get("v", "$.field_ref[0]", "string") == "field").where(F.schema_of_variant(target) == "BIGINT")
    return rows.select(F.col("card_id").alias("source_card"), F.try_variant_get("v", "$.name", "string").alias("name"), F.try_variant_get(target, "$", "bigint").alias("field_id"))


def resolve_refs_by_name(refs: DataFrame, context: DataFrame, fields: DataFrame, joins: DataFrame, consumed: DataFrame, results: DataFrame) -> DataFrame:
    """(card_id, label, target, field_id, confidence) of references by name; field_id is null where none or several answer.

    ``joins`` are those of :func:`join_scopes`: an alias is looked up in the reference's own
    level, so another level may mean another table by it, and a reference gives one row.
    In order: the table of the join alias, which is final; the source table; the
    columns of that very name in the upstream card's ``results`` (see :func:`result_fields`),
    final if there are any; the unique field of that name among what the upstream card consumes, which is only parsed. An alias
    without a table makes the rest parsed.
    """
    named = fields.groupBy("table_id", F.lower("column_name").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.min("field_id").alias("f"))
    one = named.where("n = 1").drop("n")
    scopes = joins.select("card_id", "level", F.col("alias").alias("join_alias"), F.col("table_id").alias("alias_table"), F.lit(True).alias("mapped"))
    rows = refs.withColumn("low", F.lower("target")).join(scopes, ["card_id", "level", "join_alias"], "left").join(context, "card_id", "left")
    rows = rows.join(one.toDF("alias_table", "low", "by_alias"), ["alias_table", "low"], "left").join(one.toDF("table_id", "low", "by_table"), ["table_id", "low"], "left")
    upstream = consumed.join(fields.select("field_id", F.lower("column_name").alias("low")), "field_id").groupBy(F.col("card_id").alias("source_card"), "low").agg(F.count_distinct("field_id").alias("n"), F.min("field_id").alias("by_card")).where("n = 1").drop("n")
    rows = rows.join(upstream, ["source_card", "low"], "left")
    known = fields.select("field_id", F.lit(True).alias("known")).distinct()
    shown = results.join(known, "field_id", "left").groupBy("source_card", F.col("name").alias("target")).agg(F.when((F.count(F.lit(1)) == 1) & F.bool_or("known"), F.min("field_id")).alias("by_result"), F.lit(True).alias("shown"))
    rows = rows.join(shown, ["source_card", "target"], "left")
    final = F.col("mapped") & F.col("alias_table").isNotNull()
    field = F.when(final, F.col("by_alias")).otherwise(F.coalesce("by_table", F.when(F.col("shown"), F.col("by_result")).otherwise(F.col("by_card"))))
    sure = F.when(final, F.lit(True)).otherwise((F.col("by_table").isNotNull() | F.col("shown").isNotNull()) & F.col("join_alias").isNull())
    return rows.select("card_id", "label", "target", field.alias("field_id"), F.when(field.isNotNull(), F.when(sure, "exact").otherwise("parsed")).alias("confidence"))


def consumption(refs: DataFrame) -> DataFrame:
    """(card_id, field_id, clauses, implicit_join): one row for each field of a card."""
    return refs.groupBy("card_id", "field_id").agg(joined(F.col("clause")).alias("clauses"), F.bool_or("implicit_join").alias("implicit_join"))


def native_template_tags(native: DataFrame) -> DataFrame:
    """(card_id, tag, kind) of every distinct ``{{tag}}``; what stands in ``[[ ]]`` counts too."""
    text = F.regexp_replace("sql", r"\[\[|\]\]", " ")
    tags = native.select("card_id", F.explode(F.regexp_extract_all(text, F.lit(r"\{\{\s*([^{}]+?)\s*\}\}"), 1)).alias("tag")).distinct()
    kind = F.when(F.col("tag").startswith("#"), "card").when(F.lower("tag").startswith("snippet:"), "snippet").otherwise("variable")
    return tags.select("card_id", "tag", kind.alias("kind"))


def _tokens(sql: Column) -> Column:
    """The distinct ``{{ .. }}`` of a text."""
    return F.array_distinct(F.regexp_extract_all(sql, F.lit(r"(\{\{[^{}]*\}\})"), 1))


def _inner(token: Column) -> Column:
    return F.trim(F.regexp_replace(token, r"^\{\{\s*|\s*\}\}$", ""))


def _filled(sql: Column, held: Column) -> Column:
    """``sql`` with each ``token`` of ``held`` replaced by its ``text``."""
    none = F.array().cast("array<struct<token:string,text:string>>")
    return F.aggregate(F.coalesce(held, none), sql, lambda s, t: F.replace(s, t["token"], t["text"]))


def substitute_tags(native: DataFrame, tags: DataFrame) -> DataFrame:
    """(card_id, sql) with a neutral literal for every tag; what stands in ``[[ ]]`` stays.

    White space inside the braces does not count. ``#id`` and tags of kind card read
    a placeholder query; a tag without a kind is a text.
    """
    literal = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in {**LITERALS, "card": CARD_PLACEHOLDER}.items() for x in kv)), F.col("kind")), F.lit(DEFAULT_LITERAL))
    said = tags.groupBy("card_id", F.trim("tag").alias("inner")).agg(F.min("kind").alias("kind")).select("card_id", "inner", literal.alias("text"))
    rows = native.select("card_id", F.regexp_replace("sql", r"(?s)\[\[(.*?)\]\]", "$1").alias("sql"))
    asked = rows.select("card_id", F.explode(_tokens(F.col("sql"))).alias("token")).withColumn("inner", _inner(F.col("token"))).join(said, ["card_id", "inner"], "left")
    text = F.when(F.col("inner").rlike(r"^#\s*\d+"), F.lit(CARD_PLACEHOLDER)).otherwise(F.coalesce("text", F.lit(DEFAULT_LITERAL)))
    held = asked.groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("token", text.alias("text")))).alias("held"))
    return rows.join(held, "card_id", "left").select("card_id", _filled(F.col("sql"), F.col("held")).alias("sql"))


def inline_snippets(native: DataFrame, snippets: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(card_id, sql, missing): snippets put in place by folded name, else by id, nested ones up to the depth.

    A snippet is named by ``{{snippet: name}}`` or by a tag of kind snippet in
    ``tags(card_id, tag, kind, snippet_name, snippet_id)``. Unknown or deeper ones
    become nothing and are counted, a distinct one once a level. One row a card.
    """
    by_name = snippets.groupBy(F.lower("name").alias("low")).agg(F.min_by("content", "snippet_id").alias("named"))
    by_id = snippets.groupBy("snippet_id").agg(F.min("content").alias("numbered"))
    if tags is None:
        tags = native.select("card_id", *(F.lit(None).cast(kind).alias(c) for c, kind in (("tag", "string"), ("kind", "string"), ("snippet_name", "string"), ("snippet_id", "bigint")))).limit(0)
    said = tags.where("kind = 'snippet'").groupBy("card_id", F.trim("tag").alias("inner")).agg(F.min("snippet_name").alias("snippet_name"), F.min("snippet_id").alias("snippet_id"), F.lit(True).alias("typed"))
    rows = native.select("card_id", "sql", F.lit(0).cast("bigint").alias("missing"))
    for depth in range(SNIPPET_DEPTH + 1):
        asked = rows.select("card_id", F.explode(_tokens(F.col("sql"))).alias("token")).withColumn("inner", _inner(F.col("token"))).join(said, ["card_id", "inner"], "left")
        called = F.regexp_extract("inner", r"(?i)^snippet:\s*(.*)$", 1)
        asked = asked.where(F.col("typed") | F.col("inner").rlike("(?i)^snippet:")).withColumn("low", F.lower(F.when(F.col("inner").rlike("(?i)^snippet:"), called).otherwise(F.coalesce("snippet_name", F.lit("")))))
        found = asked.join(by_name, "low", "left").join(by_id, "snippet_id", "left")
        content = F.coalesce("named", "numbered") if depth < SNIPPET_DEPTH else F.lit(None).cast("string")
        held = found.groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("token", F.coalesce(content, F.lit("")).alias("text")))).alias("held"), F.count_if(content.isNull()).alias("gone"))
        rows = rows.join(held, "card_id", "left").select("card_id", _filled(F.col("sql"), F.col("held")).alias("sql"), (F.col("missing") + F.coalesce("gone", F.lit(0))).alias("missing"))
    return rows


def dimension_tag_fields(tags: DataFrame, fields: DataFrame) -> DataFrame:
    """(card_id, tag, field_id, known) of field-filter tags."""
    ids = fields.select("field_id", F.lit(True).alias("known"))
    return tags.where("kind = 'dimension'").join(ids, "field_id", "left").select("card_id", "tag", "field_id", F.coalesce("known", F.lit(False)).alias("known"))


def native_card_refs(native: DataFrame, tags: DataFrame) -> DataFrame:
    """(card_id, upstream): ``{{#id}}`` in the SQL, and tags of kind card."""
    ids = native.select("card_id", F.explode(F.regexp_extract_all("sql", F.lit(r"\{\{\s*#\s*(\d+)"), 1)).alias("u")).select("card_id", F.col("u").cast("bigint").alias("upstream"))
    return ids.union(tags.where("kind = 'card'").select("card_id", "ref_card")).where("upstream is not null").distinct()


def native_tables(native: DataFrame, tables: DataFrame) -> DataFrame:
    """(card_id, table_id): targets of FROM and JOIN that are tables; a bare name only if one table has it."""
    found = native.select("card_id", F.explode(F.regexp_extract_all(F.lower("sql"), F.lit(r"\b(?:from|join)\s+([a-z_][\w.\"]*)"), 1)).alias("name")).distinct()
    bare = tables.groupBy(F.lower("table_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("table_id").alias("table_id")).where("n = 1").select("name", "table_id")
    full = tables.select(F.lower(F.concat("schema_name", F.lit("."), "table_name")).alias("name"), "table_id")
    two = F.substring_index(F.replace("name", F.lit('"'), F.lit("")), ".", -2)
    return found.withColumn("name", two).join(bare.union(full), "name").select("card_id", "table_id").distinct()


def native_column_refs(parsed: DataFrame, fields: DataFrame) -> DataFrame:
    """(card_id, field_id, confidence) of parsed (card_id, table_name, column_name); a missing column has a null field.

    A reference without a table belongs to the card's only table, if it has one; exact wins over parsed.
    """
    only = parsed.where("table_name is not null").groupBy("card_id").agg(F.count_distinct(F.lower("table_name")).alias("n"), F.min(F.lower("table_name")).alias("t")).where("n = 1").select("card_id", "t")
    rows = parsed.join(only, "card_id", "left").withColumn("t", F.coalesce(F.lower("table_name"), "t"))
    known = fields.groupBy(F.lower("table_name").alias("t"), F.lower("column_name").alias("c")).agg(F.min("field_id").alias("field_id"))
    found = rows.withColumn("c", F.lower("column_name")).join(known, ["t", "c"], "left")
    return found.groupBy("card_id", "c", "field_id").agg(F.min("confidence").alias("confidence")).select("card_id", F.col("c").alias("column_name"), "field_id", F.when(F.col("field_id").isNotNull(), F.col("confidence")).alias("confidence"))


def parsed_sources(deps: DataFrame, native: DataFrame) -> DataFrame:
    """(card_id): native cards and all cards that read them, however far; straight lines of cards are taken at once."""
    reads = settled(deps.where("card_id <> upstream").select(F.col("card_id").alias("f"), F.col("upstream").alias("t")).distinct())

    def closure(left: DataFrame, seeds: DataFrame) -> DataFrame:
        back = Hops(left.select(F.col("t").alias("f"), F.col("f").alias("t")))
        step = lambda frontier, _: back.follow(frontier, "node").select(F.col("t").alias("node")).distinct()
        return spread_in_buckets(seeds, step, ["node"], back.buckets)

    return reached_back(reads, native.select(F.col("card_id").alias("node")).distinct(), closure).select(F.col("node").alias("card_id"))


def _field_words(deps: DataFrame, consumed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(own, inherited, numbers): fields as bits of words at each card, (node, kind, block, w): its own, and those of all cards it reads; cycles end."""
    seeds = consumed.select(F.col("card_id").alias("node"), F.lit("").alias("kind"), F.col("field_id").alias("label")).distinct()
    numbers = packed.numbered_labels(seeds)
    own = settled(packed.seeded(seeds, numbers, ["w"]))
    hops = Hops(deps.select(F.col("upstream").alias("f"), F.col("card_id").alias("t")).distinct())
    rounds, _ = packed.walk(hops, own, ["w"])
    met = reduce(DataFrame.union, [r.select(*packed.KEY, "w") for r in rounds]) if rounds else own.limit(0)
    return own, settled(met.groupBy(packed.KEY).agg(F.bit_or("w").alias("w"))), numbers


def transitive_fields(deps: DataFrame, consumed: DataFrame) -> DataFrame:
    """(card_id, field_id): fields that a card inherits from the cards it reads."""
    _, met, numbers = _field_words(deps, consumed)
    return packed.unpacked(met, numbers, ["w"]).select(F.col("node").alias("card_id"), F.col("label").alias("field_id"))


def consumed_by_edges(direct: DataFrame, deps: DataFrame, parsed: DataFrame) -> DataFrame:
    """(f, t, confidence, via): direct edges, then one for each inherited field, through the first upstream card that gives it.

    ``deps(card_id, upstream, ord)``: the first is by ``ord``, the order in which the query names its cards.
    """
    own, met, numbers = _field_words(deps, direct)
    whole = own.union(met).groupBy(packed.KEY).agg(F.bit_or("w").alias("w"))
    named = deps.where("card_id <> upstream").groupBy("card_id", "upstream").agg(F.min("ord").alias("ord"))
    given = named.join(whole.withColumnRenamed("node", "upstream"), "upstream").withColumnRenamed("card_id", "node")
    given = given.join(own.withColumnRenamed("w", "mine"), packed.KEY, "left").withColumn("w", packed.without("w", "mine"))
    # What cards named earlier give is taken off.
    w = Window.partitionBy(packed.KEY).orderBy("ord", "upstream").rowsBetween(Window.unboundedPreceding, -1)
    first = given.withColumn("before", F.bit_or("w").over(w)).withColumn("w", packed.without("w", "before")).where("w <> 0")
    weak = parsed.select(F.col("card_id").alias("upstream"), F.lit("parsed").alias("weak")).distinct()
    through = packed.unpacked(first, numbers, ["w"], "upstream").join(weak, "upstream", "left")
    rows = direct.groupBy("card_id", "field_id").agg(F.min("confidence").alias("confidence"), F.lit(None).cast("bigint").alias("via"))
    rows = rows.union(through.select(F.col("node").alias("card_id"), F.col("label").alias("field_id"), F.coalesce("weak", F.lit("exact")), "upstream"))
    return rows.select(F.concat(F.lit("mb_field::"), "field_id").alias("f"), F.concat(F.lit("mb_card::"), "card_id").alias("t"), "confidence", "via")


def upstream_problems(deps: DataFrame, cards: DataFrame, walked: DataFrame) -> DataFrame:
    """(card_id, ref, reason): cards that a query names but that give nothing: unknown or out of scope, or without a query to walk."""
    known = cards.select(F.col("card_id").alias("upstream"), F.lit(True).alias("known")).distinct()
    open_ = walked.select(F.col("card_id").alias("upstream"), F.lit(True).alias("walked")).distinct()
    rows = deps.select("card_id", "upstream").distinct().join(known, "upstream", "left").join(open_, "upstream", "left").where("walked is null")
    reason = F.when(F.col("known"), "card without a query to walk").otherwise("card missing or out of scope")
    return rows.select("card_id", F.concat(F.lit("card__"), "upstream").alias("ref"), reason.alias("reason"))


def card_nodes(cards: DataFrame, users: DataFrame, paths: DataFrame) -> DataFrame:
    """Card rows with their creator's common name, else email, else id, and the path of their collection."""
    return cards.join(users, "creator", "left").join(paths, "collection_id", "left").select("node_id", "name", F.coalesce("common_name", "email", "creator").alias("creator"), F.col("path").alias("collection_path"), "query_type", "archived")


def card_resolution(cards: DataFrame, problems: DataFrame) -> DataFrame:
    """(query_type, total, resolved): cards without a problem are resolved."""
    bad = problems.select("card_id").distinct().withColumn("bad", F.lit(True))
    return cards.join(bad, "card_id", "left").groupBy("query_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("bad").isNull()).alias("resolved"))


def appears_on_edges(dashcards: DataFrame, cards: DataFrame) -> DataFrame:
    """(f, t, dashcard_id): distinct known cards on dashboards, by the first place; virtual cards (null) are none."""
    known = dashcards.where("card_id is not null").join(cards.select("card_id"), "card_id", "left_semi")
    return known.groupBy(F.concat(F.lit("mb_card::"), "card_id").alias("f"), F.col("dash_id").alias("t")).agg(F.min("dashcard_id").alias("dashcard_id"))


def dashboard_resolution(dashcards: DataFrame, cards: DataFrame) -> DataFrame:
    """(dash_id, resolved): whether every card on it that is not virtual is in scope."""
    known = cards.select("card_id", F.lit(True).alias("known"))
    rows = dashcards.join(known, "card_id", "left")
    return rows.groupBy("dash_id").agg(F.bool_and(F.col("card_id").isNull() | F.coalesce("known", F.lit(False))).alias("resolved"))


def unresolved(problems: Column) -> Column:
    """A text for the problems of a group."""
    return joined(problems, "; ")
