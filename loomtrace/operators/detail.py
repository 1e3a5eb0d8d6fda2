"""Analytics of single models, columns, cards and dashboards, and of scopes of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.numbering import numbered
from loomtrace.functions.text import STEPS, joined, rank, word
from loomtrace.operators import packed
from loomtrace.operators.graph import flow_edges

#: Suggestions and neighbours that a view shows.
SHOWN, STAR, STARTS = 30, 10, 6
#: Fixed value: names of schemas that hold intermediate work.
INTERNAL = "(?i)stag|int|tmp|raw|scratch"


def _labels(rows: DataFrame, kind: str, label: str = "node_id") -> DataFrame:
    return rows.select(F.col("node_id").alias("node"), F.lit(kind).alias("kind"), F.col(label).alias("label")).where("label is not null")


def _turned(flow: DataFrame) -> DataFrame:
    return flow.select(F.col("t").alias("f"), F.col("f").alias("t"))


def _answers(starts: DataFrame, parts: list[DataFrame], names: list[str], *more: str) -> DataFrame:
    """One row for each of ``starts(node_id)``, with zeros for what it lacks."""
    rows = starts.select(F.col("node_id").alias("node"))
    for part in parts:
        rows = rows.join(part, "node", "left")
    return rows.select(F.col("node").alias("start"), *(F.coalesce(c, F.lit(0)).alias(c) for c in names), *more)


def column_detail(nodes: DataFrame, edges: DataFrame, columns: DataFrame) -> DataFrame:
    """(start, up_columns, up_sources, down_columns, down_models, fields, cards, dashboards, relationships) of each of ``columns(node_id)``.

    What lies above and below is counted for all nodes at once, as bits of words; a
    relationship counts at either end.
    """
    flow, of = flow_edges(edges), lambda kind: nodes.where(F.col("node_type") == kind)
    up = packed.counts(packed.gathered(flow, _labels(of("column"), "up_columns").union(_labels(of("source"), "up_sources"))), ["up_columns", "up_sources"])
    kinds = {"fields": "mb_field", "cards": "mb_card", "dashboards": "mb_dashboard"}
    seeds = _labels(of("column"), "down_columns").union(_labels(of("column"), "down_models", "owner_id"))
    for name, kind in kinds.items():
        seeds = seeds.union(_labels(of(kind), name))
    below = ["down_columns", "down_models", *kinds]
    down = packed.counts(packed.gathered(_turned(flow), seeds), below)
    ends = edges.where("edge_type = 'relates_to'").select(F.explode(F.array_distinct(F.array("f", "t"))).alias("node"))
    touching = ends.groupBy("node").agg(F.count(F.lit(1)).alias("relationships"))
    return _answers(columns, [up, down, touching], ["up_columns", "up_sources", *below, "relationships"])


def bi_detail(nodes: DataFrame, edges: DataFrame, objects: DataFrame) -> DataFrame:
    """(start, columns, models, best, fields, unbound) of BI objects: what they depend on, and fields without a binding; counted as in :func:`column_detail`."""
    flow = flow_edges(edges)
    column, field = nodes.where("node_type = 'column'"), nodes.where("node_type = 'mb_field'")
    bound = edges.where("edge_type = 'binds_to'").select(F.col("t").alias("node_id")).distinct()
    seeds = _labels(column, "columns").union(_labels(column, "models", "owner_id")).union(_labels(field, "fields")).union(_labels(field.join(bound, "node_id", "left_anti"), "unbound"))
    found = packed.counts(packed.gathered(flow, seeds), ["columns", "models", "fields", "unbound"])
    ranked = flow.groupBy("f", "t").agg(F.max(rank(F.col("confidence"))).alias("rank"))
    best = packed.best_rank(ranked, column.select(F.col("node_id").alias("node")), [f"w{r}" for r in STEPS])
    rows = _answers(objects, [found, best], ["columns", "models", "fields", "unbound"], "best")
    return rows.select("start", "columns", "models", word(F.col("best")).alias("best"), "fields", "unbound")


def chain_gap(details: DataFrame, nodes: DataFrame, query_types: DataFrame) -> DataFrame:
    """(start, gap): why a BI object leads to no column; null if it does."""
    rows = details.join(nodes.select(F.col("node_id").alias("start"), "node_type"), "start").join(query_types.select(F.col("node_id").alias("start"), "query_type"), "start", "left")
    gap = (
        F.when(F.col("columns") > 0, None).when(F.col("node_type") == "mb_field", "field-unbound").when(F.col("unbound") > 0, "fields-unbound").when(F.col("node_type") == "mb_dashboard", "dashboard-unresolved")
        .when(F.col("query_type") == "native", "native-unresolved").otherwise("query-unresolved")
    )
    return rows.select("start", gap.alias("gap"))


def model_detail(nodes: DataFrame, edges: DataFrame, models: DataFrame) -> DataFrame:
    """(start, upstream, downstream, cards, dashboards, nearest): models by references, BI objects by the model's own columns; counted as in :func:`column_detail`."""
    flow = flow_edges(edges)
    refs = flow.where("edge_type = 'references'")
    ends = refs.select(F.col("f").alias("node_id")).union(refs.select("t")).distinct()
    up = packed.counts(packed.gathered(refs, _labels(ends, "upstream")), ["upstream"])
    down = packed.counts(packed.gathered(_turned(refs), _labels(ends, "downstream")), ["downstream"])
    seeds = _labels(nodes.where("node_type = 'mb_card'"), "cards").union(_labels(nodes.where("node_type = 'mb_dashboard'"), "dashboards"))
    own = nodes.where("node_type = 'column'").select(F.col("node_id").alias("node"), "owner_id")
    met = packed.gathered(_turned(flow), seeds).join(own, "node").drop("node").withColumnRenamed("owner_id", "node")
    met = met.groupBy(packed.KEY).agg(F.bit_or("w").alias("w"), F.min("near").alias("near"))
    bi = packed.counts(met, ["cards", "dashboards"]).join(met.groupBy("node").agg(F.min("near").alias("nearest")), "node")
    return _answers(models, [up, down, bi], ["upstream", "downstream", "cards", "dashboards"], "nearest")


def relationships_touching(relates: DataFrame, columns: DataFrame) -> DataFrame:
    """(node_id, direction, other, validated) of relationships at either end."""
    sure = (F.col("confidence") == "validated").alias("validated")
    out = relates.select(F.col("f").alias("node_id"), F.lit("out").alias("direction"), F.col("t").alias("other"), sure)
    back = relates.select(F.col("t"), F.lit("in"), F.col("f"), sure)
    return out.union(back).join(columns.select("node_id"), "node_id", "left_semi")


def layer_groups(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(start, layer, n, hops, near, far): reached models and sources by schema, sources as one."""
    rows = found.join(nodes.where("node_type in ('model', 'source')").select("node_id", "node_type", "schema_name"), "node_id")
    layer = F.when(F.col("node_type") == "source", F.lit("sources")).otherwise(F.col("schema_name"))
    out = rows.groupBy("start", layer.alias("layer")).agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("near"), F.max("depth").alias("far"))
    return out.withColumn("hops", F.when(F.col("near") == F.col("far"), F.col("near").cast("string")).otherwise(F.concat(F.col("near"), F.lit("-"), F.col("far"))))


def dashboard_groups(cards: DataFrame, dashcards: DataFrame) -> DataFrame:
    """(dash_id, n, place): cards by dashboard, busiest first; those on none come last."""
    on = dashcards.select("card_id", "dash_id").distinct()
    sums = cards.select("card_id").join(on, "card_id", "left").groupBy("dash_id").agg(F.count(F.lit(1)).alias("n"))
    return numbered(sums, F.col("dash_id").isNull(), F.desc("n"), F.col("dash_id"), out="place")


def model_pairs(relates: DataFrame, columns: DataFrame) -> DataFrame:
    """(f, t, a, b, validated): column relationships with the owners of their ends."""
    at = columns.select("node_id", "owner_id")
    return relates.join(at.toDF("f", "a"), "f").join(at.toDF("t", "b"), "t").select("f", "t", "a", "b", (F.col("confidence") == "validated").alias("validated"))


def erd_scopes(models: DataFrame, pairs: DataFrame) -> DataFrame:
    """(kind, scope, tables, relationships, internal): schemas and tags; a relationship counts once for each scope it touches."""
    scopes = models.select(F.lit("schema").alias("kind"), F.col("schema_name").alias("scope"), "node_id").union(models.where("tag is not null").select(F.lit("tag"), "tag", "node_id"))
    tables = scopes.groupBy("kind", "scope").agg(F.count_distinct("node_id").alias("tables"))
    ends = pairs.select("f", "t", F.explode(F.array("a", "b")).alias("node_id")).join(scopes, "node_id")
    rel = ends.groupBy("kind", "scope").agg(F.count_distinct("f", "t").alias("relationships"))
    return tables.join(rel, ["kind", "scope"], "left").select("kind", "scope", "tables", F.coalesce("relationships", F.lit(0)).alias("relationships"), F.col("scope").rlike(INTERNAL).alias("internal"))


def root_package(models: DataFrame) -> DataFrame:
    """One row: the package with most models, the first by name of several."""
    return models.groupBy("package").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "package").limit(1)


def default_scope(scopes: DataFrame, configured: str | None) -> DataFrame:
    """One row: the configured scope if it is there, else a schema that is not internal, else any schema, else any."""
    tier = F.when(F.col("scope") == F.lit(configured), 0).when((F.col("kind") == "schema") & ~F.col("internal"), 1).when(F.col("kind") == "schema", 2).otherwise(3)
    return scopes.withColumn("tier", tier).orderBy("tier", F.desc("tables"), "scope").limit(1).select("kind", "scope", "tier")


def erd_for_scope(members: DataFrame, pairs: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(part, a, b, n): tables in scope, tables outside at the other end, relationships that touch it, the first suggestions within it, and how many are hidden."""
    ids = members.select("node_id")
    inside = ids.select(F.lit("table").alias("part"), F.col("node_id").alias("a"), F.lit("").alias("b"), F.lit(1).cast("bigint").alias("n"))
    touch = pairs.join(ids.toDF("x").withColumn("in_a", F.lit(True)), F.col("a") == F.col("x"), "left").drop("x").join(ids.toDF("x").withColumn("in_b", F.lit(True)), F.col("b") == F.col("x"), "left").drop("x").where("in_a or in_b")
    outside = touch.select(F.explode(F.array(F.when(F.col("in_a").isNull(), F.col("a")), F.when(F.col("in_b").isNull(), F.col("b")))).alias("a")).where("a is not null").distinct().select(F.lit("external"), "a", F.lit(""), F.lit(1).cast("bigint"))
    rel = touch.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select(F.lit("relationship"), "a", "b", "n")
    within = suggestions.join(ids.toDF("from_id"), "from_id", "left_semi").join(ids.toDF("to_id"), "to_id", "left_semi").withColumn("k", F.row_number().over(Window.orderBy("place")))
    shown = within.where(F.col("k") <= SHOWN).select(F.lit("suggestion"), "from_id", "to_id", F.col("k").cast("bigint"))
    hidden = within.agg(F.count_if(F.col("k") > SHOWN).alias("n")).select(F.lit("hidden"), F.lit(""), F.lit(""), "n")
    return inside.union(outside).union(rel).union(shown).union(hidden)


def related_models(pairs: DataFrame, focus: DataFrame) -> DataFrame:
    """(focus, model): each model itself and those at the other end of any pair ``(a, b)`` that is drawn: declared, staged or suggested."""
    both = pairs.select(F.col("a").alias("focus"), F.col("b").alias("model")).union(pairs.select("b", "a"))
    mine = focus.select(F.col("node_id").alias("focus"))
    return both.join(mine, "focus", "left_semi").union(mine.select("focus", "focus")).distinct()


def focus_erd(pairs: DataFrame, focus: DataFrame) -> DataFrame:
    """(focus, a, b): for each model, the relationships among it and its direct neighbours."""
    near = related_models(pairs, focus)
    return pairs.select("a", "b").distinct().join(near.toDF("focus", "a"), "a").join(near.toDF("focus", "b"), ["focus", "b"]).select("focus", "a", "b")


def erd_counts(erd: DataFrame) -> DataFrame:
    """(part, n) of an ERD."""
    return erd.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def resolve_staged(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, from_id, to_id, resolved): names to ids; a model beats a source of the same name."""
    owners = nodes.where("node_type in ('model', 'source')").groupBy(F.lower("name").alias("low")).agg(F.min(F.struct((F.col("node_type") == "source").alias("s"), "node_id")).alias("m"))
    held = owners.select("low", F.col("m.node_id").alias("uid"))
    rows = entries.join(held.toDF("la", "from_id"), F.lower("from_model") == F.col("la"), "left").join(held.toDF("lb", "to_id"), F.lower("to_model") == F.col("lb"), "left")
    return rows.select("id", "from_id", "to_id", (F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).alias("resolved"))


def model_star(pairs: DataFrame, staged: DataFrame, limit: int = STAR) -> DataFrame:
    """(model, neighbour, joins, outgoing, incoming, validated, declared, hidden): each model's neighbours by number of joins.

    A join is a pair of own and other column, whatever its direction; of several a
    declared one wins over a staged one, then the first by its ends. ``outgoing``
    joins start at the model.
    """
    all_ = pairs.select("f", "t", "a", "b", "validated", F.lit(True).alias("declared")).union(staged.select("f", "t", "a", "b", F.lit(False), F.lit(False))).where("a <> b")
    out = all_.select(F.col("a").alias("model"), F.col("b").alias("neighbour"), F.col("f").alias("own"), F.col("t").alias("other"), F.lit(True).alias("out"), "validated", "declared")
    both = out.union(all_.select("b", "a", "t", "f", F.lit(False), "validated", "declared"))
    first = F.min(F.struct((~F.col("declared")).alias("late"), (~F.col("out")).alias("in"), (~F.col("validated")).alias("open"))).alias("x")
    one = both.groupBy("model", "neighbour", "own", "other").agg(first)
    sums = one.groupBy("model", "neighbour").agg(F.count(F.lit(1)).alias("joins"), F.count_if(~F.col("x.in")).alias("outgoing"), F.count_if("x.in").alias("incoming"), F.bool_or(~F.col("x.open")).alias("validated"), F.bool_or(~F.col("x.late")).alias("declared"))
    w = Window.partitionBy("model")
    ranked = sums.withColumns({"k": F.row_number().over(w.orderBy(F.desc("joins"), "neighbour")), "all": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("k") <= limit).select("model", "neighbour", "joins", "outgoing", "incoming", "validated", "declared", F.greatest(F.col("all") - limit, F.lit(0)).alias("hidden"))


def starting_points(rolled: DataFrame, nodes: DataFrame, limit: int = STARTS) -> DataFrame:
    """(kind, node_id, n, place): models by distinct cards next to them, dashboards by cards."""
    kinds = nodes.select("node_id", "node_type")
    to_card = rolled.join(kinds.toDF("f", "fk"), "f").join(kinds.toDF("t", "tk"), "t")
    models = to_card.where("fk = 'model' and tk = 'mb_card'").groupBy(F.lit("model").alias("kind"), F.col("f").alias("node_id")).agg(F.count_distinct("t").alias("n"))
    boards = to_card.where("fk = 'mb_card' and tk = 'mb_dashboard'").groupBy(F.lit("dashboard").alias("kind"), F.col("t").alias("node_id")).agg(F.count_distinct("f").alias("n"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "node_id"))
    return models.union(boards).withColumn("place", place).where(F.col("place") <= limit)


def coverage_rows(counts: DataFrame) -> DataFrame:
    """``counts(kind, value, total)`` with gap, percent and a note."""
    percent = F.when(F.col("total") > 0, F.round(100.0 * F.col("value") / F.col("total"), 1))
    note = F.when(F.col("total") == 0, "nothing to cover").when(F.col("value") == F.col("total"), "complete").otherwise(F.concat((F.col("total") - F.col("value")).cast("string"), F.lit(" left")))
    return counts.select("kind", "value", "total", (F.col("total") - F.col("value")).alias("gap"), percent.alias("percent"), note.alias("note"))


def coverage_list(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, name, known) of what a coverage counter left out."""
    return ids.join(nodes.select("node_id", "name", F.lit(True).alias("there")), "node_id", "left").select("node_id", F.coalesce("name", "node_id").alias("name"), F.coalesce("there", F.lit(False)).alias("known"))


def untraced_groups(traces: DataFrame, by: str) -> DataFrame:
    """(by, n, columns, place): untraced columns by reason or model, largest first."""
    sums = traces.groupBy(F.coalesce(by, F.lit("unknown")).alias(by)).agg(F.count(F.lit(1)).alias("n"), joined(F.col("output")).alias("columns"))
    return numbered(sums, F.desc("n"), F.col(by), out="place")


def manager_of(nodes: DataFrame) -> DataFrame:
    """(node_id, manager): who keeps a node: the project, the warehouse or the BI tool."""
    kind = F.col("node_type")
    manager = F.when(kind.startswith("mb_"), "metabase").when((kind == "source") | ((kind == "column") & F.col("owner_id").startswith("source.")), "snowflake").otherwise("dbt")
    return nodes.select("node_id", manager.alias("manager"))


def display_names(nodes: DataFrame, prefixes: list[str]) -> DataFrame:
    """(node_id, display): names of models, sources and tables without the first prefix that fits, never empty."""
    shown: Column = F.col("name")
    for p in reversed(prefixes):
        fits = F.lower("name").startswith(p.lower()) & (F.length("name") > len(p))
        shown = F.when(fits, F.expr(f"substring(name, {len(p) + 1})")).otherwise(shown)
    return nodes.select("node_id", F.when(F.col("node_type").isin("model", "source"), shown).otherwise(F.col("name")).alias("display"))
