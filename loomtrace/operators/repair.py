"""Planning the repair of cards that a change breaks, on rows of their clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.numbering import numbered
from loomtrace.functions.text import joined
from loomtrace.operators.walk import card_depth

#: Clauses that are never essential, those that are if nothing survives in them, and those that always are.
NEVER, IF_EMPTY, ALWAYS = ["filter", "order-by"], ["fields", "breakout", "aggregation", "joins.fields"], ["expressions", "joins.condition"]
#: The order of actions in a report, and of outcomes.
ACTIONS, OUTCOMES = ["strip", "archive", "repoint", "notify"], ["applied", "notified", "skipped", "stale", "failed"]


def bound_fields(binds: DataFrame) -> DataFrame:
    """(col_id, field_id) of every binding once."""
    return binds.select("col_id", "field_id").distinct()


def affected_cards(removed: DataFrame, bound: DataFrame, uses: DataFrame) -> DataFrame:
    """(card_id, fields, via): cards that consume a removed column's field, directly or through others."""
    gone = bound.join(removed.select(F.col("node_id").alias("col_id")), "col_id", "left_semi")
    return uses.join(gone.select("field_id").distinct(), "field_id", "left_semi").groupBy("card_id").agg(F.count_distinct("field_id").alias("fields"), joined(F.col("via").cast("string")).alias("via"))


def resolve_renames(renames: DataFrame, removed: DataFrame, cand: DataFrame, bound: DataFrame) -> DataFrame:
    """``renames(old, new)`` with the new field and a complaint if one cannot be followed."""
    n = bound.groupBy(F.col("col_id").alias("new")).agg(F.count_distinct("field_id").alias("n"), F.min("field_id").alias("f"))
    rows = renames.join(removed.select(F.col("node_id").alias("old"), F.lit(True).alias("gone")), "old", "left").join(cand.select(F.col("node_id").alias("new"), F.lit(True).alias("there")), "new", "left").join(n, "new", "left")
    complaint = F.when(F.col("gone").isNull(), "old column was not removed").when(F.col("there").isNull(), "new column not found").when(F.coalesce("n", F.lit(0)) == 0, "new column is not bound").when(F.col("n") > 1, "new column is bound more than once")
    return rows.select("old", "new", F.when(complaint.isNull(), F.col("f")).alias("new_field"), complaint.alias("complaint"))


def repair_targets(removed: DataFrame, bound: DataFrame, renames: DataFrame) -> DataFrame:
    """(col_id, key_kind, key, new_field, blocked): how each removed column may be referred to, by field id and by folded name."""
    r = removed.select(F.col("node_id").alias("col_id"))
    by_id = r.join(bound, "col_id").select("col_id", F.lit("id").alias("key_kind"), F.col("field_id").cast("string").alias("key"))
    by_name = r.select("col_id", F.lit("name"), F.lower(F.substring_index("col_id", "::", -1)))
    told = renames.select(F.col("old").alias("col_id"), "new_field", F.col("complaint").alias("blocked"))
    return by_id.union(by_name).join(told, "col_id", "left")


def scan_dead_refs(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """(card_id, label, element, dead, source_dead, total): references of each clause and how many are dead."""
    ids = targets.where("key_kind = 'id'").select("key").distinct().withColumn("hit", F.lit(True))
    names = targets.where("key_kind = 'name'").select("key").distinct().withColumn("hit_name", F.lit(True))
    rows = refs.join(ids.toDF("target", "hit"), "target", "left").join(ids.toDF("source_field", "hit_source"), "source_field", "left").withColumn("low", F.lower("target")).join(names.toDF("low", "hit_name"), "low", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.groupBy("card_id", "label").agg(F.count_if(yes("hit") | yes("hit_name") | yes("hit_source")).alias("dead"), F.count_if(yes("hit_source")).alias("source_dead"), F.count(F.lit(1)).alias("total"))


def base_label(label: Column) -> Column:
    """A clause's own name, without the query levels in front."""
    return F.regexp_replace(label, r"^((source-query|stage\d+|joins\.source-query)\.)+", "")


def essential(scanned: DataFrame) -> DataFrame:
    """``scanned`` clauses with whether losing their dead references breaks the card."""
    base, empty = base_label(F.col("label")), F.col("dead") >= F.col("total")
    lost = F.when(base.isin(NEVER), F.lit(False)).when(base.isin(IF_EMPTY), empty).otherwise(F.lit(True))
    return scanned.withColumn("essential", (F.col("dead") > 0) & lost)


def classify_cards(affected: DataFrame, clauses: DataFrame, targets_hit: DataFrame, cards: DataFrame, quiet: DataFrame, auto: list[str]) -> DataFrame:
    """(card_id, action, downgraded_from, reason): exactly one action for each affected card.

    ``targets_hit(card_id, blocked, orphan)``. A native card, or one without references of its own, is
    only notified of; so is one with a blocked rename. Essential losses archive,
    orphans strip, the rest is repointed. A collection that is only notified, or an
    action outside ``auto``, turns it into a notice.
    """
    lost = clauses.groupBy("card_id").agg(F.bool_or("essential").alias("lost"), F.sum("dead").alias("dead"))
    hit = targets_hit.groupBy("card_id").agg(F.bool_or("blocked").alias("blocked"), F.bool_or("orphan").alias("orphan"))
    rows = affected.join(cards, "card_id").join(lost, "card_id", "left").join(hit, "card_id", "left").join(quiet.select("collection_id").distinct().withColumn("quiet", F.lit(True)), "collection_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    said = lambda action, why: F.struct(F.lit(action).alias("a"), F.lit(why).alias("r"))
    first = (
        F.when(F.col("query_type") == "native", said("notify", "native query")).when(F.coalesce("dead", F.lit(0)) == 0, said("notify", "only through another card"))
        .when(yes("blocked"), said("notify", "rename cannot be followed")).when(yes("lost"), said("archive", "an essential clause is lost"))
        .when(yes("orphan"), said("strip", "a column is gone")).otherwise(said("repoint", "all columns were renamed"))
    )
    rows = rows.withColumn("p", first)
    down = F.when(F.col("p.a") == "notify", None).when(yes("quiet"), "collection is only notified").when(~F.col("p.a").isin(auto), "action is not automatic")
    return rows.select("card_id", F.when(down.isNotNull(), "notify").otherwise(F.col("p.a")).alias("action"), F.when(down.isNotNull(), F.col("p.a")).alias("downgraded_from"), F.coalesce(down, F.col("p.r")).alias("reason"))


def repoint_refs(refs: DataFrame, moves: DataFrame) -> DataFrame:
    """References with their new target and source field; ``moves(old_field, new_field)``."""
    m = moves.select(F.col("old_field").cast("string").alias("o"), F.col("new_field").cast("string").alias("n"))
    rows = refs.join(m.toDF("target", "new_target"), "target", "left").join(m.toDF("source_field", "new_source"), "source_field", "left")
    return rows.select("card_id", "label", F.coalesce("new_target", "target").alias("target"), F.coalesce("new_source", "source_field").alias("source_field"), (F.col("new_target").isNotNull() | F.col("new_source").isNotNull()).alias("changed"))


def strip_elements(elements: DataFrame) -> DataFrame:
    """(card_id, label, survivors, result): each clause's elements without the dead ones.

    ``elements(card_id, label, place, text, dead, opaque)``. Of a filter one survivor
    replaces the whole; none removes the clause; a dead opaque element blocks it.
    """
    held = F.transform(F.array_sort(F.collect_list(F.when(~F.col("dead"), F.struct("place", "text")))), lambda x: x["text"])
    rows = elements.groupBy("card_id", "label").agg(held.alias("kept"), F.bool_or(F.col("dead") & F.col("opaque")).alias("blocked"), F.bool_or("dead").alias("any_dead"))
    n = F.size("kept")
    result = F.when(F.col("blocked"), "blocked").when(~F.col("any_dead"), "unchanged").when(n == 0, "removed").when((n == 1) & (base_label(F.col("label")) == "filter"), "collapsed").otherwise("trimmed")
    return rows.select("card_id", "label", F.array_join("kept", " | ").alias("survivors"), result.alias("result"))


def remap_aggregations(aggregations: DataFrame, refs: DataFrame) -> DataFrame:
    """(card_id, level, ref_id, new_index): references to aggregations by index after dead ones went; those to dead ones are dropped.

    Indexes shift within their own query level only.
    """
    w = Window.partitionBy("card_id", "level").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    shift = aggregations.withColumn("before", F.coalesce(F.sum(F.col("dead").cast("int")).over(w), F.lit(0))).where("not dead")
    return refs.join(shift.select("card_id", "level", "index", "before"), ["card_id", "level", "index"]).select("card_id", "level", "ref_id", (F.col("index") - F.col("before")).cast("int").alias("new_index"))


def dashcard_edits(mappings: DataFrame, dead: DataFrame, moves: DataFrame) -> DataFrame:
    """(dashcard_id, mappings): parameter mappings of the dashcards that change: repointed, or without dead ones."""
    m = moves.select(F.col("old_field").alias("field_id"), "new_field")
    rows = mappings.join(m, "field_id", "left").join(dead.select("field_id", F.lit(True).alias("dead")).distinct(), "field_id", "left")
    rows = rows.withColumn("after", F.when(F.col("new_field").isNotNull(), F.col("new_field")).when(F.col("dead"), None).otherwise(F.col("field_id")))
    pair = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.concat("parameter", F.lit(":"), F.col(c).cast("string")))))
    both = rows.groupBy("dashcard_id").agg(pair("field_id").alias("old"), pair("after").alias("new"))
    return both.where("old <> new").select("dashcard_id", F.array_join("new", ", ").alias("mappings"))


def dead_refs(hits: DataFrame) -> DataFrame:
    """(card_id, col_id, clauses, essential): one row for each dead column of a card."""
    return hits.groupBy("card_id", "col_id").agg(joined(F.col("label")).alias("clauses"), F.bool_or("essential").alias("essential"))


def order_plan(plans: DataFrame, cards: DataFrame, deps: DataFrame) -> DataFrame:
    """Plans of live, known cards with their place: upstream cards first, then by id; cards that read each other come together."""
    live = cards.where("not coalesce(archived, false)").select("card_id")
    depth = card_depth(cards, deps)
    rows = plans.join(live, "card_id", "left_semi").join(depth, "card_id")
    return numbered(rows, F.col("depth"), F.col("card_id"), out="place")


def reconcile_plan(plan: DataFrame, current: DataFrame, force: bool = False) -> DataFrame:
    """(card_id, status) before anything is written, against ``current(card_id, can_write, updated_at)``."""
    now = current.select("card_id", "can_write", F.col("updated_at").alias("now"), F.lit(True).alias("there"))
    rows = plan.join(now, "card_id", "left")
    status = F.when(F.col("action") == "notify", "notify").when(F.col("there").isNull(), "failed").when(~F.coalesce("can_write", F.lit(True)), "skipped").when(~F.col("now").eqNullSafe(F.col("updated_at")) & ~F.lit(force), "stale").otherwise("ready")
    return rows.select("card_id", "action", status.alias("status"))


def outcome_rollup(outcomes: DataFrame) -> DataFrame:
    """(status, n, strips, failed): outcomes in a fixed order; one failed if its status is no success or it carries an error."""
    bad = ~F.col("status").isin("applied", "notified", "skipped") | F.col("error").isNotNull()
    place = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("status")).cast("int")
    return outcomes.groupBy("status", place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "strip").alias("strips"), F.bool_or(bad).alias("failed"))


def plan_report(plan: DataFrame) -> DataFrame:
    """(line_no, line): counts by action in their order, then one line for each card."""
    place = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action")).cast("int")
    heads = plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")).select(place.alias("p"), F.lit(-1).cast("bigint").alias("card_id"), F.concat("action", F.lit(": "), "n").alias("line"))
    rows = plan.select(place.alias("p"), "card_id", F.concat(F.lit("  #"), "card_id", F.lit(" "), "reason").alias("line"))
    return numbered(heads.union(rows), F.col("p"), F.col("card_id"), out="line_no").select("line_no", "line")


def write_access_summary(cards: DataFrame) -> DataFrame:
    return cards.agg(F.count_if(F.col("can_write").eqNullSafe(True)).alias("writable"), F.count_if(F.col("can_write").eqNullSafe(False)).alias("refused"), F.count_if(F.col("can_write").isNull()).alias("unknown"))
