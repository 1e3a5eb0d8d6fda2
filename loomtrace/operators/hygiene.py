"""What nobody uses: dead columns, models and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.text import joined


def unconsumed_columns(nodes: DataFrame, live: DataFrame) -> DataFrame:
    """(owner_id, n_dead, n_columns, whole_owner, columns): columns that feed no consumer, by owner."""
    columns = nodes.where("node_type = 'column'").select("node_id", "owner_id", "name")
    total = columns.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n_columns"))
    dead = columns.join(live, "node_id", "left_anti").groupBy("owner_id").agg(F.count(F.lit(1)).alias("n_dead"), joined(F.col("name")).alias("columns"))
    return dead.join(total, "owner_id").select("owner_id", "n_dead", "n_columns", (F.col("n_dead") == F.col("n_columns")).alias("whole_owner"), "columns")


def dead_models(nodes: DataFrame, live: DataFrame) -> DataFrame:
    """(node_id, name, n_columns): models that feed no consumer; sources are never among them."""
    total = nodes.where("node_type = 'column'").groupBy(F.col("owner_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_columns"))
    models = nodes.where("node_type = 'model'").select("node_id", "name").join(live, "node_id", "left_anti")
    return models.join(total, "node_id", "left").select("node_id", "name", F.coalesce("n_columns", F.lit(0)).alias("n_columns"))


def archived_cards_bound(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(card, name, columns, n_columns): archived cards that still read bound columns."""
    cards = nodes.where("node_type = 'mb_card' and archived").select(F.col("node_id").alias("card"), "name")
    uses = edges.where("edge_type = 'consumed_by'").select(F.col("f").alias("field"), F.col("t").alias("card"))
    binds = edges.where("edge_type = 'binds_to'").select(F.col("f").alias("node_id"), F.col("t").alias("field"))
    columns = nodes.where("node_type = 'column'").select("node_id", "owner_id", F.col("name").alias("column"))
    owners = nodes.select(F.col("node_id").alias("owner_id"), F.col("name").alias("owner"))
    found = cards.join(uses, "card").join(binds, "field").join(columns, "node_id").join(owners, "owner_id", "left")
    text = F.concat(F.coalesce("owner", "owner_id"), F.lit("."), "column")
    return found.groupBy("card", "name").agg(joined(text).alias("columns"), F.count_distinct("node_id").alias("n_columns"))


def cards_only_on_archived_dashboards(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(card, n_dashboards): live cards that lie on dashboards, all of them archived."""
    cards = nodes.where("node_type = 'mb_card' and not coalesce(archived, false)").select(F.col("node_id").alias("card"))
    boards = nodes.where("node_type = 'mb_dashboard'").select(F.col("node_id").alias("board"), F.coalesce("archived", F.lit(False)).alias("gone"))
    on = edges.where("edge_type = 'appears_on'").select(F.col("f").alias("card"), F.col("t").alias("board")).distinct()
    found = on.join(cards, "card").join(boards, "board").groupBy("card").agg(F.bool_and("gone").alias("all_gone"), F.count(F.lit(1)).alias("n_dashboards"))
    return found.where("all_gone").select("card", "n_dashboards")


def dead_totals(nodes: DataFrame, dead_columns: DataFrame, models: DataFrame, archived: DataFrame, stranded: DataFrame) -> DataFrame:
    """One row of totals; vacuous if there is no card at all, for then everything seems dead."""
    count = lambda df, name, what=F.lit(1): df.agg(F.coalesce(F.sum(what), F.lit(0)).alias(name))
    parts = [count(models, "models"), count(archived, "archived_cards"), count(stranded, "stranded_cards"), nodes.agg(F.count_if(F.col("node_type") == "mb_card").alias("n_cards"))]
    out = count(dead_columns, "columns", F.col("n_dead"))
    for p in parts:
        out = out.join(p)
    empty = F.col("columns") + F.col("models") + F.col("archived_cards") + F.col("stranded_cards") == 0
    return out.select("columns", "models", "archived_cards", "stranded_cards", empty.alias("empty"), (F.col("n_cards") == 0).alias("vacuous"))
