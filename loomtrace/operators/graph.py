"""Graph tables: assembling, merging, comparing, snapshots and baselines.

Nodes have ``node_id`` and ``node_type``; edges have ``f``, ``t``, ``edge_type`` and
``confidence`` and always point downstream. An edge is known by (f, t, edge_type).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.text import NODE_TYPES, owner_of, type_order
from loomtrace.plans.closure import relax

EDGE_KEY = ["f", "t", "edge_type"]
#: Snapshots kept, and ancestors looked at for a baseline.
RETENTION, ANCESTORS = 20, 200


def qualify(df: DataFrame, estate: str, ids: list[str]) -> DataFrame:
    """Ids with their estate in front, so that one table holds a fleet and every join stays within an estate."""
    return df.withColumns({c: F.concat(F.col(estate), F.lit("/"), F.col(c)) for c in ids})


def flow_edges(edges: DataFrame) -> DataFrame:
    """Edges along which data flows; declared relationships are not."""
    return edges.where("edge_type <> 'relates_to'")


def assemble_graph(*parts: DataFrame) -> DataFrame:
    """The union of node or edge parts; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_edges(edges: DataFrame, new: DataFrame, ordinal: str) -> DataFrame:
    """``edges`` and those of ``new`` whose key is new to them, the first of each key by ``ordinal``."""
    first = new.withColumn("_k", F.row_number().over(Window.partitionBy(*EDGE_KEY).orderBy(ordinal))).where("_k = 1")
    added = first.join(edges, EDGE_KEY, "left_anti").select(*edges.columns)
    return edges.withColumn("added", F.lit(False)).union(added.withColumn("added", F.lit(True)))


def digest(df: DataFrame) -> DataFrame:
    """Rows and two order-free digests of a table."""
    h = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)))
    return df.select(h.alias("h")).agg(F.count("h").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"), F.bit_xor("h").alias("mixed"))


def graphs_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two tables hold the same rows, whatever their order, and the rows that only one has."""
    cols = sorted(a.columns)
    left = a.select(cols).exceptAll(b.select(cols)).agg(F.count(F.lit(1)).alias("only_first"))
    right = b.select(cols).exceptAll(a.select(cols)).agg(F.count(F.lit(1)).alias("only_second"))
    return left.join(right).select("only_first", "only_second", (F.col("only_first") + F.col("only_second") == 0).alias("equal"))


def diff_columns(base: DataFrame, cand: DataFrame) -> DataFrame:
    """(node_id, change, old_type, new_type) of columns removed, added or of another type; a rename is both of the first."""
    b = base.select("node_id", F.col("data_type").alias("old_type"), F.lit(True).alias("was"))
    c = cand.select("node_id", F.col("data_type").alias("new_type"), F.lit(True).alias("is"))
    change = F.when(F.col("is").isNull(), "removed").when(F.col("was").isNull(), "added").when(~F.col("old_type").eqNullSafe(F.col("new_type")), "type_changed")
    return b.join(c, "node_id", "full").select("node_id", change.alias("change"), "old_type", "new_type").where("change is not null")


def reuse_bi_side(base_nodes: DataFrame, base_edges: DataFrame, nodes: DataFrame, edges: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New project nodes and edges with the BI side of the baseline and fresh bindings."""
    bi = base_nodes.where(F.col("node_type").startswith("mb_"))
    kept = base_edges.where(F.col("edge_type").isin("consumed_by", "appears_on"))
    own = edges.where(~F.col("edge_type").isin("consumed_by", "appears_on", "binds_to"))
    return assemble_graph(nodes.where(~F.col("node_type").startswith("mb_")), bi), assemble_graph(own, kept, bound)


def store_snapshot(snapshots: DataFrame, retention: int = RETENTION) -> DataFrame:
    """The newest ``retention`` snapshots of (sha, seq); storing a sha again moves it to its newest slot."""
    last = snapshots.groupBy("sha").agg(F.max("seq").alias("seq"))
    kept = last.orderBy(F.desc("seq")).limit(max(retention, 0))
    return kept.withColumn("slot", F.row_number().over(Window.orderBy(F.desc("seq"))))


def previous_snapshot(snapshots: DataFrame, within: str) -> DataFrame:
    """Each snapshot with the one stored just before it."""
    return snapshots.withColumn("previous", F.lag("sha").over(Window.partitionBy(within).orderBy("seq")))


def resolve_baseline(commits: DataFrame, most: int = ANCESTORS) -> DataFrame:
    """(sha, baseline, distance): the nearest first-parent ancestor, itself included, that is stored.

    ``commits(sha, first_parent, stored)``. Pointers double, so ``most`` steps back
    take log2 rounds.
    """
    start = commits.select("sha", F.when(F.col("stored"), F.col("sha")).otherwise(F.col("first_parent")).alias("at"), F.when(F.col("stored"), 0).otherwise(1).alias("distance"), F.col("stored").alias("found"))

    def step(state: DataFrame) -> DataFrame:
        ahead = state.select(F.col("sha").alias("at"), F.col("at").alias("next"), F.col("distance").alias("more"), F.col("found").alias("end"))
        done = F.col("found") | F.col("at").isNull()
        return state.join(ahead, "at", "left").select(
            "sha", F.when(done, F.col("at")).otherwise(F.col("next")).alias("at"), F.when(done, F.col("distance")).otherwise(F.col("distance") + F.col("more")).alias("distance"), F.when(done, F.col("found")).otherwise(F.coalesce("end", F.lit(False))).alias("found")
        )

    state = relax(start, step, F.struct(F.count_if("found"), F.count("at"), F.sum("distance")), max_rounds=most.bit_length() + 1)
    return state.where((F.col("found")) & (F.col("distance") <= most)).select("sha", F.col("at").alias("baseline"), "distance")


def _shape(node_id: Column) -> Column:
    return (
        F.when(node_id.startswith("mb_field::"), "mb_field").when(node_id.startswith("mb_card::"), "mb_card").when(node_id.startswith("mb_dash::"), "mb_dashboard")
        .when(node_id.contains("::"), "column").when(node_id.startswith("source."), "source").otherwise("model")
    )


def dangling_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Placeholders for endpoints that no node stands for, typed by the shape of their id."""
    ends = edges.select(F.col("f").alias("node_id")).union(edges.select("t")).distinct()
    missing = ends.join(nodes, "node_id", "left_anti").select("node_id", _shape(F.col("node_id")).alias("node_type"), owner_of(F.col("node_id")).alias("owner_id"))
    owners = nodes.select(F.col("node_id").alias("owner_id"), "schema_name", "table_name")
    name = F.when(F.col("owner_id").isNull(), F.substring_index("node_id", ".", -1)).otherwise(F.substring_index("node_id", "::", -1))
    is_column = F.col("node_type") == "column"
    return missing.join(owners, "owner_id", "left").select("node_id", "node_type", name.alias("name"), F.when(is_column, F.col("schema_name")).alias("schema_name"), F.when(is_column, F.col("table_name")).alias("table_name"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n): counts of node and edge types in a fixed order, zeros included for nodes."""
    kinds = nodes.sparkSession.createDataFrame([(t,) for t in NODE_TYPES], "type string")
    n = nodes.groupBy(F.col("node_type").alias("type")).count()
    node = kinds.join(n, "type", "left").select(F.lit("node").alias("kind"), "type", F.coalesce("count", F.lit(0)).alias("n"), type_order(F.col("type")).cast("int").alias("place"))
    edge = edges.groupBy(F.col("edge_type").alias("type")).count().select(F.lit("edge"), "type", "count", F.row_number().over(Window.orderBy("type")))
    return node.union(edge)


def build_freshness(builds: DataFrame, now: Column, stale: int = 7) -> DataFrame:
    """``builds`` with their age in calendar days and whether they are stale."""
    age = F.datediff(F.to_date(now), F.to_date("generated_at"))
    return builds.withColumn("age_days", age).withColumn("stale", age >= stale)
