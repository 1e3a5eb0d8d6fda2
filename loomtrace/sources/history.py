"""A stored history of graphs: nodes, edges and builds in partitions of estate and snapshot.

Storing a snapshot again replaces its partitions and no other. A build is one row, the
header and coverage of its graph, with ``seq``, the order of storing. Readers filter by
the partition columns, so the scan of one snapshot touches its files alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtrace.operators.graph import RETENTION
from loomtrace.plans.closure import discard

KEYS = ["estate_id", "snapshot_id"]
#: Header of a build, fixed so that a history can be read whatever was stored first.
BUILDS = "estate_id string, snapshot_id string, seq bigint, sha string, generated_at string, nodes bigint, edges bigint, traced bigint, total bigint"


def _put(df: DataFrame, path: str) -> None:
    df.repartition(*KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def build_rows(nodes: DataFrame, edges: DataFrame, headers: DataFrame) -> DataFrame:
    """Builds of ``headers(estate_id, snapshot_id, seq, sha, generated_at)`` with counts: nodes, edges, columns, and those that something feeds."""
    n = nodes.groupBy(KEYS).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("node_type") == "column").alias("total"))
    m = edges.groupBy(KEYS).agg(F.count(F.lit(1)).alias("edges"), F.count_distinct(F.when(F.col("edge_type") == "feeds", F.col("t"))).alias("traced"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = headers.join(n, KEYS, "left").join(m, KEYS, "left")
    return rows.select(*KEYS, F.col("seq").cast("long").alias("seq"), F.col("sha").cast("string").alias("sha"), F.col("generated_at").cast("string").alias("generated_at"), *map(zero, ("nodes", "edges", "traced", "total")))


def store(nodes: DataFrame, edges: DataFrame, headers: DataFrame, path: str) -> None:
    """Stores the snapshots of ``headers``, each in place of one of the same estate and name; nodes and edges of others are left out.

    The build is written last: a snapshot without one is not there yet.
    """
    own = headers.select(KEYS).distinct()
    nodes, edges = nodes.join(own, KEYS, "left_semi"), edges.join(own, KEYS, "left_semi")
    for name, df in (("nodes", nodes), ("edges", edges), ("builds", build_rows(nodes, edges, headers))):
        _put(df, f"{path}/{name}")


def read_builds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUILDS).parquet(f"{path}/builds")


def ranked(builds: DataFrame) -> DataFrame:
    """Builds with their ``slot``, the newest of an estate first, and the snapshot stored ``previous`` to each."""
    newest = Window.partitionBy("estate_id").orderBy(F.desc("seq"), F.desc("snapshot_id"))
    return builds.withColumns({"slot": F.row_number().over(newest), "previous": F.lead("snapshot_id").over(newest)})


def drop_old(spark: SparkSession, path: str, retention: int = RETENTION) -> int:
    """Deletes what lies beyond an estate's newest ``retention`` snapshots; how many went. The build goes first."""
    old = ranked(read_builds(spark, path)).where(F.col("slot") > max(retention, 0)).select(*KEYS).collect()
    for estate, snapshot in old:
        for name in ("builds", "nodes", "edges"):
            discard(spark, f"{path}/{name}/estate_id={estate}/snapshot_id={snapshot}")
    return len(old)


def read_snapshot(spark: SparkSession, path: str, estate: str, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one snapshot, by the partition columns."""
    here = (F.col("estate_id") == estate) & (F.col("snapshot_id") == snapshot)
    return tuple(spark.read.parquet(f"{path}/{name}").where(here) for name in ("nodes", "edges"))


def read_previous(spark: SparkSession, path: str, estate: str, snapshot: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges) of the snapshot stored before another; none before the first."""
    row = ranked(read_builds(spark, path).where(F.col("estate_id") == estate)).where(F.col("snapshot_id") == snapshot).first()
    return read_snapshot(spark, path, estate, row.previous) if row and row.previous else None
