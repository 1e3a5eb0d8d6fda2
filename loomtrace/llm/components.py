"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import discard, join_groups, new_folder, salt_of, written
from loomtrace.plans.closure import settled_with

#: Links from which on a hub's neighbours are dealt over salts; fewer fit one task.
MANY = 1_000_000


def _with_least(rows: DataFrame, key: str, least: DataFrame, n: int) -> DataFrame:
    if n < MANY:
        return rows.join(least, key)
    return join_groups(rows, written(least, "least"), [key], "degree", 2 * n, salt_of(*rows.columns))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``links(a, b)``; root is the smallest node reachable.

    Each round hangs every node's larger neighbours on its smallest neighbour,
    then its smaller ones. Rounds grow with the logarithm of the number of
    nodes; each is written, so plans stay short and survive lost executors, and
    the one before is deleted. Null ends and loops link nothing.
    """
    spark, folder = links.sparkSession, new_folder(links.sparkSession, "links")
    # What tells a table of links from the next, taken while it is written.
    digest = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0)).alias("x"), F.coalesce(F.sum(F.xxhash64("lo", "hi") % 1_000_003), F.lit(0)).alias("s"))
    first = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges, before = settled_with(first, digest, folder)
    while before["n"]:
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = _with_least(both, "u", least, before["n"]).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("degree"))
        small = _with_least(large, "hi", least, before["n"])
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(small.select("hi", F.col("m"))).where("hi <> lo").distinct()
        held, folder = folder, new_folder(spark, "links")
        edges, after = settled_with(small, digest, folder)
        discard(spark, held)
        if after == before:
            break
        before = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct())
