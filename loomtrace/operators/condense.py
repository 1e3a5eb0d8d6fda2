"""Cycles and chains taken out of a graph, so that rounds follow its branching and not its length.

``chains`` contracts runs of nodes with one input and one output by doubling pointers;
``strong_groups`` finds the sets of nodes that reach each other; ``longest_layers`` lays
these out by the longest path over what is left.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.plans.closure import discard, joined_rounds, new_folder, settled, settled_rows, settled_with


class Chains(NamedTuple):
    """A graph without its runs, and what they were."""

    #: (f, t, hops) between nodes that are in no run; of parallel ways the longest.
    edges: DataFrame
    #: (node, head, tail, place) of each node in a run, and how many hops it lies behind the head.
    inner: DataFrame
    #: (node, root) of runs without ends; root is the least node.
    rings: DataFrame


def simple_hops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges (f, t) between two different nodes of ``nodes(node_id)``, as a written table."""
    ids = nodes.select("node_id").distinct()
    hops = edges.where("f <> t").select("f", "t").distinct()
    return settled(hops.join(ids.toDF("f"), "f", "left_semi").join(ids.toDF("t"), "t", "left_semi"))


def chains(hops: DataFrame, kept: DataFrame | None = None) -> Chains:
    """The runs of distinct ``hops(f, t)``: nodes with one input and one output, but for those ``kept(node)``.

    Each node of a run points to the one before it. Pointers double, so a run of n
    nodes takes log2(n) rounds; those that are still open then are rings.
    """
    into = hops.groupBy(F.col("t").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("before"))
    out = hops.groupBy(F.col("f").alias("node")).agg(F.count(F.lit(1)).alias("m"), F.min("t").alias("behind"))
    single = into.where("n = 1").join(out.where("m = 1"), "node").select("node", "before", "behind")
    single, n = settled_rows(single if kept is None else single.join(kept.select("node"), "node", "left_anti"))
    inside = single.select(F.col("node").alias("before"), F.lit(True).alias("inside"))
    start = single.join(inside, "before", "left")
    first = F.col("inside").isNull()
    # The first node of a run points to itself.
    start = start.select("node", F.when(first, F.col("node")).otherwise(F.col("before")).alias("at"), F.when(first, 0).otherwise(1).cast("long").alias("place"), first.alias("done"), F.col("node").alias("least"))
    folder, still = new_folder(hops.sparkSession, "runs"), F.count_if(~F.col("done"))
    state, left = settled_with(start, still, folder)
    for _ in range(n.bit_length() + 1):
        if not left:
            break
        ahead = state.toDF("at", "at2", "place2", "done2", "least2")
        step = state.where("not done").join(ahead, "at").select("node", F.col("at2").alias("at"), (F.col("place") + F.col("place2")).alias("place"), F.col("done2").alias("done"), F.least("least", "least2").alias("least"))
        held, folder = folder, new_folder(hops.sparkSession, "runs")
        state, left = settled_with(state.where("done").union(step), still, folder)
        discard(hops.sparkSession, held)
    runs = state.where("done").select("node", F.col("at").alias("run"), "place").join(single, "node")
    ends = runs.groupBy("run").agg(F.min_by("before", "place").alias("head"), F.max_by("behind", "place").alias("tail"), (F.max("place") + 2).alias("hops"))
    ends = settled(ends)
    plain = hops.join(single.select(F.col("node").alias("f")), "f", "left_anti").join(single.select(F.col("node").alias("t")), "t", "left_anti")
    edges = plain.select("f", "t", F.lit(1).cast("long").alias("hops")).union(ends.select("head", "tail", "hops")).groupBy("f", "t").agg(F.max("hops").alias("hops"))
    inner = runs.join(ends, "run").select("node", "head", "tail", (F.col("place") + 1).alias("place"))
    return Chains(settled(edges), settled(inner), state.where("not done").select("node", F.col("least").alias("root")))


def _trimmed(hops: DataFrame) -> tuple[DataFrame, int]:
    """``hops(f, t)`` without nodes that nothing enters, or that nothing leaves, until all have both."""
    hops, n = settled_rows(hops)
    while n:
        starts, ends = hops.select(F.col("f").alias("node")).distinct(), hops.select(F.col("t").alias("node")).distinct()
        live = starts.join(ends, "node", "left_semi")
        hops, rows = settled_rows(hops.join(live.toDF("f"), "f", "left_semi").join(live.toDF("t"), "t", "left_semi"))
        if rows == n:
            break
        n = rows
    return hops, n


def strong_groups(hops: DataFrame) -> DataFrame:
    """(node, root) of all nodes on a cycle of ``hops(f, t)``: the sets that reach each other, named by their least node.

    What no cycle can hold is trimmed. Of the rest each node takes the least node that
    reaches it as its colour; a node of its own colour is a root, and what reaches
    it within its colour is its group. Groups are taken out, and what is left goes on.
    """
    found, hops_left = [], hops.select("f", "t").where("f <> t").distinct()
    while True:
        live, n = _trimmed(hops_left)
        if not n:
            break
        colours = settled(live.select(F.col("f").alias("node")).union(live.select("t")).distinct().withColumn("colour", F.col("node")))
        frontier = colours
        while True:
            # Only nodes whose colour has changed pass it on.
            passed = frontier.join(live, F.col("node") == F.col("f")).groupBy("t").agg(F.min("colour").alias("new")).withColumnRenamed("t", "node")
            frontier, moved = settled_rows(passed.join(colours, "node").where("new < colour").select("node", F.col("new").alias("colour")))
            if not moved:
                break
            better = frontier.withColumnRenamed("colour", "new")
            colours = settled(colours.join(better, "node", "left").select("node", F.coalesce("new", "colour").alias("colour")))
        within = live.join(colours.toDF("f", "cf"), "f").join(colours.toDF("t", "ct"), "t").where("cf = ct").select("f", "t")
        within = settled(within)
        reached = frontier = settled(colours.where("node = colour"))
        while True:
            back = frontier.join(within, F.col("node") == F.col("t")).select(F.col("f").alias("node"), "colour").distinct()
            frontier, rows = settled_rows(back.join(reached.select("node"), "node", "left_anti"))
            if not rows:
                break
            reached = settled(reached.union(frontier))
        found.append(reached.select("node", F.col("colour").alias("root")))
        gone = reached.select("node")
        hops_left = live.join(gone.toDF("f"), "f", "left_anti").join(gone.toDF("t"), "t", "left_anti")
    if not found:
        return hops.select(F.col("f").alias("node"), F.col("f").alias("root")).limit(0)
    groups = joined_rounds(found)
    several = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    return settled(groups.join(several, "root", "left_semi").select("node", "root"))


def _rooted(rows: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``rows`` with ``node`` replaced by the root of its group."""
    return rows.join(roots.select(F.col("node").alias(node), F.col("root").alias("_root")), node, "left").withColumn(node, F.coalesce("_root", node)).drop("_root")


def peeled(nodes: DataFrame, edges: DataFrame) -> tuple[list[DataFrame], DataFrame, int]:
    """(done, left, n): (node, layer) by the longest way from a node without inputs, over ``edges(f, t, hops)``.

    ``nodes(node, layer)`` bring the least layer that they may have. Each round takes the
    nodes all of whose inputs are gone. ``left`` are the ``n`` on a cycle or behind one,
    with the layer that what was taken gives them.
    """
    spark, folder = nodes.sparkSession, new_folder(nodes.sparkSession, "open")
    inputs = edges.groupBy(F.col("t").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    tally = F.struct(F.count_if(F.col("n") == 0).alias("open"), F.count(F.lit(1)).alias("all"))
    state, count = settled_with(nodes.join(inputs, "node", "left").select("node", F.coalesce("n", zero).alias("n"), "layer"), tally, folder)
    done = []
    while count["open"]:
        taken = settled(state.where("n = 0").select("node", "layer"))
        done.append(taken)
        ahead = taken.join(edges, F.col("node") == F.col("f")).groupBy("t").agg(F.count(F.lit(1)).alias("m"), F.max(F.col("layer") + F.col("hops")).alias("least")).withColumnRenamed("t", "node")
        held, folder = folder, new_folder(spark, "open")
        rest = state.where("n > 0").join(ahead, "node", "left").select("node", (F.col("n") - F.coalesce("m", zero)).alias("n"), F.greatest("layer", F.coalesce("least", zero)).alias("layer"))
        state, count = settled_with(rest, tally, folder)
        discard(spark, held)
    return done, state.select("node", "layer"), count["all"]


def longest_layers(nodes: DataFrame, edges: DataFrame, cycles: bool = True) -> DataFrame:
    """(node_id, layer) of all ``nodes(node_id)``: the longest way from a node without inputs, in groups.

    Nodes that reach each other share a layer, and over every edge between two groups the
    layer rises; without ``cycles`` these, and what lies behind them, have none. A
    chain of n nodes takes log2(n) rounds; what branches takes one for each step of its longest way.
    """
    hops = simple_hops(nodes, edges)
    cut = chains(hops)
    outer = nodes.select(F.col("node_id").alias("node")).distinct().join(cut.inner.select("node").union(cut.rings.select("node")), "node", "left_anti")
    start = outer.withColumn("layer", F.lit(0).cast("long"))
    # A loop is an input that is never gone: whoever has one is left for the groups.
    done, left, n = peeled(start, cut.edges)
    roots = cut.edges.select(F.col("f").alias("node"), F.col("t").alias("root")).limit(0)
    if cycles and n:
        among = settled(cut.edges.join(left.select(F.col("node").alias("f")), "f", "left_semi").join(left.select(F.col("node").alias("t")), "t", "left_semi"))
        roots = strong_groups(among)
        between = _rooted(_rooted(among, roots, "f"), roots, "t").where("f <> t").groupBy("f", "t").agg(F.max("hops").alias("hops"))
        done += peeled(_rooted(left, roots, "node").groupBy("node").agg(F.max("layer").alias("layer")), settled(between))[0]
    layers = settled(joined_rounds(done) if done else start.limit(0))
    level: Column = F.col("layer")
    how = "inner" if cycles else "left"
    plain = _rooted(outer.withColumn("at", F.col("node")), roots, "at").join(layers.toDF("at", "layer"), "at", how).select("node", level)
    # A run between two nodes of one group is part of it; any other lies behind its head.
    inner = _rooted(_rooted(cut.inner, roots, "head"), roots, "tail").join(layers.toDF("head", "layer"), "head", how)
    inner = inner.select("node", F.when(F.col("head") == F.col("tail"), level).otherwise(level + F.col("place")).alias("layer"))
    rings = cut.rings.select("node", F.lit(0 if cycles else None).cast("long").alias("layer"))
    return plain.union(inner).union(rings).select(F.col("node").alias("node_id"), F.col("layer").cast("int").alias("layer"))


def reached_back(hops: DataFrame, seeds: DataFrame, closure) -> DataFrame:
    """(node) of all that has a way to one of ``seeds(node)`` over distinct ``hops(f, t)``, themselves included.

    ``closure(edges, seeds)`` walks back over what contracting the runs leaves; a run is
    reached as a whole, by its tail.
    """
    cut = chains(hops, kept=seeds)
    found = settled(closure(cut.edges.select("f", "t").where("f <> t"), seeds).select("node"))
    inner = cut.inner.join(found.toDF("tail"), "tail", "left_semi").select("node")
    return found.union(inner).distinct()
