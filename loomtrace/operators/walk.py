"""Traversals of the graph, all as rounds of joins over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.text import STEPS, rank, word
from loomtrace.operators import packed
from loomtrace.operators.condense import chains, longest_layers, reached_back
from loomtrace.operators.graph import flow_edges
from loomtrace.plans.closure import settled, settled_rows
from loomtrace.plans.placed import Hops, spread_in_buckets

#: Hops of an impact walk, and of reach.
MAX_DEPTH, REACH_DEPTH = 20, 30


def downstream(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(start, node_id, node_type, depth, path, edge_types) of all that a start flows into.

    The path is the shortest one, of several the smallest by (node, edge type) hop
    by hop; it begins with the start. A start itself is not reported, nor a node that
    ``nodes`` lacks, though the walk goes through it; a start that ``nodes`` lacks has no rows.
    """
    return reported(walked(nodes, edges, starts, max_depth), nodes)


def reported(walk: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of :func:`downstream` from those of :func:`walked`."""
    walk = walk.withColumnRenamed("path", "taken")
    types = nodes.select(F.col("node_id").alias("node"), "node_type")
    pick = lambda odd: F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.element_at("taken", i * 2 - odd))
    return walk.where("depth > 0").join(types, "node").select("start", F.col("node").alias("node_id"), "node_type", "depth", F.concat(F.array("start"), pick(1)).alias("path"), pick(0).alias("edge_types"))


def walked(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(start, node, depth, path) of the walk itself; a path lists target and edge type of each hop."""
    hops = Hops(flow_edges(edges).select("f", "t", "edge_type").distinct())
    known = starts.select(F.col("node_id").alias("start")).distinct().join(nodes.select(F.col("node_id").alias("start")), "start", "left_semi")
    seed = known.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path"))

    def step(frontier: DataFrame, depth: int) -> DataFrame:
        ahead = hops.follow(frontier, "node").select("start", F.col("t").alias("node"), F.concat("path", F.array("t", "edge_type")).alias("path"))
        return ahead.groupBy("start", "node").agg(F.lit(depth).alias("depth"), F.min("path").alias("path"))

    found = spread_in_buckets(seed, step, ["start", "node"], hops.buckets, max_depth)
    hops.drop()
    return found


def met_from_any(edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(node_id) of all within ``max_depth`` hops of one of ``starts(node_id)``, these included: a row for a node, whatever the number of starts."""
    hops = Hops(flow_edges(edges).select("f", "t").distinct())
    step = lambda frontier, _: hops.follow(frontier, "node").select(F.col("t").alias("node")).distinct()
    found = spread_in_buckets(starts.select(F.col("node_id").alias("node")).distinct(), step, ["node"], hops.buckets, max_depth)
    hops.drop()
    return found.select(F.col("node").alias("node_id"))


def below(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH, kinds: list[str] | None = None) -> DataFrame:
    """(start, node_id, node_type): the pairs of :func:`downstream` without their paths, which are most of its bytes; of ``kinds`` alone, if given.

    With ``kinds`` the walk keeps to edges from which a node of these kinds can be reached.
    """
    flow = settled(flow_edges(edges).select("f", "t").distinct())
    types = nodes.select(F.col("node_id").alias("node"), "node_type")
    if kinds is not None:
        types = types.where(F.col("node_type").isin(kinds))

        def closure(left: DataFrame, seeds: DataFrame) -> DataFrame:
            back = Hops(left.select(F.col("t").alias("f"), F.col("f").alias("t")))
            step = lambda frontier, _: back.follow(frontier, "node").select(F.col("t").alias("node")).distinct()
            return spread_in_buckets(seeds, step, ["node"], back.buckets)

        # Mostly the nodes of these kinds themselves and little before them.
        flow = settled(flow.join(reached_back(flow.where("f <> t"), types.select("node").distinct(), closure).toDF("t"), "t", "left_semi").select("f", "t"))
    known = starts.select("node_id").distinct().join(nodes.select("node_id"), "node_id", "left_semi")
    numbers, seeds = _labelled(known)
    hops = Hops(flow)
    rounds, _ = packed.walk(hops, seeds, ["w"], max_depth)
    met = reduce(DataFrame.union, rounds) if rounds else seeds.limit(0)
    met = met.groupBy(packed.KEY).agg(F.bit_or("w").alias("w")).join(seeds.select(*packed.KEY, F.col("w").alias("own")), packed.KEY, "left")
    met = met.select(*packed.KEY, packed.without("w", "own").alias("w")).where("w <> 0").join(types, "node")
    return packed.unpacked(met, numbers, ["w"], "node_type").select(F.col("label").alias("start"), F.col("node").alias("node_id"), "node_type")


def truncated(walk: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(start, truncated): whether a node at the last level has a successor that the walk did not see."""
    last = walk.where(F.col("depth") == max_depth).join(flow_edges(edges), F.col("node") == F.col("f")).select("start", F.col("t").alias("node"))
    missed = last.join(walk, ["start", "node"], "left_anti").select("start").distinct().withColumn("truncated", F.lit(True))
    return walk.select("start").distinct().join(missed, "start", "left").select("start", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def _far(hops: DataFrame, n: int) -> DataFrame:
    """(node) of all from which ``n`` hops of ``hops(f, t)`` can be made, nodes on the way repeated or not; edges that lead to none of these are dropped round by round."""
    ahead = settled(hops.select(F.col("f").alias("node")).distinct())
    for _ in range(n - 1):
        hops, rows = settled_rows(hops.join(ahead.toDF("t"), "t", "left_semi"))
        ahead = settled(hops.select(F.col("f").alias("node")).distinct())
        if not rows:
            break
    return ahead


def truncated_starts(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """As :func:`truncated` for a walk from ``starts``, without a row for each start and node.

    Only starts from which more than ``max_depth`` hops can be made walk at all.
    """
    known = settled(starts.select("node_id").distinct().join(nodes.select("node_id"), "node_id", "left_semi"))
    flow = settled(flow_edges(edges).select("f", "t").distinct())
    long = settled(known.join(_far(flow, max_depth + 1).toDF("node_id"), "node_id", "left_semi"))
    numbers, seeds = _labelled(long)
    hops = Hops(flow)
    _, cut = packed.walk(hops, seeds, ["w"], max_depth)
    rows = known.select(F.col("node_id").alias("start"))
    if cut is None:
        return rows.withColumn("truncated", F.lit(False))
    # What comes back to its own start was seen.
    own = seeds.select(*packed.KEY, F.col("w").alias("own"))
    cut = cut.join(own, packed.KEY, "left").select(*packed.KEY, packed.without("w", "own").alias("w"))
    cut = cut.groupBy("kind", "block").agg(F.bit_or("w").alias("w")).withColumn("node", F.lit(""))
    missed = packed.unpacked(cut, numbers, ["w"]).select(F.col("label").alias("start"), F.lit(True).alias("truncated"))
    return rows.join(missed, "start", "left").select("start", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def _turned(edges: DataFrame, direction: str) -> DataFrame:
    flow = flow_edges(edges)
    return flow if direction == "down" else flow.select(F.col("t").alias("f"), F.col("f").alias("t"), "edge_type", "confidence")


def _labelled(starts: DataFrame, words: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(numbers, seeds): each of ``starts(node_id)`` as a label at its own node."""
    rows = starts.select(F.col("node_id").alias("node"), F.lit("").alias("kind"), F.col("node_id").alias("label")).distinct()
    numbers = packed.numbered_labels(rows)
    return numbers, settled(packed.seeded(rows, numbers, words or ["w"]))


def reach(edges: DataFrame, starts: DataFrame, direction: str = "down", edge_types: list[str] | None = None, max_depth: int | None = REACH_DEPTH) -> DataFrame:
    """(start, node_id, depth, confidence): least hops, and the best over paths of the weakest hop.

    Starts walk together as the bits of words, one word for each rank, so a round has a
    row for a node and 64 starts. A cycle back to the start reports the start. Without
    ``max_depth`` a walk ends where nothing is left.
    """
    turned = _turned(edges, direction)
    if edge_types is not None:
        turned = turned.where(F.col("edge_type").isin(edge_types))
    words = [f"w{r}" for r in STEPS]
    numbers, seeds = _labelled(starts, words)
    hops = Hops(turned.groupBy("f", "t").agg(F.max(rank(F.col("confidence"))).alias("rank")))
    rounds, _ = packed.walk(hops, seeds, words, max_depth)
    if not rounds:
        return starts.select(F.col("node_id").alias("start"), "node_id", F.lit(0).alias("depth"), F.lit("").alias("confidence")).limit(0)
    met = reduce(DataFrame.union, (r.withColumn("depth", F.lit(k)) for k, r in enumerate(rounds, 1)))
    # A bit of the first word shows in one round, which is its depth.
    sums = met.groupBy(packed.KEY).agg(*(F.bit_or(w).alias(w) for w in words), F.collect_list(F.struct("depth", F.col("w1").alias("new"))).alias("when"))
    lit = sums.withColumn("place", F.explode(F.filter(F.sequence(F.lit(0), F.lit(packed.BITS - 1)), lambda p: packed.has(F.col("w1"), p))))
    depth = F.filter("when", lambda x: packed.has(x["new"], F.col("place")))[0]["depth"]
    best = sum((packed.has(F.col(w), F.col("place")).cast("int") for w in words), F.lit(0))
    rows = lit.select("kind", (F.col("block") * packed.BITS + F.col("place")).alias("number"), F.col("node").alias("node_id"), depth.alias("depth"), word(best).alias("confidence"))
    return rows.join(numbers, ["kind", "number"]).select(F.col("label").alias("start"), "node_id", "depth", "confidence")


def reached_of_type(found: DataFrame, nodes: DataFrame, node_type: str) -> DataFrame:
    """The reached nodes of one type with their names, nearest first."""
    named = nodes.where(F.col("node_type") == node_type).select("node_id", "name")
    return found.join(named, "node_id").orderBy("start", "depth", "name", "node_id")


def feeds_a_consumer(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of all nodes with a flow path to a card or dashboard; an owner lives if one of its columns does, not the reverse."""
    flow = flow_edges(edges).select("f", "t")
    owned = nodes.where("owner_id is not null").select(F.col("owner_id").alias("f"), F.col("node_id").alias("t"))
    hops = settled(flow.union(owned).where("f <> t").distinct())
    seeds = nodes.where(F.col("node_type").isin("mb_card", "mb_dashboard")).select(F.col("node_id").alias("node")).distinct()

    def closure(left: DataFrame, seeds: DataFrame) -> DataFrame:
        back = Hops(left.select(F.col("t").alias("f"), F.col("f").alias("t")))
        step = lambda frontier, _: back.follow(frontier, "node").select(F.col("t").alias("node")).distinct()
        return spread_in_buckets(seeds, step, ["node"], back.buckets)

    return reached_back(hops, seeds, closure).select(F.col("node").alias("node_id"))


def lineage_subgraph(edges: DataFrame, node: DataFrame, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(start, node_id) and (start, f, t, edge_type): all up or down of a node, and the flow among one side's nodes.

    Nodes and edges are found for 64 starts at once and told apart at the end. With a
    ``max_depth`` the nodes have a column ``truncated``: whether that start's walk was cut off.
    """
    numbers, seeds = _labelled(node)
    flow = flow_edges(edges).select("f", "t", "edge_type").distinct()
    sides, cuts = [], []
    for direction in ("up", "down"):
        hops = Hops(_turned(edges, direction).select("f", "t").distinct())
        rounds, cut = packed.walk(hops, seeds, ["w"], max_depth)
        sides.append(settled(reduce(DataFrame.union, [seeds, *rounds]).groupBy(packed.KEY).agg(F.bit_or("w").alias("w"))))
        cuts += [cut] if cut is not None else []
    within = []
    for side in sides:
        at = lambda x: side.select(F.col("node").alias(x), "kind", "block", F.col("w").alias(f"w{x}"))  # noqa: E731, B023
        both = flow.join(at("f"), "f").join(at("t"), ["t", "kind", "block"])
        within.append(both.select("f", "t", "edge_type", "kind", "block", F.col("wf").bitwiseAND(F.col("wt")).alias("w")).where("w <> 0"))
    lines = within[0].union(within[1]).groupBy("f", "t", "edge_type", "kind", "block").agg(F.bit_or("w").alias("w")).withColumn("node", F.lit(""))
    lines = packed.unpacked(lines, numbers, ["w"], "f", "t", "edge_type").select(F.col("label").alias("start"), "f", "t", "edge_type")
    found = sides[0].union(sides[1]).groupBy(packed.KEY).agg(F.bit_or("w").alias("w"))
    found = packed.unpacked(found, numbers, ["w"]).select(F.col("label").alias("start"), F.col("node").alias("node_id"))
    if max_depth is not None:
        missed = node.select(F.col("node_id").alias("start")).limit(0).withColumn("truncated", F.lit(True))
        for cut in cuts:
            row = cut.groupBy("kind", "block").agg(F.bit_or("w").alias("w")).withColumn("node", F.lit(""))
            missed = missed.union(packed.unpacked(row, numbers, ["w"]).select("label", F.lit(True)))
        found = found.join(missed.distinct(), "start", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    return found, lines


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, layer): the longest path from a node without inputs; nodes that reach each other stand in one layer, and it rises over every other edge."""
    return longest_layers(nodes, edges)


def _entity(nodes: DataFrame) -> DataFrame:
    """Each node's entity: columns go to their owner, fields to none."""
    return nodes.where("node_type <> 'mb_field'").select("node_id", F.coalesce("owner_id", "node_id").alias("entity"), (F.col("node_type") == "column").alias("is_column"))


def roll_up(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(f, t, weight, confidence, declared) between models, sources, cards and dashboards.

    Columns fall into their owners and fields are passed through. weight counts the
    columns that contribute, confidence is the best over paths of the weakest hop,
    declared says whether a references edge is among them. Only edges with both ends in ``nodes`` count.
    """
    ids = nodes.select("node_id")
    flow = flow_edges(edges).select("f", "t", "edge_type", rank(F.col("confidence")).alias("r"))
    flow = flow.join(ids.withColumnRenamed("node_id", "f"), "f", "left_semi").join(ids.withColumnRenamed("node_id", "t"), "t", "left_semi")
    binds = flow.where("edge_type = 'binds_to'").select(F.col("f").alias("col"), F.col("t").alias("field"), F.col("r").alias("r1"))
    uses = flow.where("edge_type = 'consumed_by'").select(F.col("f").alias("field"), "t", "r")
    through = binds.join(uses, "field").select(F.col("col").alias("f"), "t", F.lit("through").alias("edge_type"), F.least("r1", "r").alias("r"))
    direct = flow.where(~F.col("edge_type").isin("binds_to", "consumed_by")).select("f", "t", "edge_type", "r")
    entity = _entity(nodes)
    a = entity.select(F.col("node_id").alias("f"), F.col("entity").alias("from"), "is_column")
    b = entity.select(F.col("node_id").alias("t"), F.col("entity").alias("to"))
    merged = direct.union(through).join(a, "f").join(b, "t").where("from <> to").withColumnRenamed("f", "source")
    return merged.groupBy(F.col("from").alias("f"), F.col("to").alias("t")).agg(F.count_distinct(F.when(F.col("is_column"), F.col("source"))).alias("weight"), word(F.max("r")).alias("confidence"), F.bool_or(F.col("edge_type") == "references").alias("declared"))


def entity_members(nodes: DataFrame) -> DataFrame:
    """(entity, members): columns of each owner."""
    return nodes.where("node_type = 'column'").groupBy(F.col("owner_id").alias("entity")).agg(F.count(F.lit(1)).alias("members"))


def consumer_words(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, numbers): the cards and dashboards strictly below each node as bits, (node, kind, block, w), and their numbers.

    Runs of nodes with one input and one output are contracted first; all of a run have
    what its tail has, and the tail itself.
    """
    seeds = nodes.where(F.col("node_type").isin("mb_card", "mb_dashboard")).select(F.col("node_id").alias("node"), F.col("node_type").alias("kind"), F.col("node_id").alias("label")).distinct()
    numbers = packed.numbered_labels(seeds)
    own = settled(packed.seeded(seeds, numbers, ["w"]))
    loops = flow_edges(edges).select("f", "t").distinct()
    cut = chains(settled(loops.where("f <> t")), kept=seeds.select("node").union(loops.where("f = t").select("f")).distinct())
    back = cut.edges.select("f", "t").union(loops.where("f = t")).select(F.col("t").alias("f"), F.col("f").alias("t"))
    rounds, _ = packed.walk(Hops(back), own, ["w"])
    met = reduce(DataFrame.union, [r.select(*packed.KEY, "w") for r in rounds]) if rounds else own.limit(0)
    met = settled(met.groupBy(packed.KEY).agg(F.bit_or("w").alias("w")))
    behind = met.union(own.select(*packed.KEY, "w")).withColumnRenamed("node", "tail")
    inner = cut.inner.select("node", "tail").join(behind, "tail").groupBy(packed.KEY).agg(F.bit_or("w").alias("w"))
    return met.union(inner.select(met.columns)), numbers


def consequence_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, cards, dashboards) for every node, zeros included: cards and dashboards strictly below it.

    A model also answers for its own columns, which its upstream models do not inherit.
    Consumers are bits of words, so there is never a row for a node and a consumer.
    """
    words, numbers = consumer_words(nodes, edges)
    columns = nodes.where("node_type = 'column'").select("node_id", "owner_id")
    lifted = words.join(columns.withColumnRenamed("node_id", "node"), "node").select(F.col("owner_id").alias("node"), "kind", "block", "w")
    held = words.union(lifted).where("node is not null").groupBy(packed.KEY).agg(F.bit_or("w").alias("w"))
    # On a cycle a consumer is below itself, which does not count.
    itself = numbers.select(F.col("label").alias("node"), "kind", F.floor(F.col("number") / packed.BITS).alias("block"), packed.bits_of(F.col("number")).alias("own"))
    n = F.bit_count(packed.without("w", "own"))
    return _by_kind(nodes, held.join(itself, packed.KEY, "left").select("node", "kind", n.cast("long").alias("n")))


def _by_kind(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    of = lambda kind, name: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(name)
    held = counts.groupBy(F.col("node").alias("node_id")).agg(of("mb_card", "cards"), of("mb_dashboard", "dashboards"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select("node_id").distinct().join(held, "node_id", "left").select("node_id", zero("cards"), zero("dashboards"))


def card_dependencies(uses: DataFrame) -> DataFrame:
    """(card_id, upstream): the cards that a card reads, by the ``via`` of what it inherits; sources, joins and metrics alike."""
    return uses.where("via is not null and via <> card_id").select("card_id", F.col("via").alias("upstream")).distinct()


def card_depth(cards: DataFrame, deps: DataFrame) -> DataFrame:
    """(card_id, depth): the longest chain of upstream cards; cards that read each other share a depth, and what reads them lies behind."""
    found = layers(cards.select(F.col("card_id").alias("node_id")), deps.select(F.col("upstream").alias("f"), F.col("card_id").alias("t")))
    return found.select(F.col("node_id").alias("card_id"), F.col("layer").alias("depth"))
