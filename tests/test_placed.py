"""Edges and met keys stay in their buckets; packed walks against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import packed, walk
from loomtrace.plans.placed import Hops, Visited


def exchanged_scans(df, names):
    """Tables that are shuffled somewhere in the plan of ``df``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines, moved = plan.splitlines(), []
    for at, line in enumerate(lines):
        for name in names:
            if name in line and "Scan" in line:
                depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
                for above in reversed(lines[:at]):
                    indent = len(above) - len(above.lstrip(" :+-*()0123456789"))
                    if indent < depth:
                        depth = indent
                        if "Exchange" in above:
                            moved.append(name)
                        if "Join" in above:
                            break
    return moved


@pytest.fixture
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_round_moves_the_frontier_alone(spark, shuffled_joins):
    hops = Hops(spark.range(1_000).select(F.col("id").alias("f"), (F.col("id") * 7 % 1_000).alias("t")))
    seen = Visited(["start", "node"], hops.buckets)
    frontier = spark.range(50).select(F.col("id").alias("start"), F.col("id").alias("node"))
    seen.add(frontier)
    seen.add(frontier.withColumn("node", F.col("node") + 1))
    met = [t.inputFiles()[0].split("/placed-")[1].split("/")[0] for held in seen.levels for t in held]
    found = hops.follow(frontier, "node").groupBy("start", F.col("t").alias("node")).agg(F.lit(1).alias("depth"))
    fresh = seen.unseen(found)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    names = [hops.placed.name, *(f"placed_{m}" for m in met)]
    assert all(n in plan for n in names) and "SortMergeJoin" in plan
    assert exchanged_scans(fresh, names) == []
    # What moves: the frontier to the edges, and what it found to the keys that were met.
    assert plan.count("Exchange hashpartitioning") == 2
    assert {(r.start, r.node) for r in fresh.collect()} == {(i, i * 7 % 1_000) for i in range(50)} - {(i, i + d) for i in range(50) for d in (0, 1)}


def test_a_hub_lies_in_several_buckets(spark, shuffled_joins):
    n = 1_000_000
    edges = spark.range(n).select(F.lit(0).cast("long").alias("f"), F.col("id").alias("t")).union(spark.range(1, 100).select("id", F.col("id") + 1))
    hops = Hops(edges, hub=100_000)
    assert hops.placed.table.where("f = 0").select("slot").distinct().count() == 10
    sizes = hops.placed.table.where("f = 0").groupBy("slot").count().agg(F.max("count")).first()[0]
    assert sizes < 120_000
    ahead = hops.follow(spark.createDataFrame([(0,), (5,), (500,)], "node long"), "node")
    assert ahead.count() == n + 1 and ahead.where("f = 5").count() == 1


def test_packed_rows_are_fewer_than_pairs(spark):
    """Two hundred starts that reach two hundred nodes are four words a node."""
    edges = spark.range(200).select(F.format_string("a%03d", "id").alias("f"), F.lit("m").alias("t")).union(spark.range(200).select(F.lit("m"), F.format_string("z%03d", "id")))
    starts = spark.range(200).select(F.format_string("a%03d", "id").alias("node_id"))
    numbers, seeds = walk._labelled(starts)
    rounds, cut = packed.walk(Hops(edges), seeds, ["w"])
    rows = sum(r.count() for r in rounds)
    pairs = sum(packed.unpacked(r, numbers, ["w"]).count() for r in rounds)
    assert cut is None and pairs == 200 * 201 and rows <= pairs / 40


def test_walks_that_are_cut_say_so(spark):
    chain = [(f"c{i:02}", f"c{i + 1:02}", "feeds", "exact") for i in range(34)]
    edges = spark.createDataFrame(chain, "f string, t string, edge_type string, confidence string")
    start = spark.createDataFrame([("c00",), ("c31",)], "node_id string")
    found = walk.reach(edges, start, max_depth=None)
    assert {r.start: r.n for r in found.groupBy("start").agg(F.count(F.lit(1)).alias("n")).collect()} == {"c00": 34, "c31": 3}
    cut, lines = walk.lineage_subgraph(edges, start, max_depth=4)
    assert {(r.start, r.truncated, r.n) for r in cut.groupBy("start", "truncated").agg(F.count(F.lit(1)).alias("n")).collect()} == {("c00", True, 5), ("c31", True, 8)}
    assert lines.count() == 4 + 7
    whole, _ = walk.lineage_subgraph(edges.where("f < 'c05'"), spark.createDataFrame([("c03",)], "node_id string"))
    assert whole.columns == ["start", "node_id"] and whole.count() == 6
    ids = spark.createDataFrame([(f"c{i:02}",) for i in range(35)], "node_id string")
    assert {r.start: r.truncated for r in walk.truncated_starts(ids, edges, start, 3).collect()} == {"c00": True, "c31": False}


def test_counts_by_words_on_cyclic_graphs(spark):
    rng = random.Random(8)
    kinds = {"c": "column", "k": "mb_card", "d": "mb_dashboard", "m": "model"}
    ids = [*(f"c{i}" for i in range(30)), *(f"k{i}" for i in range(70)), *(f"d{i}" for i in range(5)), "m0", "m1"]
    rows = list({(rng.choice(ids[:100]), rng.choice(ids)) for _ in range(150)} | {(f"c{i}", f"c{i + 1}") for i in range(20, 28)} | {("k1", "k2"), ("k2", "k1"), ("k3", "k3")})
    owner = lambda i: f"m{int(i[1:]) % 2}" if i[0] == "c" else None
    nodes = spark.createDataFrame([(i, kinds[i[0]], i, owner(i)) for i in ids], "node_id string, node_type string, name string, owner_id string")
    edges = spark.createDataFrame([(f, t, "feeds", "exact") for f, t in rows], "f string, t string, edge_type string, confidence string")
    below = {}
    for s in ids:
        seen, front = set(), {s}
        while front := {t for f, t in rows if f in front} - seen:
            seen |= front
        below[s] = seen
    for m in ("m0", "m1"):
        below[m] = below[m].union(*(below[i] for i in ids if owner(i) == m))
    want = {i: tuple(sum(x[0] == k and x != i for x in below[i]) for k in "kd") for i in ids}
    assert {r.node_id: (r.cards, r.dashboards) for r in walk.consequence_counts(nodes, edges).collect()} == want


def test_counts_along_a_chain_of_five_thousand(spark):
    n = 5_000
    name = lambda c: F.format_string("c%05d", c)
    edges = spark.range(n).select(name(F.col("id")).alias("f"), name(F.col("id") + 1).alias("t"), F.lit("feeds").alias("edge_type"), F.lit("exact").alias("confidence"))
    nodes = spark.range(n + 1).select(name(F.col("id")).alias("node_id"), F.when(F.col("id") == n, "mb_card").otherwise("column").alias("node_type"), F.lit("m").alias("owner_id"))
    assert walk.consequence_counts(nodes, edges).where("cards = 1 and dashboards = 0").count() == n
