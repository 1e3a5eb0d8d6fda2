"""Layers, depths, runs, groups and messages against brute force, cycles and long chains included."""

import random

from pyspark.sql import functions as F

from loomtrace.operators import condense, detail, impact, repair, walk


def graph(spark, edges):
    return spark.createDataFrame([(f, t, "feeds", "exact") for f, t in edges], "f string, t string, edge_type string, confidence string")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def by_hand(nodes, edges):
    """The group of each node, and the longest way over groups from one without inputs."""
    edges = {(f, t) for f, t in edges if f != t and f in nodes and t in nodes}
    reach = {n: {t for f, t in edges if f == n} for n in nodes}
    while True:
        more = {n: r | set().union(*(reach[x] for x in r)) if r else r for n, r in reach.items()}
        if more == reach:
            break
        reach = more
    root = {n: min([n, *(m for m in reach[n] if n in reach[m])]) for n in nodes}
    between = {(root[f], root[t]) for f, t in edges if root[f] != root[t]}
    layer = dict.fromkeys(root.values(), 0)
    for _ in nodes:
        for f, t in between:
            layer[t] = max(layer[t], layer[f] + 1)
    return root, {n: layer[root[n]] for n in nodes}


def random_graph(seed, n=40, m=55):
    rng = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(n)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(m)]
    edges += [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("n01", "n01"), ("gone", "n02"), ("n02", "n03"), ("n02", "n03")]
    edges += [(f"p{i}", f"p{i + 1}") for i in range(6)] + [("n05", "p0"), ("p6", rng.choice(nodes))]
    return [*nodes, *(f"r{i}" for i in range(5)), *(f"p{i}" for i in range(7))], edges


def test_layers_of_random_cyclic_graphs(spark):
    for seed in (2, 3):
        nodes, edges = random_graph(seed)
        root, layer = by_hand(nodes, edges)
        out = {r.node_id: r.layer for r in walk.layers(ids(spark, nodes), graph(spark, edges)).collect()}
        assert out == layer and len(set(root.values())) < len(nodes)
        assert all(out[f] < out[t] for f, t in edges if f in root and t in root and root[f] != root[t])
        hops = condense.simple_hops(ids(spark, nodes), graph(spark, edges))
        groups = {r.node: r.root for r in condense.strong_groups(hops).collect()}
        assert groups == {n: r for n, r in root.items() if list(root.values()).count(r) > 1}


def test_cards_behind_a_cycle_come_in_reading_order(spark):
    deps = spark.createDataFrame([(1, 2), (2, 1), (30, 1), (20, 30), (10, 20)], "card_id long, upstream long")
    cards = spark.createDataFrame([(i, False) for i in (1, 2, 10, 20, 30)], "card_id long, archived boolean")
    depth = {r.card_id: r.depth for r in walk.card_depth(cards, deps).collect()}
    assert depth == {1: 0, 2: 0, 30: 1, 20: 2, 10: 3}
    plan = repair.order_plan(cards.select("card_id", F.lit("strip").alias("action")), cards, deps)
    assert [r.card_id for r in plan.orderBy("place").collect()] == [1, 2, 30, 20, 10]


def test_a_long_chain_takes_rounds_by_its_logarithm(spark, monkeypatch):
    rounds = []
    for name in ("settled", "settled_rows", "settled_with"):
        real = getattr(condense, name)
        monkeypatch.setattr(condense, name, lambda *a, real=real, **b: rounds.append(1) or real(*a, **b))
    n = 5_000
    chain = spark.range(n).select(F.format_string("n%05d", "id").alias("f"), F.format_string("n%05d", F.col("id") + 1).alias("t"))
    out = walk.layers(spark.range(n + 1).select(F.format_string("n%05d", "id").alias("node_id")), chain)
    assert out.where(F.col("layer") != F.substring("node_id", 2, 5).cast("int")).count() == 0 and out.count() == n + 1
    assert len(rounds) < 40
    seeds = spark.createDataFrame([(f"n{n:05}", "mb_card", "card", None)], "node_id string, node_type string, name string, owner_id string")
    assert walk.feeds_a_consumer(seeds, chain.selectExpr("f", "t", "'feeds' as edge_type", "'exact' as confidence")).count() == n + 1


def test_levels_stop_at_cycles(spark):
    from loomtrace.operators import dbt

    deps = [("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x"), ("w", "z"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("d", "c"), ("d", "a"), ("q", "q")]
    models = spark.createDataFrame([(m,) for m in "abcdxyzwq"] + [("r1",), ("r2",), ("r3",)], "uid string")
    out = {r.uid: (r.level, r.place) for r in dbt.model_levels(models, spark.createDataFrame(deps, "model string, upstream string")).collect()}
    assert {u: level for u, (level, _) in out.items()} == {"a": 0, "b": 1, "c": 2, "d": 3, "q": 0} | dict.fromkeys(["x", "y", "z", "w", "r1", "r2", "r3"])
    assert [u for u, _ in sorted(out.items(), key=lambda x: x[1][1])][:2] == ["a", "q"]


def packed_lines(lines, limit):
    chunks, current, length = [], [], 0
    for line in lines:
        if current and length + len(line) + 1 > limit:
            chunks.append("\n".join(current))
            current, length = [], 0
        current.append(line)
        length += len(line) + 1
    return [*chunks, "\n".join(current)]


def test_messages_are_packed_in_order(spark):
    rng = random.Random(4)
    groups = [None, 0, 1, 2]
    lines = [(g, k, "x" * rng.choice([0, 1, 30, 49, 50, 70, 98, 99, 100, 130])) for g in groups for k in range(60)]
    want = {(g, k): c for g in groups for k, c in enumerate(packed_lines([line for h, _, line in lines if h == g], 100))}
    rng.shuffle(lines)
    rows = spark.createDataFrame(lines, "team long, line_no long, line string")
    out = impact.split_messages(rows, "team", 100)
    assert {(r.team, r.chunk): r.text for r in out.collect()} == want and impact.split_messages(rows.limit(0), "team").count() == 0


def test_star_counts_directions_and_prefers_declared(spark):
    pairs = spark.createDataFrame([("a.x", "b.y", "a", "b", True), ("b.y", "a.x", "b", "a", False), ("c.k", "a.z", "c", "a", False)], "f string, t string, a string, b string, validated boolean")
    staged = spark.createDataFrame([("a.x", "b.y", "a", "b"), ("a.q", "b.q", "a", "b")], "f string, t string, a string, b string")
    out = {(r.model, r.neighbour): (r.joins, r.outgoing, r.incoming, r.validated, r.declared) for r in detail.model_star(pairs, staged).collect()}
    assert out[("a", "b")] == (2, 2, 0, True, True) and out[("a", "c")] == (1, 0, 1, False, True) and out[("c", "a")] == (1, 1, 0, False, True)
