"""Graph operators on small hand-written graphs and against plain Python on random ones."""

import random
from collections import deque

import pytest

from loomtrace.functions.text import RANKS
from loomtrace.operators import dbt, graph, hygiene, impact, repair, suggest, walk

NODES = "node_id string, node_type string, name string, owner_id string, creator string, archived boolean, schema_name string, table_name string"
EDGES = "f string, t string, edge_type string, confidence string"


def nodes(spark, ids):
    return spark.createDataFrame([(i, k, i, None, None, None, "S", i) for i, k in ids], NODES)


def edges(spark, rows):
    return spark.createDataFrame([(*r, "feeds", "exact")[:4] if len(r) == 2 else r for r in rows], EDGES)


def starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


def test_diamond_takes_the_smallest_shortest_path(spark):
    n = nodes(spark, [(x, "column") for x in "abcd"])
    got = walk.downstream(n, edges(spark, [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d")]), starts(spark, "a", "zz")).collect()
    assert {(r.node_id, r.depth, tuple(r.path)) for r in got} == {("b", 1, ("a", "b")), ("c", 1, ("a", "c")), ("d", 2, ("a", "b", "d"))}


def test_cap_cycle_and_nodes_walked_through(spark):
    n = nodes(spark, [("a", "column"), ("c", "column")])
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "x")])
    w = walk.walked(n, e, starts(spark, "a"), 2)
    assert walk.truncated(w, e, 2).collect()[0].truncated
    assert [r.node_id for r in walk.downstream(n, e, starts(spark, "a")).collect()] == ["c"]
    assert walk.downstream(n, e.where("edge_type = 'none'"), starts(spark, "a")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(12)]
    rows = list({(rng.choice(names), rng.choice(names), "feeds", rng.choice(["exact", "parsed", "inferred", "fuzzy"])) for _ in range(25)})
    truth = {}
    for s in names[:3]:
        for r in (5, 3, 2, 1):
            seen, queue = {}, deque([(s, 0)])
            while queue:
                at, d = queue.popleft()
                for f, t, _, c in rows:
                    if f == at and RANKS[c] >= r and t not in seen:
                        seen[t] = d + 1
                        queue.append((t, d + 1))
            for t, d in seen.items():
                depth, best = truth.get((s, t), (99, 0))
                truth[s, t] = (min(depth, d), max(best, r))
    got = walk.reach(edges(spark, rows), starts(spark, *names[:3])).collect()
    assert {(r.start, r.node_id): (r.depth, RANKS[r.confidence]) for r in got} == truth


def test_relates_to_is_no_flow(spark):
    e = edges(spark, [("a", "b", "relates_to", "declared")])
    assert walk.reach(e, starts(spark, "a")).count() == 0 and graph.flow_edges(e).count() == 0


def test_layers_end_on_a_cycle(spark):
    n = spark.createDataFrame([("a",), ("b",)], "node_id string")
    assert walk.layers(n, edges(spark, [("a", "b"), ("b", "a")])).count() == 2


def test_owner_lives_if_a_column_does_not_the_reverse(spark):
    rows = [("m", "model", None), ("m::a", "column", "m"), ("m::b", "column", "m"), ("mb_card::1", "mb_card", None)]
    n = spark.createDataFrame([(i, k, i, o, None, None, "S", "t") for i, k, o in rows], NODES)
    live = walk.feeds_a_consumer(n, edges(spark, [("m::a", "mb_card::1")]))
    assert {r.node_id for r in live.collect()} == {"m", "m::a", "mb_card::1"}
    dead = hygiene.unconsumed_columns(n, live).collect()
    assert [(r.owner_id, r.n_dead, r.whole_owner) for r in dead] == [("m", 1, False)]


def test_diff_sees_null_types_and_renames_as_two(spark):
    kind = "node_id string, data_type string"
    a = spark.createDataFrame([("x", None), ("y", "T"), ("z", "T")], kind)
    b = spark.createDataFrame([("x", "T"), ("y", "T"), ("q", "T")], kind)
    assert {(r.node_id, r.change) for r in graph.diff_columns(a, b).collect()} == {("x", "type_changed"), ("z", "removed"), ("q", "added")}


def test_origin_of_chains_and_cycles(spark):
    p = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("l", "lost")], "id string, upstream string")
    assert {r.id: (r.origin, r.hops) for r in dbt.column_origin(p).collect()} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "x": (None, None), "y": (None, None), "l": (None, None)}


def test_messages_are_packed_without_cutting(spark):
    lines = spark.createDataFrame([("k", i, "x" * n) for i, n in enumerate([5, 5, 20, 3, 3])], "k string, line_no int, line string")
    assert [len(r.text) for r in impact.split_messages(lines, "k", limit=11).orderBy("chunk").collect()] == [11, 20, 7]


def test_singular_grains(spark):
    m = spark.createDataFrame([("dim_companies",), ("viz_dim_boxes",), ("fct_glass",)], "name string")
    assert {r.grain for r in suggest.grains(m).collect()} >= {"company", "box", "glass", "dim_company"}


def test_index_shift_stays_in_its_level(spark):
    a = spark.createDataFrame([(1, "L", 0, True), (1, "L", 1, False), (1, "M", 0, False)], "card_id int, level string, index int, dead boolean")
    r = spark.createDataFrame([(1, "L", 0, "a"), (1, "L", 1, "b"), (1, "M", 0, "c")], "card_id int, level string, index int, ref_id string")
    assert {(x.ref_id, x.new_index) for x in repair.remap_aggregations(a, r).collect()} == {("b", 0), ("c", 0)}


def test_qualified_ids_keep_estates_apart(spark):
    e = spark.createDataFrame([("p", "a", "b"), ("q", "a", "b")], "estate_id string, f string, t string")
    assert {r.f for r in graph.qualify(e, "estate_id", ["f", "t"]).collect()} == {"p/a", "q/a"}
