"""Queries that start from everything, by brute force on small graphs."""

import random
from types import SimpleNamespace

import pytest

from loomtrace.functions.text import RANKS
from loomtrace.plans import detail_queries, graph_queries

RUNS = graph_queries.suite.runs | detail_queries.suite.runs
KINDS = {"m": "model", "c": "column", "f": "mb_field", "k": "mb_card", "d": "mb_dashboard"}


def estate(spark, ids, rows):
    """Stands in for an estate; the kind of a node is its first letter."""
    owner = lambda i: f"m{int(i[1:]) % 2}" if i[0] == "c" else None
    n = spark.createDataFrame([(i, KINDS[i[0]], i, owner(i), None, None, "S", i) for i in ids], "node_id string, node_type string, name string, owner_id string, creator string, archived boolean, schema_name string, table_name string")
    e = spark.createDataFrame(rows, "f string, t string, edge_type string, confidence string")
    views = {"e_nodes": n, "e_columns": n.where("node_type = 'column'"), "e_models": n.where("node_type = 'model'"), "e_dashcards": n.where("node_type = 'mb_dashboard'").withColumnRenamed("node_id", "dash_id")}

    def sql(text):
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(text)

    cards = n.where("node_type = 'mb_card'").selectExpr("node_id", "'query' as query_type")
    return SimpleNamespace(spark=spark, nodes=n, edges=e, cards=cards, sql=sql)


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(5)
    ids = ["m0", "m1", *(f"c{i}" for i in range(7)), *(f"f{i}" for i in range(4)), *(f"k{i}" for i in range(3)), "d0", "d1"]
    rows = {(f"c{i}", f"c{j}", "feeds", rng.choice(["exact", "parsed"])) for i in range(6) for j in rng.sample(range(i + 1, 7), min(2, 6 - i))}
    rows |= {("c2", "f0", "binds_to", "exact"), ("c6", "f1", "binds_to", "fuzzy"), ("f0", "k0", "consumed_by", "exact"), ("f1", "k0", "consumed_by", "exact"), ("f2", "k1", "consumed_by", "exact"), ("k0", "d0", "appears_on", "exact"), ("m0", "m1", "references", "exact")}
    rows = sorted(rows)
    found = {}
    for s in ids:
        for level in (5, 4, 3, 2, 1):
            edge, seen = [(f, t) for f, t, _, c in rows if RANKS[c] >= level], set()
            depth, front = 0, {s}
            while front:
                depth, front = depth + 1, {t for f, t in edge if f in front} - seen
                for t in front:
                    least, best = found.get((s, t), (99, 0))
                    found[s, t] = (min(least, depth), max(best, level))
                seen |= front
    return estate(spark, ids, rows), ids, rows, found


def below(found, s, *kinds):
    return {t for a, t in found if a == s and t[0] in kinds}


def test_reach_from_every_column_and_board(small):
    e, _, _, found = small
    got = {(r.start, r.node_id): (r.depth, RANKS[r.confidence]) for r in RUNS["g3_reach_down"](e).collect()}
    assert got == {p: v for p, v in found.items() if p[0][0] == "c"}
    assert {(r.start, r.node_id, r.depth) for r in RUNS["g3_reach_up"](e).collect()} == {(t, s, d) for (s, t), (d, _) in found.items() if t[0] == "d"}
    assert {(r.start, r.node_id) for r in RUNS["g4_reached_of_type"](e).collect()} == {p for p in found if p[0][0] == "c" and p[1][0] == "d"}


def test_subgraph_and_radius_of_every_column(small):
    e, ids, rows, found = small
    columns, want = [i for i in ids if i[0] == "c"], set()
    for s in columns:
        for side in ({s} | {t for a, t in found if a == s}, {s} | {a for a, t in found if t == s}):
            want |= {(s, f, t, k) for f, t, k, _ in rows if f in side and t in side}
    assert {tuple(r) for r in RUNS["g6_lineage_subgraph"](e).select("start", "f", "t", "edge_type").collect()} == want
    size = lambda s: tuple(len(below(found, s, k)) for k in "cfkd")
    assert {r.start: (r.n_columns, r.n_fields, r.n_cards, r.n_dashboards) for r in RUNS["h8_blast_radius"](e).collect()} == {s: size(s) for s in columns}
    assert {r.start: (r.down_columns, r.fields, r.cards, r.dashboards) for r in RUNS["l1_column_detail"](e).collect()} == {s: size(s) for s in columns}


def test_details_of_every_bi_object_and_model(small):
    e, ids, _, found = small
    objects = [i for i in ids if i[0] in "fkd"]
    up = {o: len({a for a, t in found if t == o and a[0] == "c"}) for o in objects}
    assert {r.start: r.columns for r in RUNS["l2_bi_detail"](e).collect()} == up
    gap = {"f2": "field-unbound", "f3": "field-unbound", "k1": "fields-unbound", "k2": "query-unresolved", "d1": "dashboard-unresolved"}
    assert {r.start: r.gap for r in RUNS["l3_chain_gap"](e).collect()} == {o: gap.get(o) for o in objects}
    of = lambda m: set().union(*(below(found, c, "k") for c in ids if c[0] == "c" and int(c[1:]) % 2 == int(m[1:])))
    assert {r.start: (r.downstream, r.cards) for r in RUNS["l4_model_detail"](e).collect()} == {"m0": (1, len(of("m0"))), "m1": (0, len(of("m1")))}


def test_truncated_at_the_default_depth(spark):
    e = estate(spark, [f"c{i}" for i in range(22)], [(f"c{i}", f"c{i + 1}", "feeds", "exact") for i in range(21)])
    assert {r.start: r.truncated for r in RUNS["g2_truncated"](e).collect()} == {f"c{i}": i == 0 for i in range(22)}


def test_star_hides_what_is_beyond_ten(spark):
    columns = spark.createDataFrame([(f"c{i}", f"m{i:02}") for i in range(13)], "node_id string, owner_id string")
    relates = spark.createDataFrame([("c0", f"c{i}", "relates_to", "declared") for i in range(1, 13)], "f string, t string, edge_type string, confidence string")
    none = spark.createDataFrame([], "f string, t string, a string, b string")
    rows = RUNS["l15_model_star"](SimpleNamespace(relates=relates, columns=columns, sql=lambda _: none)).where("model = 'm00'").collect()
    assert [r.neighbour for r in sorted(rows, key=lambda r: r.neighbour)] == [f"m{i:02}" for i in range(1, 11)] and {r.hidden for r in rows} == {2}
