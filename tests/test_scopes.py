"""Names by query level, upstream cards in reading order, and what a name may have meant."""

import json
import random

from pyspark.sql import functions as F

from loomtrace.operators import bi, impact, suggest


def cards(spark, queries):
    return spark.createDataFrame([(i, json.dumps(q)) for i, q in queries.items()], "card_id long, dataset_query string")


def eq(*refs):
    return ["=", *refs]


TWO_LEVELS = {
    1: {"type": "query", "query": {
        "source-query": {"source-table": 7, "joins": [{"alias": "J", "source-table": 2, "condition": eq(["field", "k", {"join-alias": "J"}], 1)}], "filter": eq(["field", "x", {"join-alias": "J"}], 1)},
        "joins": [
            {"alias": "J", "source-table": 1, "condition": eq(["field", "k", {"join-alias": "J"}], 1)},
            {"alias": "J", "source-table": 3, "condition": eq(1, 1)},
            {"alias": "K", "source-table": "card__5", "source-query": {"source-table": 3, "joins": [{"alias": "J", "source-table": 3, "condition": eq(["field", "k", {"join-alias": "J"}], 2)}]}},
        ],
        "breakout": [["field", "x", {"join-alias": "J"}], ["field", "k", {"join-alias": "K"}]],
    }},
    2: {"lib/type": "mbql/query", "stages": [
        {"source-table": 1, "joins": [{"alias": "J", "stages": [{"source-table": 2}], "conditions": [eq({}, ["field", {"join-alias": "J"}, "x"], 1)]}]},
        {"joins": [{"alias": "J", "stages": [{"source-card": 9}], "conditions": [eq({}, ["field", {"join-alias": "J"}, "x"], 1)]}]},
    ]},
}


def test_an_alias_means_what_its_own_level_says(spark):
    c = cards(spark, TWO_LEVELS)
    scopes = {(r.card_id, r.level, r.alias): r.table_id for r in bi.join_scopes(c).collect()}
    assert scopes == {
        (1, ".query", "J"): 1, (1, ".query", "K"): None, (1, ".query.source-query", "J"): 2, (1, ".query.joins#2.source-query", "J"): 3,
        (2, ".stages#0", "J"): 2, (2, ".stages#1", "J"): None,
    }
    fields = spark.createDataFrame([(10, "x", 1), (11, "k", 1), (20, "x", 2), (21, "k", 2), (31, "K", 3)], "field_id long, column_name string, table_id long")
    context = spark.createDataFrame([(1, 7, None), (2, 1, None)], "card_id long, table_id long, source_card long")
    nothing = bi.result_fields(c.select("card_id", F.lit(None).cast("string").alias("result_metadata")))
    refs = bi.walk_query(c).where("kind = 'field'")
    out = bi.resolve_refs_by_name(refs, context, fields, bi.join_scopes(c), spark.createDataFrame([], "card_id long, field_id long"), nothing)
    got = sorted((r.card_id, r.label, r.target, r.field_id, r.confidence) for r in out.collect())
    # One row for each reference, each by its own level; an alias of a card leaves the source table, which is only parsed.
    assert got == sorted([
        (1, "breakout", "x", 10, "exact"), (1, "breakout", "k", None, None), (1, "joins.condition", "k", 11, "exact"), (1, "source-query.filter", "x", 20, "exact"),
        (1, "source-query.joins.condition", "k", 21, "exact"), (1, "joins.source-query.joins.condition", "k", 31, "exact"),
        (2, "joins.condition", "x", 20, "exact"), (2, "stage1.joins.condition", "x", 10, "parsed"),
    ])


def test_cards_are_named_in_reading_order(spark):
    query = {"type": "query", "query": {
        "source-query": {"source-table": "card__2"}, "source-table": 4,
        "joins": [{"alias": "B", "source-table": "card__9", "condition": eq(["metric", 8], 1)}, {"alias": "A", "source-table": "card__4"}],
        "aggregation": [["sum", ["field", 1, None]], ["metric", 30], ["metric", 3]], "filter": eq(["metric", 1], 1), "fields": [["metric", 99]],
    }}
    c = cards(spark, {1: query, 2: {"lib/type": "mbql/query", "stages": [{"source-card": 9, "joins": [{"alias": "x", "stages": [{"source-card": 7}]}], "filters": [eq({}, ["metric", {}, 8])]}, {"aggregation": [["metric", {}, 5]]}]}})
    order = {i: [r.upstream for r in bi.upstream_cards(c, bi.walk_query(c)).where(F.col("card_id") == i).orderBy("ord").collect()] for i in (1, 2)}
    assert order == {1: [99, 30, 3, 1, 9, 8, 4, 2], 2: [9, 8, 7, 5]}


def test_the_first_upstream_card_gives_a_field(spark):
    deps = spark.createDataFrame([(1, 9, "a"), (1, 4, "b"), (9, 5, "a"), (4, 5, "a"), (5, 9, "z"), (1, 1, "0"), (1, 77, "c")], "card_id long, upstream long, ord string")
    direct = spark.createDataFrame([(9, 100, "exact"), (4, 100, "exact"), (4, 200, "exact"), (5, 300, "parsed"), (1, 200, "exact")], "card_id long, field_id long, confidence string")
    parsed = spark.createDataFrame([(5,), (9,)], "card_id long")
    out = {(r.f, r.t): (r.confidence, r.via) for r in bi.consumed_by_edges(direct, deps, parsed).collect()}
    edge = lambda f, t: (f"mb_field::{f}", f"mb_card::{t}")
    assert out[edge(100, 1)] == ("parsed", 9) and out[edge(300, 1)] == ("parsed", 9) and out[edge(200, 1)] == ("exact", None)
    assert out[edge(300, 9)] == ("parsed", 5) and out[edge(300, 4)] == ("parsed", 5) and out[edge(100, 5)] == ("parsed", 9) and len(out) == 10
    known = spark.createDataFrame([(i,) for i in (1, 4, 5, 9)], "card_id long")
    problems = bi.upstream_problems(deps, known, known.where("card_id <> 5")).collect()
    assert {(r.card_id, r.ref, r.reason) for r in problems} == {(1, "card__77", "card missing or out of scope"), (9, "card__5", "card without a query to walk"), (4, "card__5", "card without a query to walk")}


def test_the_index_finds_what_a_search_of_all_finds(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abc_") for _ in range(rng.randint(1, 9))) for _ in range(250)] + ["Revenue per user", "revenue", "Revénue", "", None]
    rows = [(f"model.x.{i}", "column", n, rng.choice([None, "sums abc_a up"])) for i, n in enumerate(names)]
    nodes = suggest.searchable_alone(spark.createDataFrame(rows, "node_id string, node_type string, name string, description string"))
    queries = ["a", "ab", "abc", " ABC_A ", "cab_", "revenu", "per", "x.1", "aaaa", "b_b_b", "zz", "", None, "revenue per users"]
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    got = {(r.query, r.node_id, r.tier, r.score) for r in suggest.search(nodes, asked, 1_000).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = set()
    for query in queries:
        q = (query or "").strip(" ").lower()
        for node, _, name, text in rows if q else []:
            low, tail = name.lower() if name is not None else None, node.rsplit(".", 1)[1]
            parts = [p for p in (low, tail, text) if p is not None]
            if low is not None and low == q:
                tier = 5
            elif low is not None and low.startswith(q):
                tier = 4
            elif low is not None and any(low[i:].startswith(q) and not low[i - 1].isalnum() for i in range(1, len(low))):
                tier = 3
            elif any(q in p for p in parts):
                tier = 2
            else:
                longest = max(len(q), len(low or ""))
                ratio = 1 - distance(q, low) / longest if low is not None else 0
                if ratio < 0.6:
                    continue
                want.add((query, node, 1, round(ratio, 3)))
                continue
            want.add((query, node, tier, float(tier)))
    assert got == want and len({q for q, *_ in got}) > 8


def test_names_that_are_not_known_have_suggestions(spark):
    rows = [("model.p.orders", "model", "orders", None), ("model.p.orders::customer_id", "column", "customer_id", "model.p.orders"), ("model.p.orders::amount", "column", "amount", "model.p.orders"), ("mb_card::1", "mb_card", "Customers", None)]
    nodes = spark.createDataFrame([(*r, None, None, "S", r[2], None) for r in rows], "node_id string, node_type string, name string, owner_id string, creator string, archived boolean, schema_name string, table_name string, description string")
    asked = spark.createDataFrame([("Orders",), ("orders.customer_idx",), ("amount",), ("custom",), ("nothing like it",)], "query string")
    out = impact.column_suggestions(impact.resolve_column_refs(asked, nodes), nodes)
    got = {}
    for r in out.orderBy("query", "place").collect():
        got.setdefault(r.query, []).append(r.label)
    assert got == {"Orders": ["orders.amount", "orders.customer_id"], "orders.customer_idx": ["orders.customer_id"], "custom": ["orders.customer_id"]}
