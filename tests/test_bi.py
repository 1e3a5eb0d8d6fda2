"""BI operators on small hand-written cards."""

import json

from loomtrace.operators import bi
from loomtrace.sources import artifacts


def cards(spark, queries):
    return spark.createDataFrame([(i, json.dumps(q)) for i, q in queries.items()], "card_id long, dataset_query string")


def legacy(**query):
    return {"type": "query", "query": {k.replace("_", "-"): v for k, v in query.items()}}


DEEP = {
    1: legacy(source_table=1, joins=[{"alias": "A", "source-table": 2}, {"alias": "B", "source-table": "card__11"}]),
    2: legacy(joins=[{"alias": "A", "source-query": {"source-table": "card__12", "joins": [{"source-table": "card__13"}]}}], source_query={"source-query": {"source-query": {"source-table": "card__14"}}}),
    3: {"stages": [{"source-table": 7}, {"joins": [{"stages": [{"source-table": 1}]}, {"stages": [{"source-card": 15}, {"joins": [{"stages": [{"source-card": 16}]}]}]}]}]},
    4: legacy(source_table="card__17", source_query={"source-query": {"source-table": 9}}, filter=["=", ["field", 1, None], {"source-table": "card__99"}]),
    5: {"stages": [{"source-card": 18}, *[{} for _ in range(9)], {"source-table": 4}]},
    6: {"type": "native", "native": {"query": "select 1"}},
    7: {},
}


def test_cards_are_found_in_every_join_stage_and_level(spark):
    c = cards(spark, DEEP)
    refs = spark.createDataFrame([(6, "metric", "40"), (6, "field", "41")], "card_id long, kind string, target string")
    got = {(r.card_id, r.upstream) for r in bi.upstream_cards(c, refs).collect()}
    assert got == {(1, 11), (2, 12), (2, 13), (2, 14), (3, 15), (3, 16), (4, 17), (5, 18), (6, 40)}


def test_context_is_the_innermost_query(spark):
    got = {r.card_id: (r.table_id, r.source_card) for r in bi.source_context(cards(spark, DEEP)).collect()}
    assert got == {1: (1, None), 2: (None, 14), 3: (7, None), 4: (9, None), 5: (None, 18), 6: (None, None), 7: (None, None)}


def test_no_card_reads_anything(spark):
    assert bi.upstream_cards(cards(spark, {1: {}}), spark.createDataFrame([], "card_id long, kind string, target string")).count() == 0
    assert [tuple(r) for r in bi.source_context(cards(spark, {1: {}})).collect()] == [(1, None, None)]


def test_result_metadata_resolves_names_before_the_guess(spark, tmp_path):
    def column(name, *ref):
        return {"name": name, "field_ref": list(ref)}

    shown = [column("total", "field", 1, None), column("late", "field", {"base-type": "x"}, 2), column("twice", "field", 1, None), column("twice", "field", 2, None), column("gone", "field", 99, None), column("sum", "aggregation", 0), column("text", "field", "total", None)]
    (tmp_path / "cards.json").write_text(json.dumps([{"id": 50, "name": "up", "dataset_query": {}, "result_metadata": shown}]))
    for name in ("collections", "snippets", "database_metadata_1", "dashboard_1"):
        (tmp_path / f"{name}.json").write_text("{}")
    read = artifacts.read_bi_snapshot(spark, str(tmp_path))["cards"].withColumnRenamed("id", "card_id")
    results = bi.result_fields(read)
    names = ["total", "late", "twice", "gone", "sum", "text", "Total", "plain"]
    refs = spark.createDataFrame([(1, "filter", n, a) for n in names for a in (None, "J")], "card_id long, label string, target string, join_alias string")
    context = spark.createDataFrame([(1, None, 50)], "card_id long, table_id long, source_card long")
    fields = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "total", 1), (4, "twice", 1), (5, "gone", 1), (6, "sum", 1), (7, "plain", 1)], "field_id long, column_name string, table_id long")
    joins = spark.createDataFrame([], "card_id long, alias string, table_id long")
    consumed = spark.createDataFrame([(50, i) for i in range(1, 8)], "card_id long, field_id long")
    got = {(r.target, r.field_id, r.confidence) for r in bi.resolve_refs_by_name(refs.where("join_alias is null"), context, fields, joins, consumed, results).collect()}
    assert got == {("total", 1, "exact"), ("late", 2, "exact"), ("twice", None, None), ("gone", None, None), ("sum", 6, "parsed"), ("text", None, None), ("Total", 3, "parsed"), ("plain", 7, "parsed")}
    aliased = {(r.target, r.field_id, r.confidence) for r in bi.resolve_refs_by_name(refs.where("join_alias = 'J' and target = 'total'"), context, fields, joins, consumed, results).collect()}
    assert aliased == {("total", 1, "parsed")}


def test_tags_and_snippets_of_every_kind(spark):
    native = spark.createDataFrame([(1, "a {{ n }} [[and {{ when}}]] {{#7-top}} {{ pick }} {{free}}"), (2, "x {{ snippet: Outer }} {{filters}} {{snippet:gone}}"), (3, "plain")], "card_id long, sql string")
    tags = spark.createDataFrame([(1, "n", "number"), (1, "when", "datetime"), (1, "pick", "card"), (1, "n", "number")], "card_id long, tag string, kind string")
    out = {r.card_id: r.sql for r in bi.substitute_tags(native, tags).collect()}
    assert out[1] == f"a 1 and '1970-01-01' {bi.CARD_PLACEHOLDER} {bi.CARD_PLACEHOLDER} {bi.DEFAULT_LITERAL}" and out[3] == "plain"
    snippets = spark.createDataFrame([(1, "outer", "o {{snippet: MID}}"), (2, "mid", "m {{snippet: low}}"), (3, "low", "l {{snippet: outer}}"), (9, "named", "by id")], "snippet_id long, name string, content string")
    typed = spark.createDataFrame([(2, "filters", "snippet", "renamed since", 9)], "card_id long, tag string, kind string, snippet_name string, snippet_id long")
    out = {r.card_id: (r.sql, r.missing) for r in bi.inline_snippets(native, snippets, typed).collect()}
    assert out[2] == ("x o m l  by id ", 2) and out[3] == ("plain", 0)  # too deep once, unknown once
