"""The driver contract, and queries against their SQL twins at the smallest scale, all over the same views.

Those that the driver compares as well, and whose rounds take long on a small machine, are left to it.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from loomtrace.plans.estate import TABLES, Estate

RUNS = {name: run for suite in entry.SUITES for name, run in suite.runs.items()}
SQL = {name: text for suite in entry.SUITES for name, text in suite.sql.items()}

CHECKED = [
    "a5_write_graph", "b12_trace_reasons", "b24_relates_to_edges", "c3_collections_matching", "c7_normalise_ref", "c9_upstream_cards", "c12_join_scopes", "c12_resolve_refs_by_name", "c16_inline_snippets", "c23_consumed_by_edges", "c25_upstream_problems",
    "d3_bind_fuzzy", "e1_type_waterfall", "f2_merge_edges", "f4_diff_columns", "f7_read_previous", "f8_resolve_baseline", "g11_card_depth", "h4_extra_dashboards", "h8_blast_radius", "h12_split_messages", "j6_suggest", "k1_search", "l1_column_detail", "l15_model_star",
    "m5_validate_descriptions", "m5_validate_staged", "n9_strip_elements", "n13_order_plan", "n16_plan_report", "o5_derive_table_prefix",
]


@pytest.fixture(scope="module")
def estate(spark, sf):
    return Estate(spark, sf)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(estate, duck, name):
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    df = RUNS[name](estate)
    assert sorted(df.columns) == sorted(names)
    close = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted(repr(tuple(close(r[c]) for c in names)) for r in df.collect())
    assert got == sorted(repr(tuple(map(close, r))) for r in want.fetchall())
