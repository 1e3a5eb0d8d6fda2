"""Where chains of single-upstream columns end: against a walk by hand, and the query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from loomtrace.operators import dbt
from loomtrace.plans.estate import TABLES


def walked(pointers):
    for start in pointers:
        at, hops = start, 0
        while hops <= len(pointers) and pointers.get(at) is not None:
            at, hops = pointers[at], hops + 1
        yield (start, at, hops) if at in pointers and pointers[at] is None else (start, None, None)


def test_chains_cycles_and_unknown_ids(spark):
    pointers = {f"c{i:03}": f"c{i - 1:03}" if i else None for i in range(300)}
    pointers |= {"x0": "x1", "x1": "x2", "x2": "x0", "into": "x1", "self": "self", "lost": "gone", "behind": "lost", "alone": None, "two": "c299"}
    out = dbt.column_origin(spark.createDataFrame(list(pointers.items()), "id string, upstream string")).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, walked(pointers)))


def test_no_pointers(spark):
    assert dbt.column_origin(spark.createDataFrame([], "id string, upstream string")).count() == 0


@pytest.mark.parametrize("name", ["b15_column_origin"])
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = sorted(repr(tuple(r[c] for c in names)) for r in entry.queries()[name](spark, sf).collect())
    assert got == sorted(map(repr, want.fetchall())) and got
