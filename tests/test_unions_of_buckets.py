"""Rounds that lie in the same buckets, put together: a key shows once, and no shuffle is left out."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators import bi, packed, walk
from loomtrace.plans.placed import Hops, spread_in_buckets


@pytest.fixture
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_inherited_fields_show_once(spark, shuffled_joins):
    """Two cards that read each other and a line of twelve behind them, with neighbouring fields: their words fill up over several rounds."""
    reads = [(0, 1), (1, 0), *((i + 1, i) for i in range(1, 13))]
    deps = spark.createDataFrame(reads, "card_id long, upstream long")
    fields = [(c, f) for c in range(14) for f in (c, 40 + c, 500 + c)]
    up = {c: {u for d, u in reads if d == c} for c in range(14)}
    want = []
    for card in range(14):
        seen, front = set(), {card}
        while front := set().union(*(up[c] for c in front)) - seen:
            seen |= front
        want += sorted({(card, f) for c, f in fields if c in seen})
    found = bi.transitive_fields(deps, spark.createDataFrame(fields, "card_id long, field_id long"))
    assert sorted((r.card_id, r.field_id) for r in found.collect()) == sorted(want)


def test_words_met_are_folded_by_key(spark, shuffled_joins):
    edges = spark.range(12).select(F.col("id").cast("string").alias("f"), ((F.col("id") + 1) % 12).cast("string").alias("t"))
    _, seeds = walk._labelled(spark.range(12).select(F.col("id").cast("string").alias("node_id")))
    rounds, _ = packed.walk(Hops(edges), seeds, ["w"])
    met = reduce(DataFrame.union, rounds).groupBy(packed.KEY).agg(F.bit_or("w").alias("w"))
    assert len(rounds) == 12 and met.count() == 12 and met.where(F.bit_count("w") == 12).count() == 12


def test_rounds_of_a_spread_can_be_grouped_and_joined(spark, shuffled_joins):
    hops = Hops(spark.range(12).select(F.col("id").alias("f"), (F.col("id") + 1).alias("t")))
    step = lambda frontier, _: hops.follow(frontier, "node").select(F.col("t").alias("node")).distinct()
    found = spread_in_buckets(spark.range(1).select(F.col("id").alias("node")), step, ["node"], hops.buckets)
    assert found.join(found, "node").count() == 13 and found.groupBy("node").count().count() == 13
