"""Walks from many labels at once: 64 of them are the bits of one word, so a row stands for a node and a block of labels.

A label begins at nodes (its seeds) and walks along the edges; a round joins what is new
with the edges, puts words together with ``bit_or`` and takes off the bits that were
there. The round in which a bit first shows is its distance. With ranks there is a word
for each: a bit is in the word of rank r if a way leads there whose weakest hop has that rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomtrace.functions.numbering import numbered
from loomtrace.plans.closure import FOLD, settled
from loomtrace.plans.placed import Hops, Placed

BITS = 64
KEY = ["node", "kind", "block"]


def bits_of(n: Column) -> Column:
    """The word with the bit of number ``n`` in its block."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(n, F.lit(BITS)).cast("int"))


def has(word: Column, place: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, place).bitwiseAND(F.lit(1).cast("long")) == 1


def without(word: str, gone: str) -> Column:
    """The bits of a word that another, null for none, lacks."""
    return F.col(word).bitwiseAND(F.bitwise_not(F.coalesce(gone, F.lit(0).cast("long"))))


def numbered_labels(labels: DataFrame) -> DataFrame:
    """(kind, label, number): distinct labels in order, so that neighbours share a block."""
    return settled(numbered(labels.select("kind", "label").distinct(), F.col("kind"), F.col("label"), out="number"))


def seeded(seeds: DataFrame, numbers: DataFrame, words: list[str]) -> DataFrame:
    """(node, kind, block, words) of ``seeds(node, kind, label)``."""
    rows = seeds.join(numbers, ["kind", "label"]).select("node", "kind", F.floor(F.col("number") / BITS).alias("block"), bits_of(F.col("number")).alias("bit"))
    return rows.groupBy(KEY).agg(*(F.bit_or("bit").alias(w) for w in words))


class _Bits:
    """The bits met so far, by key, in a few tables in the same buckets."""

    def __init__(self, words: list[str], buckets: int):
        self.words, self.buckets = words, buckets
        self.levels: list[list[Placed]] = []

    def add(self, rows: DataFrame, level: int = 0) -> Placed:
        if level == len(self.levels):
            self.levels.append([])
        held = self.levels[level]
        placed = Placed(rows.select(*KEY, *self.words), KEY, self.buckets)
        held.append(placed)
        if len(held) == FOLD:
            union = reduce(DataFrame.union, (p.rows for p in held))
            self.add(union.groupBy(KEY).agg(*(F.bit_or(w).alias(w) for w in self.words)), level + 1)
            held.clear()
        return placed

    def fresh(self, rows: DataFrame) -> DataFrame:
        """``rows`` without bits that were met; one join for each table."""
        for held in self.levels:
            for placed in held:
                met = placed.table.select(*KEY, *(F.col(w).alias(f"_{w}") for w in self.words))
                rows = rows.join(met, KEY, "left").select(*KEY, *(without(w, f"_{w}").alias(w) for w in self.words))
        return rows.where(reduce(lambda a, b: a | b, (F.col(w) != 0 for w in self.words)))


def walk(hops: Hops, seeds: DataFrame, words: list[str], most: int | None = None) -> tuple[list[DataFrame], DataFrame | None]:
    """(rounds, cut) of ``seeds(node, kind, block, words)``.

    ``rounds`` are the new bits of each round, from the first hop on: a label does not
    count at its seed unless a way leads back there. ``cut`` holds the bits that a round
    after ``most`` would have added; null if nothing was left before.

    Words but the first need ``rank`` in ``hops``: word number r passes hops of rank r and more.
    """
    seen, rounds, frontier = _Bits(words, hops.buckets), [], seeds
    while True:
        ahead = hops.follow(frontier, "node")
        if len(words) == 1:
            passed = [F.bit_or(words[0]).alias(words[0])]
        else:
            passed = [F.bit_or(F.when(F.col("rank") >= r, F.col(w)).otherwise(F.lit(0).cast("long"))).alias(w) for r, w in enumerate(words, 1)]
        found = ahead.withColumnRenamed("t", "node").groupBy(KEY).agg(*passed)
        fresh = seen.fresh(found)
        if most is not None and len(rounds) == most:
            return rounds, fresh
        count = Observation()
        placed = seen.add(fresh.observe(count, F.count(F.lit(1)).alias("n")))
        frontier = placed.rows
        if not count.get["n"]:
            return rounds, None
        rounds.append(frontier)


def unpacked(rows: DataFrame, numbers: DataFrame, words: list[str], *more: str) -> DataFrame:
    """A row for each label of each row's first word, with a column for every word that tells whether it has it."""
    place = F.sequence(F.lit(0), F.lit(BITS - 1))
    lit = rows.withColumn("place", F.explode(F.filter(place, lambda p: has(F.col(words[0]), p))))
    lit = lit.select("node", "kind", (F.col("block") * BITS + F.col("place")).alias("number"), *(has(F.col(w), F.col("place")).alias(w) for w in words), *more)
    return lit.join(numbers, ["kind", "number"])


def gathered(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, kind, block, w, near) of all nodes: the labels that lie strictly before them on ``edges(f, t)``, and the fewest hops to one.

    ``seeds(node, kind, label)`` says where labels lie. Every node is answered for at once.
    """
    numbers = numbered_labels(seeds)
    hops = Hops(edges.select("f", "t").distinct())
    rounds, _ = walk(hops, settled(seeded(seeds, numbers, ["w"])), ["w"])
    hops.drop()
    if not rounds:
        return seeds.select("node", "kind", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("w"), F.lit(0).alias("near")).limit(0)
    met = reduce(DataFrame.union, (r.select(*KEY, "w", F.lit(k).alias("near")) for k, r in enumerate(rounds, 1)))
    return settled(met.groupBy(KEY).agg(F.bit_or("w").alias("w"), F.min("near").alias("near")))


def counts(words: DataFrame, kinds: list[str]) -> DataFrame:
    """(node, a column for each kind): how many labels of it a node has."""
    return words.groupBy("node").agg(*(F.sum(F.when(F.col("kind") == k, F.bit_count("w")).otherwise(0)).cast("long").alias(k) for k in kinds))


def best_rank(edges: DataFrame, nodes: DataFrame, words: list[str]) -> DataFrame:
    """(node, best): the best over all ways from one of ``nodes(node)`` of the weakest hop, over ``edges(f, t, rank)``."""
    hops = Hops(edges)
    one = F.lit(1).cast("long")
    seeds = settled(nodes.select("node", F.lit("").alias("kind"), F.lit(0).cast("long").alias("block"), *(one.alias(w) for w in words)).distinct())
    rounds, _ = walk(hops, seeds, words)
    hops.drop()
    if not rounds:
        return nodes.select("node", F.lit(0).alias("best")).limit(0)
    rank = sum((F.col(w).cast("int") for w in words), F.lit(0))
    return reduce(DataFrame.union, rounds).groupBy("node").agg(*(F.bit_or(w).alias(w) for w in words)).select("node", rank.alias("best"))
