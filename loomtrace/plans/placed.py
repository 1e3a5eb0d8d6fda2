"""Tables that stay where they are: bucketed and sorted by key, so that rounds of joins shuffle the frontier alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomtrace.plans.closure import FOLD, discard, joined_rounds, new_folder, settled_rows

#: Rows of a bucket, about, and edges out of one node from which on they lie in several buckets.
BUCKET_ROWS, HUB = 2_000_000, 500_000
#: Rows that may be broadcast, by count; a key and a number each.
BROADCAST_ROWS = 200_000


def buckets_for(df: DataFrame, rows: int) -> int:
    """As many as shuffles have partitions, more for tables that are too large for these."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a hint to broadcast it if it has no more than ``rows`` rows, by a count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Placed:
    """A table in the shared folder, bucketed and sorted by ``keys``. ``drop`` deletes it.

    ``rows`` are the same files without their buckets. Unions must read these: Spark 4.1
    takes a union of tables in the same buckets for dealt by their keys, leaves out the
    shuffle of a grouping or join above it, and then reads the tables without buckets.
    """

    def __init__(self, df: DataFrame, keys: list[str], buckets: int):
        self.spark, self.folder = df.sparkSession, new_folder(df.sparkSession, "placed")
        self.name = f"placed_{self.folder.rsplit('-', 1)[1]}"
        # Dealt by the buckets' own hash, so each is one file.
        dealt = df.repartition(buckets, *keys)
        dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", self.folder).saveAsTable(self.name)
        self.table = self.spark.table(self.name)
        self.rows = self.spark.read.schema(self.table.schema).parquet(self.folder)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        discard(self.spark, self.folder)


class Hops:
    """Edges in buckets by the node that they leave; those of a hub by part of their other end as well.

    ``hops`` has ``f``, ``t`` and what else a round needs. :meth:`follow` joins a
    frontier to it: only the frontier moves, a row for a hub to each of its buckets.
    """

    def __init__(self, hops: DataFrame, hub: int = HUB):
        hops, self.rows = settled_rows(hops)
        self.buckets = buckets_for(hops, self.rows)
        slots = F.ceil(F.col("n") / F.lit(hub)).cast("int")
        degrees = hops.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub)
        # No more than rows / hub of them; without a single one the join is left out.
        self.hubs, several = settled_rows(degrees.select("f", slots.alias("slots"))) if self.rows > hub else (None, 0)
        if not several:
            self.hubs = None
            self.placed = Placed(hops, ["f"], self.buckets)
            return
        self.hubs = F.broadcast(self.hubs) if several <= BROADCAST_ROWS else self.hubs
        slot = F.when(F.col("slots").isNull(), 0).otherwise(F.pmod(F.xxhash64("t"), F.col("slots")).cast("int"))
        self.placed = Placed(hops.join(self.hubs, "f", "left").withColumn("slot", slot).drop("slots"), ["f", "slot"], self.buckets)

    def follow(self, frontier: DataFrame, at: str) -> DataFrame:
        """``frontier`` joined with the edges that leave its node ``at``; ``f`` is that node."""
        ahead = frontier.withColumnRenamed(at, "f")
        if self.hubs is None:
            return ahead.join(self.placed.table, "f")
        every = F.when(F.col("slots").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("slots") - 1))
        ahead = ahead.join(self.hubs, "f", "left").withColumn("slot", F.explode(every)).drop("slots")
        return ahead.join(self.placed.table, ["f", "slot"]).drop("slot")

    def drop(self) -> None:
        self.placed.drop()


class Visited:
    """The keys met so far, in a few tables in the same buckets; ``FOLD`` of one level become one of the next."""

    def __init__(self, keys: list[str], buckets: int):
        self.keys, self.buckets = keys, buckets
        self.levels: list[list[DataFrame]] = []
        self._files: list[list[DataFrame]] = []

    def add(self, rows: DataFrame, level: int = 0) -> Placed:
        """``rows`` as a table in the buckets; their keys are met from now on."""
        if level == len(self.levels):
            self.levels.append([])
            self._files.append([])
        held, files = self.levels[level], self._files[level]
        placed = Placed(rows, self.keys, self.buckets)
        held.append(placed.table.select(self.keys))
        files.append(placed.rows.select(self.keys))
        if len(held) == FOLD:
            self.add(joined_rounds(files), level + 1)
            held.clear()
            files.clear()
        return placed

    def unseen(self, rows: DataFrame) -> DataFrame:
        """``rows`` whose key is new: one join for each table, all on the same buckets."""
        for held in self.levels:
            for table in held:
                rows = rows.join(table, self.keys, "left_anti")
        return rows


def spread_in_buckets(seed: DataFrame, step: Callable[[DataFrame, int], DataFrame], key: list[str], buckets: int, most: int | None = None) -> DataFrame:
    """All rows reached from ``seed`` by ``step``, each ``key`` once, at its first round; met keys stay in their buckets."""
    seen, rounds, rows = Visited(key, buckets), [], seed
    while True:
        count = Observation()
        rounds.append(seen.add(rows.observe(count, F.count(F.lit(1)).alias("n"))))
        if not count.get["n"] or (most is not None and len(rounds) > most):
            return joined_rounds([p.rows for p in rounds])
        rows = seen.unseen(step(rounds[-1].table, len(rounds))).select(seed.columns)
