"""Written tables, and fixpoints over them: a table for each round, one small action to test for the end."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Tables of one level that become one of the next.
FOLD = 8


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting, as in tests, gets a temporary
    folder; on a cluster the setting is needed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The folder that holds all tables this application has written on its way."""
    return f"{shared_folder(spark)}/loomtrace-{spark.sparkContext.applicationId}"


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a written table that no plan reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables written on the way; results that still read them must have been saved."""
    discard(spark, run_folder(spark))


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{run_folder(spark)}/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame, what: str = "rounds", folder: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, so lineage is cut and a lost executor costs no rounds."""
    spark = df.sparkSession
    folder = folder or new_folder(spark, what)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def settled_with(df: DataFrame, digest: Column, folder: str | None = None) -> tuple[DataFrame, object]:
    """As :func:`settled`, with an aggregate of the rows, taken while they are written."""
    seen = Observation()
    out = settled(df.observe(seen, digest.alias("digest")), folder=folder)
    return out, seen.get["digest"]


def settled_rows(df: DataFrame, folder: str | None = None) -> tuple[DataFrame, int]:
    """As :func:`settled`, with the number of rows."""
    return settled_with(df, F.count(F.lit(1)), folder)


def joined_rounds(rounds: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, rounds)


class Seen:
    """The keys met so far, as a few tables.

    Each round adds its own; ``FOLD`` tables of one level become one of the next, so
    a key is rewritten, and a round joins with tables, only so often as the
    logarithm of the depth says.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[list[tuple[DataFrame, str | None]]] = []

    def add(self, keys: DataFrame, level: int = 0, folder: str | None = None) -> None:
        if level == len(self.levels):
            self.levels.append([])
        held = self.levels[level]
        held.append((keys, folder))
        if len(held) == FOLD:
            folder = new_folder(self.spark, "seen")
            table = settled(joined_rounds([t for t, _ in held]), folder=folder)
            for _, old in held:
                if old:
                    discard(self.spark, old)
            held.clear()
            self.add(table, level + 1, folder)

    def all(self) -> DataFrame:
        return joined_rounds([t for held in self.levels for t, _ in held])


def spread(seed: DataFrame, step: Callable[[DataFrame, int], DataFrame], key: list[str], max_rounds: int | None = None) -> DataFrame:
    """All rows reached from ``seed`` by ``step``, each ``key`` once, at its first round.

    ``step(frontier, round)`` gives candidate rows with the columns of ``seed``, at
    most one for each key; rows whose key was seen before are dropped. It ends when a
    round adds nothing or after ``max_rounds``.
    """
    frontier, rows = settled_rows(seed)
    rounds, done, seen = [frontier], 0, Seen(seed.sparkSession)
    while rows and (max_rounds is None or done < max_rounds):
        seen.add(frontier.select(key))
        done += 1
        frontier, rows = settled_rows(step(frontier, done).join(seen.all(), key, "left_anti").select(seed.columns))
        rounds.append(frontier)
    return joined_rounds(rounds)


def relax(state: DataFrame, step: Callable[[DataFrame], DataFrame], digest: Column, max_rounds: int) -> DataFrame:
    """``state`` after ``step`` upon ``step``, until the aggregate ``digest`` of it stays."""
    spark, folder = state.sparkSession, new_folder(state.sparkSession, "state")
    state, before = settled_with(state, digest, folder)
    for _ in range(max_rounds):
        held, folder = folder, new_folder(spark, "state")
        state, after = settled_with(step(state), digest, folder)
        discard(spark, held)
        if after == before:
            break
        before = after
    return state
