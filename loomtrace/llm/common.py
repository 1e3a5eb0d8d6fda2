"""Small helpers that several corpus operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.plans.closure import discard, new_folder, settled, shared_folder

#: The most that any operator sends to every executor, measured before it is sent.
BROADCAST_BYTES = 32 << 20

#: Salts over which one hot key's rows are dealt; so many keys at most are hot.
SALTS = 16
HOT_KEYS = 20_000
#: Keys that one file of verdicts holds, about.
FILE_KEYS = 8_000_000

__all__ = ["discard", "new_folder", "written"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``."""
    return shared_folder(spark)


def written(df: DataFrame, what: str, folder: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    The plan above starts from files, so a lost executor costs no recomputation
    and values such as row numbers no longer change. :func:`loomtrace.plans.closure.clear`
    deletes all such tables once results are saved.
    """
    return settled(df, what, folder)


def small_enough(df: DataFrame, row_bytes: int) -> bool:
    """Whether ``df`` (a written table) may be broadcast, by a count of its rows."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def salt_of(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, salt: Column, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group.

    ``groups`` is a written table with one row for each key, and ``size`` its column
    with the number of rows; ``total`` is their sum at most. A group with more than
    its share of ``total`` is hot: its rows are dealt over salts. No more than
    ``HOT_KEYS`` groups can be, so their keys are broadcast.
    """
    hot_from = max(1_000, total // HOT_KEYS)
    if total < hot_from:
        return rows.join(groups, on, how)
    hot = F.broadcast(groups.where(F.col(size) >= hot_from).select(*on, F.lit(True).alias("_hot")))
    dealt = rows.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    every = F.when(F.col(size) >= hot_from, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(groups.withColumn("_salt", F.explode(every)), [*on, "_salt"], how).drop("_salt")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it, for a path or a URI."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri)) if re.match(r"^\w+:/", uri) else (fs.LocalFileSystem(), uri)


def told(rows: DataFrame, key: Column, verdicts: DataFrame, n: int, out: str) -> DataFrame:
    """``rows`` with a verdict for each, none of them shuffled.

    ``verdicts(part, key, verdict)`` holds, for each partition ``part`` of the scan
    under ``rows``, its keys and a boolean that depends on the key alone. They go
    to files by part, and the task that reads the same partition of ``rows``
    again looks its own up. A key that is not among them (the scan was cut
    another way) has a null verdict, never a wrong one; the caller decides these
    with a join. Use the result once, as the select under a written table.
    """
    files = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // FILE_KEYS))
    folder = new_folder(rows.sparkSession, "verdicts")
    dealt = verdicts.select("part", "key", "verdict").repartitionById(files, F.pmod("part", F.lit(files)).cast("int")).sortWithinPartitions("part", "key")
    names = {int(m[1]): name for name in written(dealt, "verdicts", folder).inputFiles() if (m := re.search(r"part-(\d+)-[^/]*$", name))}

    @F.arrow_udf("boolean")
    def verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        part = TaskContext.get().partitionId()
        keys, said = np.empty(0, np.int64), np.empty(0, bool)
        if name := names.get(part % files):
            system, path = opened(name)
            mine = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=["key", "verdict"], filter=ds.field("part") == part)
            keys, said = mine["key"].to_numpy(), mine["verdict"].to_numpy()
            order = np.argsort(keys, kind="stable")
            keys, said = keys[order], said[order].astype(bool)
        for batch in batches:
            asked = batch.to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
            known = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
            yield pa.array(said[at] if len(keys) else known, pa.bool_(), mask=~known)

    return rows.withColumn(out, verdict(key))
