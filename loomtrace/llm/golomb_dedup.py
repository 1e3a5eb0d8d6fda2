"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every partition hashes its texts, keeps each hash once and sends the sorted
   hashes, as Golomb-Rice coded gaps, to the owners of the hash ranges.
2. An owner decodes what it got and answers every sender with a bitmap: one bit
   for each hash sent, set if the hash occurs more than once.
3. Only rows whose bit is set are suspects. Few suspect hashes are broadcast;
   beyond that every task reads the answers to its own partition from a file, so
   rows without company are never shuffled. The suspects' whole texts are grouped
   by value, which is the verification byte by byte; map-side combining leaves at
   most one row for each text and task, however many copies there are.

The universe of hashes is about 1,000 times the number of rows, so a hash costs
some 11 bits on the wire and one clean row in a thousand is a false suspect.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import join_groups, salt_of, small_enough, told, written

#: Hashes of one owner, and hashes that a partition codes at once.
OWNER_HASHES = 4_000_000
RUN_HASHES = 1_000_000

_BLOBS = "owner int, sender long, n int, width int, unary binary, rest binary, repeated binary"


def rice_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Golomb-Rice code of sorted distinct unsigned values: width, unary quotients, remainders."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    width = max(0, int(log2(max(1.0, float(gaps.mean())))))
    ends = np.cumsum((gaps >> np.uint64(width)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    rest = (gaps[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return width, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8)).tobytes()


def rice_decode(n: int, width: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * width).reshape(n, width)
    low = (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((gaps << np.uint64(width)) | low).astype(np.uint64)


def _bitmap(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(np.uint8)).tobytes()


def _flags(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)


def fingerprint(text: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits)


def _send(bits: int, owners: int):
    """Codes the hashes of a partition for their owners."""
    span = -(-(1 << bits) // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = TaskContext.get().partitionId() << 20
        held, size = [], 0

        def coded() -> Iterator[dict]:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            owner = values // np.uint64(span)
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for part, more in zip(np.split(values, cuts), np.split(times > 1, cuts)):
                mine = int(part[0]) // span
                width, unary, rest = rice_encode(part - np.uint64(mine * span))
                yield {"owner": mine, "sender": sender, "n": len(part), "width": width, "unary": unary, "rest": rest, "repeated": _bitmap(more)}

        schema = pa.schema([("owner", pa.int32()), ("sender", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary()), ("repeated", pa.binary())])
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64))
            size += len(held[-1])
            if size >= RUN_HASHES:
                yield pa.RecordBatch.from_pylist(list(coded()), schema)
                held, size, sender = [], 0, sender + 1
        if size:
            yield pa.RecordBatch.from_pylist(list(coded()), schema)

    return run


def _answer(blobs: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps for all who sent it hashes."""
    lists = [rice_decode(*x) for x in zip(blobs.n, blobs.width, blobs.unary, blobs.rest)]
    values, where, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    more = times[where] > 1
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    answers = [_bitmap(a | _flags(r, len(a))) for a, r in zip(np.split(more, cuts), blobs.repeated)]
    return pd.DataFrame({"owner": blobs.owner, "sender": blobs.sender, "answer": answers})


def _decoded(span: int):
    """Each sender's hashes with the answers to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values = rice_decode(r["n"], r["width"], r["unary"], r["rest"]) + np.uint64(r["owner"] * span)
                part = np.full(len(values), r["sender"] >> 20, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(values.astype(np.int64)), pa.array(_flags(r["answer"], r["n"]))], ["part", "key", "verdict"])

    return run


def answers(docs: DataFrame, text: Column, bits: int, n: int) -> DataFrame:
    """(part, key, verdict): the hashes of each partition and whether more than one row may share them."""
    owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(n / OWNER_HASHES))
    owners = min(owners, 1 << bits)
    blobs = written(docs.select(fingerprint(text, bits).alias("fp")).mapInArrow(_send(bits, owners), _BLOBS), "golomb")
    replies = blobs.groupBy("owner").applyInPandas(_answer, "owner int, sender long, answer binary")
    span = -(-(1 << bits) // owners)
    return blobs.join(replies, ["owner", "sender"]).mapInArrow(_decoded(span), "part int, key long, verdict boolean")


def _parts(docs: DataFrame, text_col: str, id_col: str, normalise) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Rows that no other equals, the suspects, the groups of these, and the number of all rows.

    Rows hold the columns of ``docs`` in a struct ``doc``, so no name can clash,
    and the hash ``sha`` of the text.
    """
    docs = docs.select(F.struct("*").alias("doc"))
    text = F.coalesce(normalise(F.col("doc").getField(text_col)), F.lit(""))
    n = docs.count()
    bits = min(60, ceil(log2(max(2, n))) + 10)
    found = answers(docs, text, bits, n)
    shared = written(found.where("verdict").select(F.col("key").alias("fp")).distinct(), "suspects")
    marked = docs.withColumn("fp", fingerprint(text, bits))
    if small_enough(shared, 16):
        alone = marked.join(F.broadcast(shared), "fp", "left_anti")
        rows = marked.join(F.broadcast(shared), "fp", "left_semi")
    else:
        # Written once, so that a row is on one side whatever way it is read again.
        marked = written(told(marked, F.col("fp"), found, n, "suspect"), "marked")
        open_ = marked.where("suspect is null")
        alone = marked.where("not suspect").select("doc", "fp").union(open_.join(shared, "fp", "left_anti").select("doc", "fp"))
        rows = marked.where("suspect").select("doc", "fp").union(open_.join(shared, "fp", "left_semi").select("doc", "fp"))
    # The row number is fixed by writing; it tells repeated rows apart.
    sha = F.sha2(text, 256).alias("sha")
    rows = written(rows.select("doc", F.monotonically_increasing_id().alias("row"), sha, F.length(text).alias("len")), "copies")
    id_ = F.col("doc").getField(id_col)
    order = F.coalesce(id_.cast("long"), F.lit(-(1 << 63)))
    groups = rows.groupBy(text.alias("text")).agg(F.first("sha").alias("sha"), F.first("len").alias("len"), F.max(id_).alias("keep"), F.max_by("row", order).alias("keep_row"), F.count(F.lit(1)).alias("size")).drop("text")
    groups = written(groups, "groups")
    return alone.select("doc", sha), rows, groups, n


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", normalise=lambda c: c) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after ``normalise`` (default: no change), however
    long; null counts as empty, and empty texts are copies of each other. Of equal
    texts the row with the largest id stays; a null id is smaller than all, and of
    rows that also share the id exactly one stays. No row is dropped here; other
    columns of ``docs`` are ignored, whatever their names. An empty table gives
    an empty result.
    """
    alone, rows, groups, n = _parts(docs.select(id_col, text_col), text_col, id_col, normalise)
    copies = join_groups(rows, groups, ["sha", "len"], "size", n, salt_of(F.col("row")))
    id_ = F.col("doc").getField(id_col)
    one = alone.select(id_.alias(id_col), id_.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    more = copies.select(id_.alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
    return one.union(more)


def drop_exact_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", normalise=lambda c: c) -> DataFrame:
    """``docs`` with one row for each distinct text and all columns; see :func:`exact_groups`."""
    alone, rows, groups, _ = _parts(docs, text_col, id_col, normalise)
    stay = groups.select(F.col("keep_row").alias("row"))
    stay = F.broadcast(stay) if small_enough(groups, 8) else stay
    return alone.select("doc.*").union(rows.join(stay, "row", "left_semi").select("doc.*"))
