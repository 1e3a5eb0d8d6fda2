"""Near duplicates by SimHash, found with a grid over segment bit counts.

The 64 bits of a fingerprint are cut into 32 segments of two bits. The vector
of bit counts of the segments is the embedding: the Manhattan distance of two
vectors never exceeds the Hamming distance of the fingerprints. A count is kept
in unary (0 = 00, 1 = 01, 2 = 11), so the Manhattan distance of two whole
vectors is one xor and one bit count in generated code.

The grid: the 32 coordinates are cut into ``limit + fixed`` blocks. Vectors at
a Manhattan distance of at most ``limit`` agree on at least ``fixed`` whole
blocks, so they meet in the cell of one choice of ``fixed`` blocks. In a cell
the lower bound is tested first, then the fingerprints themselves.

Dense groups of near copies do not give all their pairs: every member is first
tested with three heads of its cell, the groups found so are labelled, and a
second pass joins only members of cells with several labels. A cell that is still
too full is cut further, by the coordinates that it does not fix: two near
vectors agree on whole blocks of these as well. No link that could join two
groups is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.llm.common import BROADCAST_BYTES, join_groups, salt_of, small_enough, text_or_empty, told, written
from loomtrace.llm.components import components

#: Largest number of differing bits of a link; words in a shingle.
LIMIT = 4
WORDS = 4
#: Two-bit segments of a fingerprint.
SEGMENTS = 32
#: Chance that two unrelated fingerprints have one segment's bit count in common.
AGREE = 0.375
#: Members of a cell up to which all its pairs are tested, and blocks fixed at a further cut.
FULL, FURTHER = 1_000, 2

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CHUNK = 1 << 14


def simhash(text: bytes, words: int = WORDS) -> int:
    """Fingerprint of one whole text, unsigned; a text without words has 0."""
    found = text.translate(_LOWER).split()
    n = len(found)
    if not n:
        return 0
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    if n <= words:
        return hashed(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - words]]).tolist()
    hashes = [hashed(joined[a:z], 42) for a, z in zip(starts, (ends[words - 1 :] - 1).tolist())]
    values = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), _CHUNK):
        bits = np.unpackbits(values[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int(np.packbits((2 * counts > len(values)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    """Replaces the last column, a text, by its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            prints = np.fromiter((simhash(x.as_py(), words) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return run


def _printed(rows: DataFrame, words: int) -> DataFrame:
    return rows.mapInArrow(_fingerprints(words), T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(id, fp) for each row; null texts count as empty."""
    return _printed(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col)), words)


def embedding(fp: Column) -> Column:
    """Bit counts of the two-bit segments, in unary."""
    odd, even = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(0x5555555555555555)), fp.bitwiseAND(F.lit(0x5555555555555555))
    return F.shiftleft(odd.bitwiseAND(even), 1).bitwiseOR(odd.bitwiseOR(even))


def blocks_fixed(n: int, limit: int = LIMIT) -> int:
    """How many whole blocks a cell fixes, three at least, so that ``n`` fingerprints cost least: cells and chance meetings in them."""

    def cost(fixed: int) -> float:
        return comb(limit + fixed, fixed) * (1 + n * AGREE ** (SEGMENTS * fixed / (limit + fixed)))

    return min(range(3, 9), key=cost)


def block_masks(limit: int = LIMIT, fixed: int = 3, segments: tuple[int, ...] = tuple(range(SEGMENTS))) -> list[tuple[int, tuple[int, ...]]]:
    """For each choice of ``fixed`` of ``limit + fixed`` blocks of ``segments``: a mask, as a signed long, and the segments left over."""
    blocks = [tuple(map(int, part)) for part in np.array_split(np.array(segments), limit + fixed)]
    out = []
    for chosen in combinations(blocks, fixed):
        held = {s for block in chosen for s in block}
        mask = sum(3 << 2 * s for s in held)
        out.append((mask - (1 << 64) if mask >> 63 else mask, tuple(s for s in segments if s not in held)))
    return out


def _vector() -> Column:
    return embedding(F.col("fp"))


def _cells(prints: DataFrame, masks: list[int]) -> DataFrame:
    """One row for each cell of a fingerprint, with the number ``k`` of the choice of blocks."""
    keys = F.array(*(F.xxhash64(F.lit(k), _vector().bitwiseAND(F.lit(m))) for k, m in enumerate(masks)))
    return prints.select("*", F.posexplode(keys).alias("k", "cell"))


def _near(a: str, b: str, limit: int) -> Column:
    fp_a, fp_b = F.col(a), F.col(b)
    bound = F.bit_count(embedding(fp_a).bitwiseXOR(embedding(fp_b))) <= limit
    return bound & (F.bit_count(fp_a.bitwiseXOR(fp_b)) <= limit)


def _pairs(left: DataFrame, right: DataFrame, limit: int) -> DataFrame:
    """Links (a, b) between different labels that share a cell."""
    a = left.select("cell", F.col("fp").alias("fp_a"), F.col("root").alias("a"))
    b = right.select("cell", F.col("fp").alias("fp_b"), F.col("root").alias("b"))
    order = F.col("a") < F.col("b") if left is right else F.col("a") != F.col("b")
    # Spark sizes a table as if an explode added no rows, and would broadcast cells.
    return a.join(b.hint("merge"), (a.cell == b.cell) & order & _near("fp_a", "fp_b", limit)).select("a", "b").distinct()


def _first(cells: DataFrame, limit: int) -> DataFrame:
    """Links (a, b) of every fingerprint with the heads of its cells: the least, the greatest and one by chance."""
    heads = cells.groupBy("cell").agg(F.min("fp").alias("least"), F.max("fp").alias("most"), F.min_by("fp", F.xxhash64("fp")).alias("any")).where("least <> most")
    near = [(F.col("fp") != F.col(head)) & _near("fp", head, limit) for head in ("least", "most", "any")]
    # Most who share a cell are far apart, so distances are part of the join.
    found = cells.join(heads.withColumnRenamed("cell", "c").hint("merge"), (F.col("cell") == F.col("c")) & (near[0] | near[1] | near[2]))
    linked = (F.when(test, F.col(head)) for test, head in zip(near, ("least", "most", "any")))
    return found.select(F.col("fp").alias("a"), F.explode(F.array_compact(F.array(*linked))).alias("b"))


def _second(cells: DataFrame, choices: list[tuple[int, tuple[int, ...]]], limit: int) -> DataFrame:
    """Links (a, b) between the labels ``root`` of members of one cell.

    Cells of one label give none. A full cell of several is cut by blocks of the
    segments that it leaves open, and there only those who differ from the label of
    one member, taken by chance, meet all others.
    """
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    full = written(sizes.where(F.col("n") > FULL).select("cell", (F.col("r0") != F.col("r1")).alias("mixed")), "full")
    several = full.count()
    if not several:
        return _pairs(cells, cells, limit)
    small = several * 16 <= BROADCAST_BYTES
    few = cells.join(F.broadcast(full) if small else full, "cell", "left_anti")
    found = _pairs(few, few, limit)
    mixed = full.where("mixed").select("cell")
    rows = cells.join(F.broadcast(mixed) if small else mixed, "cell", "left_semi")
    finer = F.array(*(F.array(*(F.lit(m) for m, _ in block_masks(limit, FURTHER, left))) for _, left in choices))
    keys = F.transform(F.element_at(finer, F.col("k") + 1), lambda m, j: F.xxhash64(F.col("cell"), j, _vector().bitwiseAND(m)))
    cut = written(rows.select("fp", "root", F.explode(keys).alias("cell")), "cells")
    taken = cut.groupBy("cell").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by("root", F.xxhash64("fp")).alias("taken")).where("r0 <> r1").select("cell", "taken")
    cut = written(cut.join(taken.hint("merge"), "cell"), "cells")
    return found.union(_pairs(cut.where("root <> taken"), cut, limit))


def near_links(prints: DataFrame, limit: int = LIMIT, fixed: int | None = None) -> DataFrame:
    """(node, root): components of the distinct fingerprints in ``prints(fp)`` that have a link."""
    choices = block_masks(limit, fixed or blocks_fixed(prints.count(), limit))
    masks = [m for m, _ in choices]
    first = written(components(_first(_cells(prints, masks), limit)), "stars")
    labelled = prints.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    second = _second(_cells(written(labelled, "labels"), masks), choices, limit)
    return components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second))


def _grouped(rows: DataFrame, links: Callable[[DataFrame], DataFrame], least: Column) -> tuple[DataFrame, int]:
    """(fp, n, component_id, group_size) of the fingerprints in ``rows(.., fp)`` with company, and the number of rows.

    ``links`` takes the distinct ``fp``, with the columns behind it, to (node, root).
    """
    wider = rows.columns[rows.columns.index("fp") + 1 :]
    prints = written(rows.groupBy("fp").agg(least.alias("least"), F.count(F.lit(1)).alias("n"), *(F.any_value(c).alias(c) for c in wider)), "distinct")
    linked = written(links(prints.select("fp", *wider)), "near")
    prints = prints.drop(*wider)
    member = written(prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "fp")), "members")
    whole = written(member.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("prints")), "whole")
    total = rows.count()
    found = join_groups(member, whole, ["root"], "prints", total, salt_of(F.col("fp")))
    return written(found.select("fp", "n", "root", "component_id", "group_size"), "found"), total


def near_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``docs``: id, fp (long), component_id, group_size.

    Fingerprints, of whole texts however long, link at ``limit`` or fewer differing
    bits; equal ones always do, so repeated rows are in one group.
    component_id is the smallest id reachable over links, the row's own included;
    null ids are passed over, and a group of null ids only has a null one. Texts
    without words have the fingerprint 0 and are linked like any other. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = written(fingerprints(docs, text_col, id_col, words), "prints")
    found, total = _grouped(rows, lambda prints: near_links(prints, limit), F.min("id"))
    out = join_groups(rows, found.select("fp", "n", "component_id", "group_size"), ["fp"], "n", total, salt_of(F.col("id")), "left")
    alone = F.col("group_size").isNull()
    return out.select(F.col("id").alias(id_col), "fp", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))


def drop_near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id, then the smallest text hash.

    Rows are told apart by two hashes of id and text, 128 bits together. Rows of a
    group that share id and text count as one row. A null id comes after all others.
    """
    return drop_groups(docs, lambda rows: _printed(rows, words), lambda prints: near_links(prints, limit), text_col, id_col)


def drop_groups(docs: DataFrame, printed: Callable[[DataFrame], DataFrame], links: Callable[..., DataFrame], text_col: str = "text", id_col: str = "doc_id", with_texts: bool = False) -> DataFrame:
    """``docs`` with the first row of each group that ``links`` makes of the fingerprints of ``printed``.

    ``links`` takes the distinct fingerprints, and ``with_texts`` also a function from some of them to (fp, text).
    """
    docs = docs.select(F.struct("*").alias("doc"))
    id_, text = F.col("doc").getField(id_col), F.coalesce(F.col("doc").getField(text_col), F.lit(""))
    hashed = docs.withColumns({"k1": F.xxhash64(id_, text), "k2": F.xxhash64(F.lit("other"), text, id_)})
    rows = written(printed(hashed.select(F.spark_partition_id().alias("part"), "k1", "k2", id_.alias("id"), text.alias("text"))), "prints")
    total = rows.count()

    def dealt(keys: DataFrame, company: DataFrame, apart: bool = True) -> tuple[DataFrame, DataFrame | None]:
        """(near, alone): rows that meet their written ``keys(k1, k2, ..)``, and those that need no shuffle since ``company(part, k1)`` lacks them.

        Without ``apart`` the latter are left out, and nothing is written.
        """
        if small_enough(keys, 32):
            return hashed.join(F.broadcast(keys), ["k1", "k2"], "left"), None
        # Only rows in company, or in a part that was cut another way, meet the keys in a shuffle.
        told_ = rows.groupBy("part", F.col("k1").alias("key")).agg(F.count_distinct("k2").alias("ways")).join(company.select("part", F.col("k1").alias("key"), F.lit(True).alias("in")).distinct(), ["part", "key"], "left")
        verdicts = told_.where("ways = 1").select("part", "key", F.coalesce("in", F.lit(False)).alias("verdict"))
        marked = told(hashed, F.col("k1"), verdicts, total, "company")
        if not apart:
            return marked.where("company is null or company").join(keys, ["k1", "k2"]), None
        marked = written(marked, "marked")
        return marked.where("company is null or company").join(keys, ["k1", "k2"], "left"), marked.where("not company")

    def texts(nodes: DataFrame) -> DataFrame:
        least = rows.join(nodes, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("k1", "k2", "part")).alias("k"))
        keys = written(least.select("k.k1", "k.k2", "k.part", "fp"), "asked")
        near, _ = dealt(keys.drop("part"), keys, apart=False)
        # Repeated rows share both keys.
        return near.where("fp is not null").select("fp", text.alias("text")).dropDuplicates(["fp"])

    found, _ = _grouped(rows, (lambda prints: links(prints, texts)) if with_texts else links, F.min("k1"))
    member = written(join_groups(rows, found.select("fp", "n", "root"), ["fp"], "n", total, salt_of(F.col("k1"))).select("root", "part", "k1", "k2", "id").distinct(), "company")
    stay = member.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("first")).select(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), F.lit(True).alias("stays"))
    keys = written(member.select("k1", "k2").distinct().join(stay, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("stays", F.lit(False)).alias("stays")), "keys")
    near, apart = dealt(keys, member)
    alone = near.where("stays is null").select("doc")
    if apart is not None:
        alone = apart.select("doc").union(alone)
    # Equal keys are the same id and text.
    return alone.union(near.where("stays").groupBy("k1", "k2").agg(F.first("doc").alias("doc")).select("doc")).select("doc.*")
