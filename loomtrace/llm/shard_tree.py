"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

Regions hold racks and racks hold shards. A key descends level by level: every
child draws -ln(u) / weight with u hashed from key and child, and the least
draw wins. A changed weight moves keys only into or out of that child, so
movement stays inside the subtrees whose weights change. New capacity joins as
a subtree of its own, which takes rows only into itself.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm.common import small_enough, written

#: (region, rack, shard, weight) of each leaf.
Leaf = tuple[int, int, int, float]
#: Rows that one task numbers at a time.
SLOT_ROWS = 50_000
_SUBS = 64


def layout(regions: int = 2, racks: int = 3, shards: int = 4, weight: float = 1.0) -> list[Leaf]:
    """An even tree; shards are numbered through."""
    return [(r, k, (r * racks + k) * shards + s, weight) for r in range(regions) for k in range(racks) for s in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """``tree`` with one more shard, in a rack and region of its own."""
    return [*tree, (max(x[0] for x in tree) + 1, 0, max(x[2] for x in tree) + 1, weight)]


def hash52(*cols: Column) -> Column:
    """The first 52 bits of an MD5 of the joined texts, as a long."""
    return F.conv(F.substring(F.md5(F.concat(*cols)), 1, 13), 16, 10).cast("long")


def _least(key: Column, children: Column, level: str) -> Column:
    """The child (id, weight) with the least weighted draw, ties to the smaller id."""

    def scored(child: Column) -> Column:
        u = (hash52(key, F.lit(f"/{level}/"), child["id"].cast("string")) + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["id"].alias("id"))

    return F.array_min(F.transform(children, scored))["id"]


def with_shard(df: DataFrame, key_col: str, tree: list[Leaf], out: str) -> DataFrame:
    """``df`` with the shard of a key (a string column): three rounds of draws.

    Each level is a column of its own, so a draw is not computed again by the next.
    """
    stride = 1 + max(x[1] for x in tree)
    top: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    leaves: dict[int, dict[int, float]] = {}
    for region, rack, shard, weight in tree:
        top[region] = top.get(region, 0.0) + weight
        under = racks.setdefault(region, {})
        under[rack] = under.get(rack, 0.0) + weight
        leaves.setdefault(region * stride + rack, {})[shard] = weight

    def listed(held: dict[int, float]) -> Column:
        return F.array(*(F.struct(F.lit(k).alias("id"), F.lit(float(w)).alias("weight")) for k, w in sorted(held.items()) if w > 0))

    def children(table: dict[int, dict[int, float]], of: str) -> Column:
        return F.element_at(F.create_map(*(x for k, held in sorted(table.items()) for x in (F.lit(k), listed(held)))), F.col(of))

    def below(of: str) -> Column:
        return F.concat(F.col(key_col), F.lit("/"), F.col(of).cast("string"))

    df = df.withColumn("_region", _least(F.col(key_col), listed(top), "region"))
    df = df.withColumn("_place", F.col("_region") * F.lit(stride) + _least(below("_region"), children(racks, "_region"), "rack"))
    return df.withColumn(out, _least(below("_place"), children(leaves, "_place"), "shard")).drop("_region", "_place")


def assign(docs: DataFrame, tree: list[Leaf] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: id, size, text_crc32, shard, slot, grown_shard.

    The id and the tree alone decide the shard (a null id counts as an empty
    key), so repeated ids share one. Size is the text's bytes plus 8; a null text
    has none, and the CRC of an empty text. Slots count from 0 in each shard
    without a gap, in the order of a hash of id and text, whole texts however long;
    repeated rows have slots one behind the other. grown_shard is the shard in the tree with one more.
    Other columns are ignored; an empty table gives an empty result.
    """
    tree = tree or layout()
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("_key"))
    rows = with_shard(with_shard(rows, "_key", tree, "shard"), "_key", grown(tree), "grown_shard")
    rows = rows.withColumn("_order", hash52(F.col("_key"), F.lit("/"), F.col("text_crc32").cast("string"))).drop("_key")
    # Repeated rows become one with a number, so no range of slots is made of them alone.
    rows = written(rows.groupBy(id_col, "size", "text_crc32", "shard", "grown_shard", "_order").agg(F.count(F.lit(1)).alias("_times")), "sharded")
    subs = max(_SUBS, ceil(rows.count() / len(tree) / SLOT_ROWS))
    rows = rows.withColumn("_sub", F.floor(F.col("_order") / F.lit(float(1 << 52)) * subs).cast("int"))
    counts = rows.groupBy("shard", "_sub").agg(F.sum("_times").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_sub")) - F.col("_n")
    starts = written(counts.select("shard", "_sub", before.alias("_before")), "starts")
    starts = F.broadcast(starts) if small_enough(starts, 24) else starts
    upto = Window.partitionBy("shard", "_sub").orderBy("_order", id_col, "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_within", F.sum("_times").over(upto) - F.col("_times")).join(starts, ["shard", "_sub"])
    first = F.col("_before") + F.col("_within")
    slots = F.explode(F.sequence(first, first + F.col("_times") - 1)).alias("slot")
    return rows.select(id_col, "size", "text_crc32", "shard", slots, "grown_shard")
