"""Mixing sources to target weights, in DataFrame functions only.

Sizes are summed for each source, each source gets a target and so a rate of
repetition, and every document is emitted floor(rate) times, plus once more if a
draw hashed from its id falls under the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.numbering import numbered
from loomtrace.llm.common import join_groups, salt_of, small_enough, written

#: No source, and so no document, is repeated beyond this.
CAP = 3
WEIGHTS = (5, 2, 1)
_WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that the key and the seed decide."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"/{seed}"))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def cycle_weights(sources: DataFrame, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` with a weight each: ``weights`` in turn by code point, null last."""
    ranked = numbered(sources, F.col(source_col).asc_nulls_last(), out="_rank")
    return ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))).drop("_rank")


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """``sources(.., weight, source_size)`` with a target each.

    All sizes are shared by weight. A target stops at ``cap`` times its source's
    size and the rest is shared anew, until none is above. Each round is one sum
    over the sources; rounds end when no further source stops.
    """
    table = written(sources.withColumn("limit", F.col("source_size") * F.lit(cap)), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = F.lit(0.0), -1
    while True:
        full = F.col("limit") < F.col("weight") * level
        got = table.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        if got[0] == stopped or not got[2]:
            break
        stopped, level = got[0], F.lit(float(total - got[1])) / F.lit(float(got[2]))
    share = F.col("weight") * level
    return table.withColumn("target", F.when(F.col("limit") < share, F.col("limit").cast("double")).otherwise(share)).drop("limit")


RESULTS = ("size", "source_size", "target", "copies")


def _planned(rows: DataFrame, cap: int, weights: tuple[int, ...], seed: int) -> DataFrame:
    """``rows(doc, id, source, size)`` with source_size, target and copies; ``doc`` holds whatever else."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    table = written(targets(cycle_weights(sources, "source", weights), cap), "targets")
    # A null source is one like any other, so the join goes by its presence and its text.
    key = [F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("named")]
    table = table.select(*key, "source_size", "target", "n")
    keyed = rows.select("doc", "id", "size", *key)
    if small_enough(table, 128):
        joined = keyed.join(F.broadcast(table), ["none", "named"])
    else:  # so many sources that the table is dealt out; hot ones go over salts
        joined = join_groups(keyed, written(table, "named"), ["none", "named"], "n", table.agg(F.sum("n")).first()[0], salt_of(F.col("id")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (draw(F.col("id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", copies)


def _packed(docs: DataFrame, text_col: str, source_col: str, id_col: str) -> DataFrame:
    return docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))


def plan_mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, seed: int = 9) -> DataFrame:
    """``docs`` with size, source_size, target and copies for each row.

    Size is the number of words of the whole text, 0 for a null or empty one. A
    null source is a source of its own. A source without words has the target 0
    and none of its documents is taken. The draw depends on the id and the seed
    alone (a null id counts as an empty one), so repeated ids share it, repeated
    rows count each, and reruns agree. Columns of ``docs`` named like the results
    are replaced, others kept; an empty table gives an empty result.
    """
    planned = _planned(_packed(docs, text_col, source_col, id_col), cap, weights, seed)
    return planned.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns if c not in RESULTS), *RESULTS)


def digest(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, seed: int = 9) -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, copies; see :func:`plan_mix`.

    Words are counted once: sizes are written and read again instead of the texts.
    """
    sizes = written(_packed(docs.select(id_col, source_col, text_col), text_col, source_col, id_col).select("id", "source", "size"), "sizes")
    planned = _planned(sizes.withColumn("doc", F.lit(None)), cap, weights, seed)
    return planned.select(F.col("id").alias(id_col), *RESULTS)


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, seed: int = 9) -> DataFrame:
    """The mix itself: rows of ``docs`` as they are, all columns, each as often as it is taken."""
    planned = _planned(_packed(docs, text_col, source_col, id_col), cap, weights, seed)
    return planned.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")
