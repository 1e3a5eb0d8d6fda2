"""Phrase collocations from depth-truncated suffix subtrees that are built apart from each other.

Every word of a piece begins a suffix of three words. Their tree, cut at that depth, is
built in groups of first words (the prefixes), so packed that no group holds more
than ``BUDGET`` suffixes:

* words are counted first. A word under ``LEAST`` occurrences begins, ends or joins no
  candidate, so suffixes are cut there, which loses nothing;
* the others are packed into groups by their counts, in the order of their numbers. A
  word over the budget gets several groups of its own, and its suffixes are dealt by
  the words that follow it: a longer prefix;
* a task sends the distinct suffixes of what it has read, packed, with their
  counts. The task of a group sorts what it got: equal suffixes are leaves, their sums the
  counts of phrases of three words, and those under one node the counts of two. Counts
  of two words under a split word are added up by Spark afterwards.

Words are known by numbers within their language, looked up by part (``part_words``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.numbering import numbered
from loomtrace.llm.common import small_enough, text_or_empty, written
from loomtrace.llm.part_words import Lookup, count_words, dealt, laid

#: Occurrences of a candidate, and phrases reported for a language.
LEAST, TOP = 10, 2_000
#: Suffixes of a group at most, and suffixes that a task holds before it sends them on.
BUDGET, HELD = 2_000_000, 2_000_000
#: A candidate goes if a longer one holds it in so many of a hundred of its occurrences.
WITHIN = 50
#: Scores are whole shares of this.
SCALE = 1_000_000
#: Parts in which a language's best are found before they are ranked together.
SALTS = 64

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The characters that end a piece. They become a byte that no text in UTF-8 holds.
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\xff" * 10)
_END = b"\xff"


def words(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with a mark between pieces."""
    return text.translate(_LOWER).translate(_ENDS).replace(_END, b" \xff ").split()


def vocabulary(seen: DataFrame, least: int, budget: int) -> DataFrame:
    """(grp, word, c, number, base, slots) of words with ``least`` occurrences, from ``seen(grp, word, c)``.

    ``base`` is the group of the word's suffixes, or the first of ``slots`` of them.
    """
    found = numbered(seen.where(F.col("c") >= least), F.col("grp"), F.col("word"), out="number")
    # Ranges of numbers are packed apart, so no count passes through one task.
    range_ = F.shiftright("number", 16)
    half = max(1, budget // 2)
    heavy = F.col("c") > half
    # Groups are half a budget of running count; a word that passes the border adds no more than the other half.
    running = F.sum(F.when(heavy, 0).otherwise(F.col("c"))).over(Window.partitionBy(range_).orderBy("number"))
    packed = F.shiftleft(range_, 32) + F.floor(running / F.lit(half))
    slots = F.when(heavy, F.ceil(F.col("c") / F.lit(half))).otherwise(1)
    split = F.lit(1 << 62) + F.shiftleft("number", 24)
    return found.withColumns({"slots": slots.cast("int"), "base": F.when(heavy, split).otherwise(packed)}).select("grp", "word", "c", "number", "base", "slots")


def _leaves(first: np.ndarray, rest: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (first, rest) in order, with the sums of their counts, which are 1 if not given."""
    order = np.lexsort((rest, first))
    first, rest, n = first[order], rest[order], None if n is None else n[order]
    size = len(order)
    del order
    starts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])]))
    return first[starts], rest[starts], np.diff(starts, append=size) if n is None else np.add.reduceat(n, starts)


def suffixes(rows: DataFrame, lookup: Lookup, held: int = HELD) -> DataFrame:
    """(grp_id, whole, first, rest, n): packed suffixes of each group; ``rest`` (eight bytes, others four) holds the second word and the third, plus one, or 0."""
    names = ["grp_id", "whole", "first", "rest", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, spots, number, base, slots = None, {}, *(np.zeros(0, np.int64),) * 3
        # Texts as places of their words in the part's table: four bytes a word, the rest is looked up for distinct suffixes alone.
        fresh: list[np.ndarray] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            path = np.concatenate(fresh)
            fresh.clear()
            live = np.flatnonzero((path[:-2] >= 0) & (path[1:-1] >= 0)).astype(np.int32)
            if not len(live):
                return
            first, third = path[live], path[live + 2]
            second = number[path[live + 1]]
            del path, live
            second <<= 32
            going = np.flatnonzero(third >= 0)
            second[going] |= number[third[going]] + 1
            del third, going
            first, rest, n = _leaves(first, second)
            del second
            mixed = (rest.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            group = base[first] + (mixed % slots[first].astype(np.uint64)).astype(np.int64)
            del mixed
            order = np.argsort(group, kind="stable").astype(np.int32)
            group, first, rest, n = group[order], first[order], rest[order], n[order]
            del order
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            ends = np.append(starts[1:], len(group))
            for low in range(0, len(starts), 4_096):
                mine = slice(low, low + 4_096)
                bounds = list(zip(starts[mine].tolist(), ends[mine].tolist()))
                blobs = [[number[first[i:j]].astype(np.int32).tobytes() for i, j in bounds], [rest[i:j].tobytes() for i, j in bounds], [n[i:j].astype(np.int32).tobytes() for i, j in bounds]]
                yield pa.RecordBatch.from_arrays([pa.array(group[starts[mine]]), pa.array(slots[first[starts[mine]]] == 1), *(pa.array(x, pa.binary()) for x in blobs)], names)

        for batch in batches:
            for part, grp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                if part != at:
                    if fresh:
                        yield from sent()
                    size, at, spots = 0, part, {}
                    table = lookup(part)
                    if table is not None:
                        for i, (name, word) in enumerate(zip(table["grp"].to_pylist(), table["word"].to_pylist())):
                            spots.setdefault(name, {})[word] = i
                        number, base, slots = (table[c].to_numpy() for c in ("number", "base", "slots"))
                        table = None
                if grp not in spots:
                    continue
                here = spots[grp]
                mine = words(text.as_py())
                # Two ends behind each text, so no suffix runs into the next.
                found = np.full(len(mine) + 2, -1, np.int32)
                found[:-2] = np.fromiter((here.get(w, -1) for w in mine), np.int32, len(mine))
                fresh.append(found)
                size += len(found)
                if size > held:
                    yield from sent()
                    size = 0
        if fresh:
            yield from sent()

    return rows.select("part", "grp", "text").mapInArrow(run, "grp_id long, whole boolean, first binary, rest binary, n binary")


def subtrees(packed: DataFrame, least: int, total: int = 0) -> DataFrame:
    """(i, j, k, f): counts of two words (``k`` is -1) and of three, at least ``least``; counts of two under a split word in several rows.

    ``total`` is the number of suffixes at most.
    """

    def tree(blobs: list[tuple[pa.Buffer, pa.Buffer, pa.Buffer]], whole: bool) -> pa.RecordBatch:
        first, rest, n = (np.concatenate([np.frombuffer(b[c], kind) for b in blobs]) for c, kind in enumerate((np.int32, np.int64, np.int32)))
        blobs.clear()
        first, rest, n = _leaves(first, rest, n.astype(np.int64))
        starts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (rest[1:] >> 32 != rest[:-1] >> 32)]))
        node = np.add.reduceat(n, starts)
        keep = (node >= least) | (not whole)
        two, three = starts[keep], np.flatnonzero((n >= least) & (rest & 0xFFFFFFFF > 0))
        at = np.concatenate([two, three])
        k, f = np.concatenate([np.full(len(two), -1), (rest[three] & 0xFFFFFFFF) - 1]), np.concatenate([node[keep], n[three]])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (first[at], rest[at] >> 32, k, f)], ["i", "j", "k", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, whole, blobs = None, True, []
        for batch in batches:
            # Blobs are views of the batch, so a group is copied once, for its sort.
            groups, entire, packs = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [batch.column(c) for c in range(2, 5)]
            for row, group in enumerate(groups):
                if group != at and blobs:
                    yield tree(blobs, whole)
                    blobs = []
                at, whole = group, entire[row]
                blobs.append(tuple(x[row].as_buffer() for x in packs))
        if blobs:
            yield tree(blobs, whole)

    # An Arrow batch may hold all that a task gets, so a task gets a quarter of the budget on average.
    tasks = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * total // BUDGET)
    dealt_ = packed.repartition(tasks, "grp_id").sortWithinPartitions("grp_id")
    return dealt_.mapInArrow(run, "i long, j long, k long, f long")


def _hinted(rows: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(rows) if small_enough(rows, row_bytes) else rows


def _share(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)) in whole numbers of 38 digits."""
    return F.expr(f"cast(cast({a} as decimal(19,0)) * {a} * {SCALE} as decimal(38,0)) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


def candidates(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, budget: int = BUDGET, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, phrase, a, l, r, score, lost) of all candidates, and (lang, n).

    ``lost`` says that a longer candidate holds most of the occurrences.
    """
    rows = laid(docs, F.coalesce(F.col(lang_col), F.lit("und")).cast("string").alias("grp"), F.lit(True).alias("counted"), text_or_empty(text_col).alias("text"))
    parts = count_words(rows, words).where(F.col("word") != F.lit(_END))
    seen = written(parts.groupBy("grp", "word").agg(F.sum("n").alias("c")), "vocabulary")
    totals = written(seen.groupBy(F.col("grp").alias("lang")).agg(F.sum("c").alias("n")), "totals")
    known = written(vocabulary(seen, least, budget), "numbers")
    lookup = dealt(parts.select("part", "grp", "word").join(known.drop("c"), ["grp", "word"]).select("part", "grp", "word", "number", "base", "slots"))
    total = known.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    found = written(subtrees(suffixes(rows, lookup, held), least, total), "nodes")
    two = written(found.where("k < 0").groupBy("i", "j").agg(F.sum("f").alias("a")).where(F.col("a") >= least), "two")
    three = written(found.where("k >= 0").select("i", "j", "k", F.col("f").alias("a")), "three")
    names = known.select("number", "grp", F.col("word").cast("string").alias("w"), "c")
    named = lambda x, c: _hinted(names.select(F.col("number").alias(x), F.col("w").alias(f"w{x}"), F.col("c").alias(f"c{x}"), *([F.col("grp").alias("lang")] if c else [])), 96)
    # What two words lose to the longer phrases that begin, or end, with them.
    longer = three.select("i", "j", "a").union(three.select(F.col("j").alias("i"), F.col("k").alias("j"), "a")).groupBy("i", "j").agg(F.max("a").alias("longer"))
    pair = two.join(longer, ["i", "j"], "left").join(named("i", True), "i").join(named("j", False), "j")
    short = pair.select("lang", F.concat_ws(" ", "wi", "wj").alias("phrase"), "a", F.col("ci").alias("l"), F.col("cj").alias("r"), _share("a", "ci", "cj").alias("score"), F.coalesce(100 * F.col("longer") >= WITHIN * F.col("a"), F.lit(False)).alias("lost"))
    heads, tails = two.select("i", "j", F.col("a").alias("head")), two.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("a").alias("tail"))
    cut = three.join(heads, ["i", "j"]).join(tails, ["j", "k"]).join(named("i", True), "i").join(named("j", False), "j").join(named("k", False), "k")
    cut = cut.withColumns({"s1": _share("a", "ci", "tail"), "s2": _share("a", "head", "ck")})
    one = F.col("s1") <= F.col("s2")
    long = cut.select("lang", F.concat_ws(" ", "wi", "wj", "wk").alias("phrase"), "a", F.when(one, F.col("ci")).otherwise(F.col("head")).alias("l"), F.when(one, F.col("tail")).otherwise(F.col("ck")).alias("r"), F.least("s1", "s2").alias("score"), F.lit(False).alias("lost"))
    return short.union(long), totals


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, least: int = LEAST, budget: int = BUDGET, held: int = HELD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score, count and text.

    A null language is ``und``; null and empty texts have no words; repeated rows count
    each; ties end in the byte order of phrases, so results do not change. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    phrases, totals = candidates(docs, text_col, lang_col, least, budget, held)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    best = phrases.where(~F.col("lost")).drop("lost").withColumn("_k", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("_k") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.join(_hinted(totals, 64), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
