"""Near copies of documents: five-word shingles, a similarity of 0.8 or more, by wide SimHash.

One changed word changes five shingles, so texts with a Jaccard similarity of 0.8
differ in some 15 % of the bits of a SimHash over them: too many for a grid over
64 bits. Each text therefore has two fingerprints over sets of features:

* the finder, 128 bits over pairs of words, of which 10 % differ at that similarity,
  cut into 64 two-bit segments whose bit counts are the embedding. The counts of
  ``held`` segments chosen at random make a cell; ``held`` grows with the logarithm
  of the number of texts, so that unrelated ones seldom meet, and there are so many
  choices that two texts at the edge share a cell with a chance of 1 - ``MISS``. In a
  cell the Manhattan distance is tested, then the finder's bits;
* the judge, 1,024 bits over shingles of five words, spares most candidates the last test:
  it lets pass what is within two standard deviations of a similarity of 0.8.

What passes is verified: the sets of shingles of both texts are compared in a worker, and
a link is a similarity of 0.8 or more, never less. Each cell has a head, the least of its
texts. Each text is first compared with the least head that is near it, then with those
that still have another label, so a head has met its whole cell and a cell of two is done.
Last, those of a cell that are not its head meet all of other labels among them, however
full it is; two texts meet in one of their common cells only. Tables that are spent are
deleted at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, ceil, log, pi, prod, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.llm.common import discard, join_groups, new_folder, salt_of, written
from loomtrace.llm.components import components
from loomtrace.llm.simhash_grid import AGREE, drop_groups, embedding

#: Words of a shingle and the similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Words of the finder's features; 64-bit words of both fingerprints.
PAIR, FINDER, JUDGE = 2, 2, 16
#: Chance that two texts at the edge meet in no cell.
MISS = 0.04
#: Standard deviations over the mean of a similarity of 0.8 at which finder and judge still let a pair pass.
MARGINS = {FINDER: 3, JUDGE: 2}

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CHUNK = 1 << 13
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def features(hashes: np.ndarray, words: int) -> np.ndarray:
    """Distinct hashes of all runs of ``words`` words; of the whole sequence if it is shorter."""
    k = min(words, len(hashes))
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        out = _mixed(out * _ODD + hashes[i : len(hashes) - k + 1 + i])
    return np.unique(out)


def majority(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` words of 64 bits; a bit is 1 if it is set in over half the hashes."""
    seeds = _ODD * np.arange(1, width + 1, dtype=np.uint64)
    counts = np.zeros(64 * width, np.int64)
    for at in range(0, len(values), _CHUNK):
        wide = _mixed(values[at : at + _CHUNK, None] + seeds)
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > len(values), bitorder="little").view(np.int64)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; none if it has no words."""
    found = text.translate(_LOWER).split()
    return features(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)), WORDS) if found else np.zeros(0, np.uint64)


def prints_of(text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(node, finder, judge) of one whole text; all zero if it has no words. Texts of equal shingles have equal nodes."""
    found = text.translate(_LOWER).split()
    if not found:
        return 0, np.zeros(FINDER, np.int64), np.zeros(JUDGE, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    grams = features(hashes, WORDS)
    finder, judge = majority(features(hashes, PAIR), FINDER), majority(grams, JUDGE)
    return int(np.array(xxhash.xxh64_intdigest(grams.tobytes()), np.uint64).view(np.int64)), finder, judge


_PRINTS = [T.StructField(c, T.LongType()) for c in ("fp", "f0", "f1")] + [T.StructField("judge", T.ArrayType(T.LongType()))]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [prints_of(x.as_py()) for x in batch.column(batch.num_columns - 1).cast(pa.binary())]
        finder = np.array([f for _, f, _ in found], np.int64).reshape(-1, FINDER)
        judge = pa.array([j.tolist() for *_, j in found], pa.list_(pa.int64()))
        new = [pa.array([n for n, *_ in found], pa.int64()), pa.array(finder[:, 0]), pa.array(finder[:, 1]), judge]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "fp", "f0", "f1", "judge"])


def printed(rows: DataFrame) -> DataFrame:
    """``rows`` with their last column, a text, replaced by its fingerprints."""
    return rows.mapInArrow(_run, T.StructType([*rows.schema.fields[:-1], *_PRINTS]))


def differ(features_lost: int) -> float:
    """Share of bits that differ between texts at the edge, where a change of one word costs ``features_lost`` features."""
    changed = (1 - SIMILARITY) / (1 + SIMILARITY) / WORDS
    alike = (1 - features_lost * changed) / (1 + features_lost * changed)
    return acos(2 * alike / (1 + alike)) / pi


def edge_bits(features_lost: int, words: int) -> int:
    """Bits of ``words`` words in which texts at the edge differ, with the margin."""
    p, bits = differ(features_lost), 64 * words
    return int(bits * p + MARGINS[words] * sqrt(bits * p * (1 - p)))


def choices(n: int) -> list[tuple[int, int]]:
    """Masks over both words of the finder, one pair for each cell of a text among ``n``."""
    p, segments = differ(PAIR), 32 * FINDER
    apart = segments * (1 - ((1 - p) ** 2 + p * p / 2))
    held = min(segments // 2, max(8, ceil(log(4 * n + 1) / -log(AGREE))))
    meet = prod(1 - apart / (segments - i) for i in range(held))
    rng = np.random.default_rng(held)
    return [_masks(rng.choice(segments, held, replace=False)) for _ in range(ceil(log(MISS) / log(1 - meet)))]


def _masks(held) -> tuple[int, int]:
    words = [sum(3 << 2 * (int(s) % 32) for s in held if s // 32 == w) for w in range(FINDER)]
    return tuple(m - (1 << 64) if m >> 63 else m for m in words)


def _vector(name: str) -> Column:
    return embedding(F.col(name))


def _cells(prints: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """(fp, cell): a row for each cell of a text."""
    ends = prints.select("fp", _vector("f0").alias("e0"), _vector("f1").alias("e1"))
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("e0").bitwiseAND(F.lit(a)), F.col("e1").bitwiseAND(F.lit(b))) for k, (a, b) in enumerate(masks)))
    return ends.select("fp", F.explode(keys).alias("cell"))


def _first_cell(masks: list[tuple[int, int]]) -> Column:
    """Whether ``cell`` is the least of the cells that the finders (fa, ha) and (fb, hb) have in common."""
    choices_ = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(masks)))
    apart = [_vector(x).bitwiseXOR(_vector(y)) for x, y in (("fa", "fb"), ("ha", "hb"))]
    both = lambda m: (apart[0].bitwiseAND(m["a"]) == 0) & (apart[1].bitwiseAND(m["b"]) == 0)
    cell = lambda m: F.xxhash64(m["k"], _vector("fa").bitwiseAND(m["a"]), _vector("ha").bitwiseAND(m["b"]))
    return ~F.exists(choices_, lambda m: both(m) & (cell(m) < F.col("cell")))


def _near(a: list[Column], b: list[Column]) -> Column:
    """Whether two finders are near: the Manhattan distance of the counts first, a lower bound."""
    most = edge_bits(PAIR, FINDER)
    bound = sum((F.bit_count(embedding(x).bitwiseXOR(embedding(y))) for x, y in zip(a, b)), F.lit(0)) <= most
    return bound & (sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0)) <= most)


def _close(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(JUDGE)), F.lit(0)) <= edge_bits(WORDS, JUDGE)


def _judged(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (a, b, ..) of nodes whose judges are close."""
    judges = prints.select("fp", "judge")
    for end in ("a", "b"):
        pairs = pairs.join(judges.select(F.col("fp").alias(end), F.col("judge").alias(f"j{end}")), end)
    return pairs.where(_close(F.col("ja"), F.col("jb"))).drop("ja", "jb")


def _grams(rows: DataFrame) -> DataFrame:
    """(fp, grams) of ``rows(fp, text)``: the distinct hashes of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py()).view(np.int64) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["fp", "grams"])

    return rows.select("fp", "text").mapInArrow(run, "fp long, grams array<long>")


def _verified(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(ra, rb) of the pairs (a, b, ra, rb) of nodes whose shingles are alike, as a table; ``texts`` takes nodes (fp) to (fp, text)."""
    spark = pairs.sparkSession
    spent = [new_folder(spark, what) for what in ("candidates", "grams")]
    pairs = written(pairs.select("a", "b", "ra", "rb").distinct(), "candidates", spent[0])
    nodes = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    grams = written(_grams(texts(nodes)), "grams", spent[1])
    for end in ("a", "b"):
        pairs = pairs.join(grams.select(F.col("fp").alias(end), F.col("grams").alias(f"g{end}")), end)
    both = F.size(F.array_intersect("ga", "gb"))
    # In whole numbers, so that the edge itself counts.
    sure = 1_000 * both >= round(1_000 * SIMILARITY) * (F.size("ga") + F.size("gb") - both)
    sure_ = written(pairs.where(sure).select("ra", "rb").distinct(), "sure")
    for folder in spent:
        discard(spark, folder)
    return sure_


def _several(rows: DataFrame, prints: DataFrame, masks: list[tuple[int, int]], spent: dict[str, str]) -> DataFrame:
    """Pairs (a, b, ra, rb) of texts of different labels that share a cell of ``rows(cell, fp, root)`` and are close, each once.

    ``rows`` lack the head of a cell, which has met all others of it, so a pair whose least cell it heads is known.

    The judges are part of the join, so texts that share a passage and no more give no rows. ``spent`` has the folders of its tables.
    """
    taken = rows.groupBy("cell").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by("root", F.xxhash64("fp")).alias("taken"), F.count(F.lit(1)).alias("n")).where("r0 <> r1").select("cell", "taken", "n")
    taken, total = written(taken, "taken", spent["taken"]), rows.count()
    rows = written(join_groups(rows, taken, ["cell"], "n", total, salt_of(F.col("fp"))).join(prints, "fp"), "mixed", spent["mixed"])
    ends = lambda x: [F.col("fp").alias(x), F.col("root").alias(f"r{x}"), F.col("f0").alias(f"f{x}"), F.col("f1").alias(f"h{x}"), F.col("judge").alias(f"j{x}")]
    # Those of the label taken meet only the others.
    a = rows.where("root <> taken").select("cell", *ends("a"))
    b = rows.select(F.col("cell").alias("same"), *ends("b"), (F.col("root") == F.col("taken")).alias("base"))
    once = (F.col("ra") != F.col("rb")) & (F.col("base") | (F.col("a") < F.col("b")))
    near = _near([F.col("fa"), F.col("ha")], [F.col("fb"), F.col("hb")])
    # Which of two is the base may differ from cell to cell, so the order of a pair may too.
    met = a.join(b, (F.col("cell") == F.col("same")) & once & near & _close(F.col("ja"), F.col("jb")) & _first_cell(masks))
    return met.select("a", "b", "ra", "rb")


def _labelled(rows: DataFrame, node: str, label: str, stars: DataFrame) -> DataFrame:
    """``rows`` with the root of their ``node``, itself if it has no link yet."""
    return rows.join(stars.withColumnsRenamed({"node": node, "root": label}), node, "left").withColumn(label, F.coalesce(label, node))


def _joined(stars: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, root): the components of ``stars`` joined by links between labels, ``pairs(.., ra, rb)``."""
    return components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).union(pairs.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()))


def _company(prints: DataFrame, masks: list[tuple[int, int]], folder: str) -> DataFrame:
    """(cell, fp, head) of those in a cell that are not its head; ``cell`` is null where they are alone with it."""
    cell = Window.partitionBy("cell")
    # Narrow rows: a cell is one task, which sorts pairs of numbers and holds none.
    met = _cells(prints, masks).withColumns({"n": F.count(F.lit(1)).over(cell), "head": F.min("fp").over(cell)})
    return written(met.where("fp <> head").select(F.when(F.col("n") > 2, F.col("cell")).alias("cell"), "fp", "head"), "company", folder)


def links(prints: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root): components of the ``prints(fp, f0, f1, judge)`` that have a link; ``fp`` is distinct."""
    n = prints.count()
    masks = choices(n)
    spent = {what: new_folder(prints.sparkSession, what) for what in ("company", "heads", "labelled", "taken", "mixed")}
    company = _company(prints, masks, spent["company"])
    # The least head that is near links most of a group, so few pairs are left to judge.
    heads = company.select(F.col("fp").alias("a"), F.col("head").alias("b")).distinct()
    for end in ("a", "b"):
        heads = heads.join(prints.select(F.col("fp").alias(end), F.col("f0").alias(f"f{end}"), F.col("f1").alias(f"h{end}")), end)
    heads = written(heads.where(_near([F.col("fa"), F.col("ha")], [F.col("fb"), F.col("hb")])).select("a", "b"), "heads", spent["heads"])
    first = _judged(heads.groupBy("a").agg(F.min("b").alias("b")), prints).select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb"))
    stars = written(components(_verified(first, texts).toDF("a", "b")), "stars")
    left = _labelled(_labelled(heads, "a", "ra", stars), "b", "rb", stars).where("ra <> rb")
    stars = written(_joined(stars, _verified(_judged(left, prints), texts)), "stars")
    labelled = written(_labelled(company.where("cell is not null").select("cell", "fp"), "fp", "root", stars), "labelled", spent["labelled"])
    last = _verified(_several(labelled, prints, masks, spent), texts)
    for folder in spent.values():
        discard(prints.sparkSession, folder)
    return _joined(stars, last)


def drop_similar(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of similar texts: the smallest id, then the smallest text hash.

    Groups are closed over links; a link is a verified similarity of 0.8 or more.

    A-Z is lower-cased, words are split at ASCII white space, and whole texts are
    read, however long; repeated shingles count once. A text of fewer than five
    words is one shingle; texts without words, null and empty ones included, are one
    group. Repeated rows, null ids, extra columns and empty tables are treated as in
    :func:`loomtrace.llm.simhash_grid.drop_near_copies`.
    """
    return drop_groups(docs, printed, links, text_col, id_col, with_texts=True)
