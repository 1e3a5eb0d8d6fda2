"""Scores of texts under a class-based bigram model whose classes come from exchange clustering.

A token's probability is that of its class after the class before it, times that of
the word in its class. The classes:

* 0 is the end of a text, which also stands before its first word;
* 1 is the unseen word, one type for all. While classes are sought it holds the words
  that have no class yet;
* the others partition all words of the training texts, however rare. Frequent words, of at least
  one of ``SHARE`` training tokens, come first: the most frequent begin with a class each,
  the rest outside; then each word moves to the class that raises the likelihood of the
  training text most, by the exact change of the class bigram sums. A round moves
  one slice of the words at once, each judged against the classes before it. Then all other
  words move, by the same rule, from class 1 into the classes of the frequent ones, at once.

``SHARE`` says which words are moved more than once, not which have a class. Class
bigrams are then counted anew, over the classes of all words.

Transitions are smoothed by Witten and Bell's rule towards the class frequencies. A word met once
tells what unseen words stand beside, so its neighbours also count beside class 1. All
probabilities after a class add up to one.

Counts are of all training texts. Bigrams are counted between at most ``SHARE`` words and
the classes 0 and 1, so a frequent word's contexts fit one row; a round reads these rows and
shuffles only sums of class pairs. Contexts of other words are counts of classes, packed
and dealt by word; what was found goes back to the parts that asked (see ``part_words``), so
nothing that grows with the vocabulary is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.llm.common import text_or_empty, written
from loomtrace.llm.part_words import OUT, Lookup, count_words, dealt, laid

#: Texts whose CRC-32 of the id as text leaves this remainder are never learned from.
PARTS, HELD_OUT = 7, 2
#: A frequent word makes up one of so many tokens at least, and occurs twice; it moves in every sweep, others once.
SHARE = 1 << 15
#: Classes of frequent words; slices of them that move one after the other; how often all move.
CLASSES, SLICES, SWEEPS = 64, 4, 3
END, RARE, FIRST = 0, 1, 2
#: Bigrams that a task holds before it adds equal ones up.
HELD = 1_000_000
#: Words whose moves are judged together, and counts whose changes of phi are tabled.
_WORDS, _TABLED = 4_096, 16

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.translate(_LOWER).split()


def held_out(id_col: Column) -> Column:
    """A null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % PARTS == HELD_OUT


def _phi(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.where(x > 0, x, 1)), 0.0)


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their counts."""
    every, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[starts], np.add.reduceat(n, starts)


def bigrams(rows: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(a, b, n) of the training rows: numbers of frequent words, or classes 0 and 1, that follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, size = [], 0
        codes, counts = [], []

        def fold():
            nonlocal codes, counts
            new = np.concatenate(fresh)
            a, n = _merged([*codes, new], [*counts, np.ones(len(new), np.int64)])
            codes, counts = [a], [n]

        def send():
            (a,), (n,) = codes, counts
            return pa.RecordBatch.from_arrays([pa.array((a >> 32).astype(np.int32)), pa.array((a & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                mine = words(text.as_py())
                path = np.zeros(len(mine) + 2, np.int64)
                path[1:-1] = np.fromiter((numbers.get(w, RARE) for w in mine), np.int64, len(mine))
                fresh.append(path[:-1] << 32 | path[1:])
                size += len(path)
                if size > HELD:
                    fold()
                    fresh, size = [], 0
                    if len(codes[0]) > HELD:
                        yield send()
                        codes, counts = [], []
        if fresh:
            fold()
        if codes:
            yield send()

    found = rows.where("counted").select("text").mapInArrow(run, "a int, b int, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def contexts(pairs: DataFrame) -> DataFrame:
    """(word, near): what stands before (side 0) and after (1) each frequent word, with counts; ``SHARE`` + 2 entries a side at most."""
    before = pairs.where(F.col("b") >= FIRST).select(F.col("b").alias("word"), F.struct(F.lit(0).alias("side"), F.col("a").alias("other"), "n").alias("near"))
    after = pairs.where(F.col("a") >= FIRST).select(F.col("a").alias("word"), F.struct(F.lit(1).alias("side"), F.col("b").alias("other"), "n").alias("near"))
    return before.union(after).groupBy("word").agg(F.collect_list("near").alias("near"))


def _sides(batch: pa.RecordBatch, classes: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(word, counts of classes before, after, count after itself) of each row; the two leave itself out."""
    near = batch.column(1)
    entries = near.flatten()
    side, other, n = (entries.field(c).to_numpy() for c in ("side", "other", "n"))
    ends = near.offsets.to_numpy() - near.offsets[0].as_py()
    for row, word in enumerate(batch.column(0).to_pylist()):
        mine = slice(ends[row], ends[row + 1])
        s, o, c = side[mine], other[mine], n[mine]
        own = o == word
        keys = classes[o].astype(np.int64) + k * s
        both = np.bincount(keys[~own], c[~own], 2 * k)
        yield word, both[:k], both[k:], int(c[own & (s == 1)].sum())


def class_pairs(near: DataFrame, classes: np.ndarray, k: int, fixed: np.ndarray) -> np.ndarray:
    """How often each class follows each, from the contexts of frequent words and the pairs among classes 0 and 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k)
        for batch in batches:
            near = batch.column(1)
            entries = near.flatten()
            side, other, n = (entries.field(c).to_numpy() for c in ("side", "other", "n"))
            own = classes[np.repeat(batch.column(0).to_numpy(), np.diff(near.offsets.to_numpy()))].astype(np.int64)
            # A pair of two frequent words stands in two rows: the one before it counts.
            after, first = side == 1, (side == 0) & (other < FIRST)
            total += np.bincount(own[after] * k + classes[other[after]], n[after], k * k)
            total += np.bincount(other[first].astype(np.int64) * k + own[first], n[first], k * k)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(total[pair].astype(np.int64))], ["pair", "n"])

    out = np.zeros(k * k, np.int64)
    for r in near.mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out.reshape(k, k) + fixed


def best_class(before: np.ndarray, after: np.ndarray, itself: int, own: int, pairs: np.ndarray, held: np.ndarray) -> tuple[int, float]:
    """(class, gain): where a word raises the sum of phi(pair) - 2 phi(class) most, over staying.

    ``pairs`` counts with the word in ``own``, ``held`` is phi of it; the word is taken
    out first. Classes 0 and 1 take no words.
    """
    m, of_m = pairs.astype(np.float64), held.copy()
    m[own] -= after
    m[:, own] -= before
    m[own, own] -= itself
    of_m[own], of_m[:, own] = _phi(m[own]), _phi(m[:, own])
    size, count, at = pairs.sum(axis=1).astype(np.float64), after.sum() + itself, np.arange(len(m))
    size[own] -= count
    # Only classes that stand beside the word change anything.
    a, b = np.flatnonzero(after), np.flatnonzero(before)
    gain = (_phi(m[:, a] + after[a]) - of_m[:, a]).sum(axis=1) + (_phi(m[b] + before[b, None]) - of_m[b]).sum(axis=0)
    middle = m[at, at]
    gain += _phi(middle + before + after + itself) - _phi(middle + after) - _phi(middle + before) + _phi(middle)
    gain -= 2 * (_phi(size + count) - _phi(size))
    stay = gain[own]
    gain[:FIRST] = -np.inf
    best = int(gain.argmax())
    return (best, float(gain[best] - stay)) if own == RARE or gain[best] > stay else (own, 0.0)


def exchanged(near: DataFrame, n_words: int, fixed: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each number, pair counts of classes), after ``sweeps`` of exchange or when nothing moves.

    Words are numbered from ``FIRST`` by falling count. The two tables are bounded by
    ``SHARE`` and ``classes``, whatever the corpus.
    """
    k = FIRST + classes
    of = np.full(FIRST + n_words, RARE, np.int16)
    of[END] = END
    of[FIRST : FIRST + classes] = np.arange(FIRST, FIRST + min(classes, n_words))
    pairs = class_pairs(near, of, k, fixed)
    for _ in range(sweeps):
        moved = 0
        for part in range(SLICES):

            def run(batches: Iterator[pa.RecordBatch], of: np.ndarray = of.copy(), pairs: np.ndarray = pairs) -> Iterator[pa.RecordBatch]:
                held = _phi(pairs.astype(np.float64))
                for batch in batches:
                    found = [(word, best_class(before, after, itself, int(of[word]), pairs, held)[0]) for word, before, after, itself in _sides(batch, of, k)]
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.int32()), pa.array([c for _, c in found], pa.int32())], ["word", "class"])

            # No more rows than frequent words, SHARE at most.
            for r in near.where(F.pmod("word", F.lit(SLICES)) == part).mapInArrow(run, "word int, class int").collect():
                moved += of[r.word] != r["class"]
                of[r.word] = r["class"]
            pairs = class_pairs(near, of, k, fixed)
        if not moved:
            break
    return of, pairs


def _bits(k: int) -> int:
    """Bits of a packed entry that say which context it is; the rest is its count."""
    return (2 * k).bit_length()


class _Fresh(dict):
    """Numbers of words; a new word gets the next."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = FIRST + len(self)
        return n


def _path(found: list[np.ndarray]) -> np.ndarray:
    """Texts in one row: an end before the first and behind each."""
    return np.concatenate([[END], *(x for text in found for x in (text, [END]))]).astype(np.int64)


def class_contexts(rows: DataFrame, numbers: dict[bytes, int], of: np.ndarray, k: int, held: int = HELD) -> DataFrame:
    """(word, part, near): what stands beside each word that has no number, with a row at least for each part that it occurs in.

    ``near`` packs counts of contexts of training texts: the class before it, ``k`` and the class
    after it, or 2 ``k`` if it follows itself. Words of other texts alone have none.
    """
    first, bits = FIRST + len(numbers), _bits(k)
    most = (1 << 31 - bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, told = None, _Fresh(numbers), np.zeros(0, bool)
        fresh: list[np.ndarray] = []
        size = 0

        def batch_of(keys: list[bytes], offsets: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
            near = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(near)])
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([at] * len(keys), pa.int64()), near], ["word", "part", "near"])

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal told
            path = _path(fresh)
            kind = of[np.minimum(path, first)]
            spot = np.flatnonzero(path >= first)
            same_before, same_after = (path[spot] == path[spot + d] for d in (-1, 1))
            word = (path[spot] - first) << bits
            codes = [(word | kind[spot - 1])[~same_before], word | np.where(same_after, 2 * k, k + kind[spot + 1])]
            code = np.concatenate(codes)
            if not len(code):
                return
            code, n = _merged([code], [np.ones(len(code), np.int64)])
            if n.max() > most:
                times = -(-n // most)
                last = np.cumsum(times) - 1
                code, n, left = np.repeat(code, times), np.full(times.sum(), most), n - (times - 1) * most
                n[last] = left
            starts = np.flatnonzero(np.concatenate([[True], code[1:] >> bits != code[:-1] >> bits]))
            near = (code & (1 << bits) - 1 | n << bits).astype(np.int32)
            mine, keys = code[starts] >> bits, list(known)[first - FIRST :]
            told = np.concatenate([told, np.zeros(len(keys) - len(told), bool)])
            told[mine] = True
            ends = np.append(starts, len(code))
            for low in range(0, len(mine), OUT):
                part = ends[low : low + OUT + 1]
                yield batch_of([keys[i] for i in mine[low : low + OUT]], part - part[0], near[part[0] : part[-1]])

        def rest() -> Iterator[pa.RecordBatch]:
            keys = list(known)[first - FIRST :]
            keys = [w for w, done in zip(keys, [*told.tolist(), *[False] * (len(keys) - len(told))]) if not done]
            for low in range(0, len(keys), OUT):
                yield batch_of(mine := keys[low : low + OUT], np.zeros(len(mine) + 1, np.int64), np.zeros(0, np.int32))

        for batch in batches:
            for part, counted, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                if part != at:
                    if fresh:
                        yield from sent()
                    yield from rest()
                    at, known, told, fresh, size = part, _Fresh(numbers), np.zeros(0, bool), [], 0
                mine = words(text.as_py())
                found = np.fromiter(map(known.__getitem__, mine), np.int32, len(mine))
                if counted:
                    fresh.append(found)
                    size += len(found) + 1
                if size > held:
                    yield from sent()
                    fresh, size = [], 0
        if fresh:
            yield from sent()
        yield from rest()

    return rows.select("part", "counted", "text").mapInArrow(run, "word binary, part long, near binary")


def best_classes(word: np.ndarray, code: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """What :func:`best_class` gives for each word of class 1, from entries sorted by ``word`` (0 and up, none left out)."""
    k = len(pairs)
    m = pairs.astype(np.float64)
    beside = np.concatenate([m, m.T])
    held = _phi(beside)
    tabled = np.concatenate([_phi(beside + x) - held for x in range(1, _TABLED + 1)])
    size = m.sum(axis=1)
    of_size = _phi(size)
    starts = np.searchsorted(word, np.arange(word[-1] + 2)) if len(word) else np.zeros(1, np.int64)
    out = np.zeros(len(starts) - 1, np.int64)
    for low in range(0, len(out), _WORDS):
        mine = slice(starts[low], starts[min(low + _WORDS, len(out))])
        w, c, x = word[mine] - low, code[mine], n[mine].astype(np.float64)
        rows = min(_WORDS, len(out) - low)
        near = np.bincount(w * (2 * k + 1) + c, x, rows * (2 * k + 1)).reshape(rows, 2 * k + 1)
        w, c = np.nonzero(near)
        x = near[w, c]
        gain = np.zeros((rows, k))
        other = np.flatnonzero(c < 2 * k)
        for at in range(0, len(other), 1 << 15):
            e = other[at : at + (1 << 15)]
            change = tabled[(np.minimum(x[e], _TABLED).astype(np.int64) - 1) * 2 * k + c[e]]
            large = np.flatnonzero(x[e] > _TABLED)
            change[large] = _phi(beside[c[e[large]]] + x[e[large], None]) - held[c[e[large]]]
            first = np.flatnonzero(np.concatenate([[True], w[e][1:] != w[e][:-1]]))
            gain[w[e][first]] += np.add.reduceat(change, first, axis=0)
        # The word's own pairs with class 1 are taken out of it.
        before, after, itself = near[:, :k], near[:, k : 2 * k], near[:, 2 * k]
        for side, ahead, column in ((before, after[:, RARE], m[:, RARE]), (after, before[:, RARE], m[RARE])):
            r, at = np.nonzero((side > 0) & (ahead > 0)[:, None])
            a, less, v = ahead[r], side[r, at], column[at]
            gain[r, at] += _phi(v - less + a) - _phi(v - less) - _phi(v + a) + _phi(v)
        # Pairs of the class with itself.
        r, at = np.nonzero((before > 0) & (after > 0) | (itself > 0)[:, None])
        v, b, a = m[at, at], before[r, at], after[r, at]
        gain[r, at] += _phi(v + a + b + itself[r]) - _phi(v + a) - _phi(v + b) + _phi(v)
        counts, which = np.unique(after.sum(axis=1) + itself, return_inverse=True)
        gain -= (2 * (_phi(size + counts[:, None]) - of_size))[which]
        out[low : low + rows] = FIRST + gain[:, FIRST:].argmax(axis=1)
    return out


def placed(near: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(part, word, c, class) for each row of :func:`class_contexts`; words that no training text holds have class 1."""
    bits = _bits(k := len(pairs))

    def judged(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        (word,), (packed,) = rows["word"].chunks, rows["near"].chunks
        new = np.concatenate([[True], pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)])
        index = np.cumsum(new) - 1
        offsets = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, 4 * packed.offset) // 4
        entries = np.frombuffer(packed.buffers()[2], np.int32, offsets[-1])[offsets[0] :] if offsets[-1] > offsets[0] else np.zeros(0, np.int32)
        of_entry = np.repeat(index, np.diff(offsets))
        code, n = entries & (1 << bits) - 1, entries >> bits
        c = np.bincount(of_entry, np.where(code >= k, n, 0), index[-1] + 1).astype(np.int64)
        # Words without entries are left out of the judging.
        seen = np.flatnonzero(c)
        rank = np.zeros(len(c), np.int64)
        rank[seen] = np.arange(len(seen))
        kind = np.full(len(c), RARE, np.int64)
        kind[seen] = best_classes(rank[of_entry], code, n, pairs)
        return pa.RecordBatch.from_arrays([rows["part"].chunk(0), word, pa.array(c[index]), pa.array(kind[index].astype(np.int32))], ["part", "word", "c", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = pc.not_equal(rows["word"], rows["word"][-1]).to_numpy()
            # The last word may go on in the next batch.
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield judged(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield judged(held)

    n = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return near.repartition(n, "word").sortWithinPartitions("word").mapInArrow(run, "part long, word binary, c long, class int")


def counted_classes(rows: DataFrame, lookup: Lookup, kinds: dict[bytes, int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, once) of the training rows: how often each class follows each, and the same for words met once, as class 1, and their neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * k * k, np.int64)
        at, of = None, {}
        fresh: list[np.ndarray] = []
        size = 0

        def fold():
            path = _path(fresh)
            kind, once = path >> 1, np.flatnonzero(path & 1)
            codes = [kind[:-1] * k + kind[1:], k * k + kind[once - 1] * k + RARE, k * k + RARE * k + kind[once + 1]]
            return np.bincount(np.concatenate(codes), minlength=2 * k * k)

        for batch in batches:
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if part != at:
                    of, at = dict(kinds), part
                    if (table := lookup(part)) is not None:
                        of.update(zip(table["word"].to_pylist(), (2 * table["class"].to_numpy() + (table["c"].to_numpy() == 1)).tolist()))
                        table = None
                mine = words(text.as_py())
                fresh.append(np.fromiter(map(of.__getitem__, mine), np.int32, len(mine)))
                size += len(mine) + 1
                if size > HELD:
                    total += fold()
                    fresh, size = [], 0
        if fresh:
            total += fold()
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(total[pair])], ["pair", "n"])

    out = np.zeros(2 * k * k, np.int64)
    for r in rows.where("counted").select("part", "text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return tuple(out.reshape(2, k, k))


def transitions(pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of a class (column) after a class (row), smoothed by the number of classes that follow it."""
    one = (pairs.sum(axis=0) + 1) / (pairs.sum() + len(pairs))
    kinds = np.maximum((pairs > 0).sum(axis=1), 1)[:, None]
    return np.log10((pairs + kinds * one) / (pairs.sum(axis=1)[:, None] + kinds))


def score(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", classes: int = CLASSES) -> DataFrame:
    """One row for each row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows that are not :func:`held_out`. ``score`` is its log10
    probability of the whole text, ``base_score`` that of single tokens with one added
    count. Every training word has a class, however rare. Null and empty texts are the end token alone. Repeated rows are learned from
    and scored each. Without training rows all words are unseen: a base of 0, and
    a score by smoothing alone. Other columns are ignored, whatever their names.
    """
    rows = laid(docs, F.col(id_col).alias("id"), (~held_out(F.col(id_col))).alias("counted"), F.lit("").alias("grp"), text_or_empty(text_col).alias("text"))
    vocabulary = written(count_words(rows, words).groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    texts = rows.where("counted").count()
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count_if(F.col("c") > 0).alias("types")).first()
    n, v, k = total.tokens + texts, total.types + bool(texts), FIRST + classes
    # SHARE rows at most, so the driver may number them.
    frequent = [(bytes(r.word), r.c) for r in vocabulary.where((F.col("c") * SHARE >= n) & (F.col("c") > 1)).orderBy(F.desc("c"), "word").collect()]
    numbers = {w: FIRST + i for i, (w, _) in enumerate(frequent)}
    pairs = written(bigrams(rows, numbers), "bigrams")
    fixed = np.zeros((k, k), np.int64)
    for r in pairs.where((F.col("a") < FIRST) & (F.col("b") < FIRST)).collect():
        fixed[r.a, r.b] = r.n
    of, found = exchanged(written(contexts(pairs), "contexts"), len(frequent), fixed, classes)
    of = np.append(of, np.int16(RARE))
    lookup = dealt(placed(class_contexts(rows, numbers, of, k), found))
    counts, once = counted_classes(rows, lookup, {w: 2 * int(of[i]) for w, i in numbers.items()}, k)
    return _scored(rows, lookup, id_col, n, v, texts, frequent, of, counts, once)


def _scored(rows: DataFrame, lookup: Lookup, id_col: str, n: int, v: int, texts: int, frequent: list[tuple[bytes, int]], of: np.ndarray, pairs: np.ndarray, once: np.ndarray) -> DataFrame:
    """The rows scored; ``lookup`` knows all words but the ``frequent``, whose classes are in ``of``."""
    after, size = transitions(pairs + once), np.maximum(pairs.sum(axis=0), 1)
    end = float(np.log10((texts + 1) / (n + v + 1)))
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [rows.schema["id"].dataType, T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, numbers = None, {}
        for batch in batches:
            out = []
            for part, text in zip(batch.column(0).to_pylist(), batch.column(3).cast(pa.binary())):
                if part != at:
                    numbers, at = {w: i for i, (w, _) in enumerate(frequent)}, part
                    c, kind = np.array([c for _, c in frequent], np.int64), of[FIRST:-1]
                    if (table := lookup(part)) is not None:
                        numbers.update(zip(table["word"].to_pylist(), range(len(c), len(c) + table.num_rows)))
                        c, kind = np.append(c, table["c"].to_numpy()), np.append(kind, table["class"].to_numpy())
                        table = None
                    base = np.log10((c + 1) / (n + v + 1))
                    # All unseen words are the one type of class 1.
                    within = np.where(kind == RARE, 0.0, np.log10(np.maximum(c, 1) / size[kind]))
                mine = words(text.as_py())
                found = np.fromiter(map(numbers.__getitem__, mine), np.int64, len(mine))
                path = np.zeros(len(mine) + 2, np.int64)
                path[1:-1] = kind[found]
                likely = after[path[:-1], path[1:]].sum() + within[found].sum()
                out.append((len(mine) + 1, int((c[found] > 0).sum()) + bool(texts), float(base[found].sum()) + end, float(likely)))
            tokens, known, first, second = zip(*out) if out else ([],) * 4
            held = pa.array([not x for x in batch.column(2).to_pylist()], pa.bool_())
            columns = [batch.column(1), held, pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array([n] * len(out), pa.int64()), pa.array(first, pa.float64()), pa.array(second, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("part", "id", "counted", "text").mapInArrow(run, T.StructType([T.StructField(c, t) for c, t in zip(names, kinds)]))


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, perplexity, base_perplexity): ten to the mean loss of a token, of both models."""
    ten = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(ten("score").alias("perplexity"), ten("base_score").alias("base_perplexity"))
