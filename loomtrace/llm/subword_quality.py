"""A quality classifier on supervised subword embeddings.

Words and character n-grams (three and four characters) of whole texts are hashed to buckets with a learned
vector each. A document is the mean of its word vectors plus the mean of its
n-gram vectors, and a softmax over two classes follows. The model is trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows and is
of a fixed size; scoring reads every text as a whole, in Arrow batches.

Since the softmax is linear in the document vector, scoring keeps one number for
each bucket: its vector times the difference of the two class weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.llm.common import written
from loomtrace.llm.held_out import held_out, sample_by_class

#: Labelled rows of each class that are learned from at most, and what they may hold:
#: (bucket, share) cells of all rows of a class. A row is left out of the sample where it would pass that.
SAMPLE = 1_500
CELLS = 8_000_000
#: Score from which a document counts as good.
THRESHOLD = 0.7
_BITS = 17
_SIZES = (3, 4)
_CHUNK = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Word pairs count only by whether both words are the same, at a distance of one and of up to eight:
#: a learned vector each, in buckets of their own. Text that says one thing again and again has no
#: telling words or n-grams, so without these its share of right predictions falls (README).
_SAME, _AGAIN, _BACK = 0, 1, 8


def _words(flat: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word in ``flat`` and a 64-bit hash of it."""
    edge = np.diff(space.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    lengths = ends - starts
    inside = ~space
    place = np.arange(len(flat))[inside] - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _PRIME, np.uint64))
    first = np.cumsum(lengths) - lengths
    return starts, np.add.reduceat((flat[inside].astype(np.uint64) + np.uint64(1)) * powers[place], first)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    mixed = hashes * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - _BITS)).astype(np.int64)


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words and for each size of n-gram: the buckets found, and where each text's begin.

    Texts are joined with a space before each and one behind the last. An n-gram
    may begin or end with a space but has none inside.
    """
    joined = " " + " ".join(texts) + " "
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    space = (flat == 32) | (flat - np.uint32(9) < 5)
    starts, hashes = _words(flat, space)
    at = np.searchsorted(starts, heads)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    buckets, owners, seen = [np.maximum(_bucket(hashes), 2)], [owner], np.zeros(len(hashes), bool)
    for back in range(1, _BACK + 1):
        same = np.zeros(len(hashes), bool)
        same[back:] = (hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back])
        seen |= same
        if back == 1:
            buckets.append(np.full(int(same.sum()), _SAME))
            owners.append(owner[same])
    buckets.append(np.full(int(seen.sum()), _AGAIN))
    owners.append(owner[seen])
    # Words in text order, then the marks of repetition: sums need the order by owner only.
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    out = [(np.concatenate(buckets)[order], np.searchsorted(owner[order], np.arange(len(texts) + 1)))]
    wide = np.where(space, np.uint32(32), flat).astype(np.uint64)
    for n in _SIZES:
        count = max(0, len(flat) - n + 1)
        value = np.full(count, n, np.uint64)
        whole = np.ones(count, bool)
        for k in range(n):
            value = value * _PRIME + wide[k : k + count]
            if 0 < k < n - 1:
                whole &= ~space[k : k + count]
        where = np.flatnonzero(whole)
        # The space before the next text ends a text's last n-gram, so none reaches into another text.
        out.append((_bucket(value[where]), np.searchsorted(where, heads)))
    return out


def _groups(found: list) -> list[list]:
    """Word features, and n-gram features of all sizes."""
    return [found[:1], found[1:]]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of class 1 for each text; a text without words gets that of the bias."""
        total = np.full(len(texts), self.bias)
        for group in _groups(features(texts)):
            sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
            for buckets, at in group:
                running = np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])
                sums += running[at[1:]] - running[at[:-1]]
                counts += np.diff(at)
            total += sums / np.maximum(counts, 1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int, float]], dims: int = 8, epochs: int = 8, rate: float = 6.0, seed: int = 6) -> Model:
    """``rows``: buckets, their shares of the document vector, label, weight of the row."""
    if not rows:
        return Model(np.zeros(1 << _BITS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-0.1, 0.1, (1 << _BITS, dims)).astype(np.float32)
    classes, bias = np.zeros((dims, 2), np.float32), np.zeros(2, np.float32)
    classes[:] = rng.uniform(-0.1, 0.1, classes.shape)
    steps, done = epochs * -(-len(rows) // 32), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), -(-len(rows) // 32)):
            step = rate * (1 - done / steps)
            done += 1
            chosen = [rows[i] for i in part]
            sizes = np.array([len(r[0]) for r in chosen])
            buckets, shares = np.concatenate([r[0] for r in chosen]), np.concatenate([r[1] for r in chosen])
            owner = np.repeat(np.arange(len(part)), sizes)
            hidden = np.zeros((len(part), dims), np.float32)
            vectors = table[buckets] * shares[:, None]
            full = np.flatnonzero(sizes)
            if len(full):
                hidden[full] = np.add.reduceat(vectors, (np.cumsum(sizes) - sizes)[full])
            logits = hidden @ classes + bias
            chances = np.exp(logits - logits.max(1, keepdims=True))
            chances /= chances.sum(1, keepdims=True)
            wrong = chances
            wrong[np.arange(len(part)), [r[2] for r in chosen]] -= 1
            wrong *= np.array([r[3] for r in chosen], np.float32)[:, None] / len(part)
            back = wrong @ classes.T
            classes -= 0.1 * step * hidden.T @ wrong
            bias -= 0.1 * step * wrong.sum(0)
            change = shares[:, None] * back[owner]
            for d in range(dims):
                table[:, d] -= step * len(part) * np.bincount(buckets, change[:, d], 1 << _BITS).astype(np.float32) / 4
    return Model((table @ (classes[:, 1] - classes[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and the share of each in the document vector."""
    share = np.zeros(1 << _BITS, np.float32)
    for group in _groups(features([text])):
        held = np.concatenate([x for x, _ in group])
        share += np.bincount(held, minlength=1 << _BITS).astype(np.float32) / max(1, len(held))
    where = np.flatnonzero(share)
    return where.astype(np.int32), share[where]


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, text in enumerate(batch.column("text")):
            buckets, share = shares(text.as_py() or "")
            lists = [pa.array([buckets], pa.list_(pa.int32())), pa.array([share], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in ("id", "label", "total")), *lists], ["id", "label", "total", "buckets", "shares"])


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model learned from at most ``sample`` labelled rows of each class.

    Held-out rows, null ids and labels other than 0 and 1 are not learned from;
    of several labels of one id the greatest counts, of several texts one chosen by
    a hash. ``CELLS`` bounds what long texts may bring to the driver.
    """
    told = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = sample_by_class(told.where(~held_out(F.col("id"))), "label", "id", sample)
    # The sample is bounded by its parameter, so it may be broadcast.
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    # Of rows that share an id one is learned from, whatever their number.
    texts = texts.groupBy("id", "label", "total").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kind = T.StructType([*(texts.schema[c] for c in ("id", "label", "total")), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("shares", T.ArrayType(T.FloatType()))])
    rows = written(texts.mapInArrow(_sparse, kind), "sample")
    upto = F.sum(F.size("buckets")).over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    fits = rows.select("id", "label", upto.alias("upto")).where(F.col("upto") <= CELLS)
    rows = rows.join(F.broadcast(fits.select("id")), "id", "left_semi").orderBy(F.xxhash64("id"), "id").toArrow()
    totals = dict(zip(rows["label"].to_pylist(), rows["total"].to_pylist()))
    label = rows["label"].to_numpy()
    counts = {k: int((label == k).sum()) for k in totals}
    # Rows weigh so that the classes stand as in all labels, not as in the sample.
    weight = {k: totals[k] / sum(totals.values()) * len(label) / counts[k] for k in totals}
    return train([(np.asarray(b.values), np.asarray(s.values), int(k), float(weight[k])) for b, s, k in zip(rows["buckets"], rows["shares"], label)])


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of class 1; a column of that name is replaced.

    Null and empty texts are scored like texts without any feature.
    """

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            held, size, scores = [], 0, []
            for x in batch:
                held.append(x.as_py() or "")
                size += len(held[-1])
                if size > _CHUNK:
                    scores.append(model.scores(held))
                    held, size = [], 0
            if held:
                scores.append(model.scores(held))
            yield pa.array(np.concatenate(scores) if scores else [], pa.float64())

    return docs.withColumn(out, score(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``docs``: id, held_out, score, predicted.

    predicted is 1 from ``threshold`` on. Without any label every score is 0.5.
    Texts are read whole, however long; null and empty ones are scored like texts
    without any feature; repeated rows are scored each. Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    model = fit(docs, labels, text_col, id_col, label_col, sample)
    scored = with_scores(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that score under ``threshold``, all columns kept as they are; see :func:`classify`."""
    model = fit(docs, labels, text_col, id_col, label_col, sample)
    packed = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"))
    return with_scores(packed, model).where(F.col("score") >= threshold).select("doc.*")
