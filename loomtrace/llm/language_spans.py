"""Language identification with spans for mixed texts.

Letters fall into scripts by fixed ranges; the script of a word's first letter
narrows the languages to those whose learned texts use it. A word is a letter with
the letters and combining marks behind it, so vowel signs stay within their word. Every word gets a score for each candidate
from its character n-grams, and a Viterbi pass over the words of a text, with a
penalty for each switch, labels spans. The language with most letters names the
text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from unicodedata import category

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.held_out import held_out, sample_by_class

#: Texts of each language that are learned from at most.
SAMPLE = 1_000
#: What a change of language between two words costs, in nats.
SWITCH = 12.0
#: Share of a language's letters from which it is said to use a script.
USES = 0.005
#: First and last code point of the letters of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
_OTHER = len(SCRIPTS)
_BITS = 16
_CHARS = 1 << 19
_CELLS = 8 << 20
_NEVER = np.float32(-1e6)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, a combining mark, its lower case, its script."""
    n = 0x110000
    letter = np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(n)), bool, n)
    lower = np.arange(n, dtype=np.uint32)
    for c in np.flatnonzero(letter[:0x1E944]).tolist():
        if len(low := chr(c).lower()) == 1:
            lower[c] = ord(low)
    script = np.full(n, _OTHER, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            script[first : last + 1] = k
    mark = np.zeros(n, bool)
    mark[:0x1E944] = [category(chr(c))[0] == "M" for c in range(0x1E944)]
    return letter, mark, lower, script


def _mix(value: np.ndarray) -> np.ndarray:
    value = value * np.uint64(0xD6E8FEB86659FD93)
    return ((value ^ (value >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - _BITS)).astype(np.int64)


@dataclass
class Words:
    """Words of some texts: runs of letters and their marks, as positions in the joined code points."""

    starts: np.ndarray
    lengths: np.ndarray
    scripts: np.ndarray
    #: Of each text: its first word, and its first code point.
    first: np.ndarray
    heads: np.ndarray
    #: Buckets of the n-grams, and of each word its first n-gram.
    grams: np.ndarray
    gram_at: np.ndarray


def words(texts: list[str]) -> Words:
    """n-grams are three letters (a word is bounded by 0) and, once, pairs of letters."""
    letter, mark, lower, script = _tables()
    joined = "\n" + "\n".join(texts) + "\n"
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    is_letter = letter[flat]
    if flat.max() >= 0x300 and (marks := mark[flat]).any():
        # A run of marks belongs to the letter before it; marks behind no letter are none.
        runs = np.flatnonzero(np.diff(marks.astype(np.int8), prepend=0) == 1)
        lengths = np.flatnonzero(np.diff(marks.astype(np.int8), append=0) == -1) + 1 - runs
        behind = np.repeat(is_letter[np.maximum(runs - 1, 0)], lengths)
        is_letter = is_letter.copy()
        is_letter[np.flatnonzero(marks)] = behind
    edge = np.diff(is_letter.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    value = np.where(is_letter, lower[flat], 0).astype(np.uint64)
    # The three code points around each letter, and the pair that ends in it.
    here = np.flatnonzero(is_letter)
    pair = (value[here - 1] << np.uint64(21)) | value[here]
    grams = np.empty(2 * len(here), np.int64)
    grams[0::2] = _mix((pair << np.uint64(21)) | value[here + 1])
    grams[1::2] = _mix(pair | np.uint64(1 << 63))
    lengths = ends - starts
    return Words(starts, lengths, script[flat[starts]], np.searchsorted(starts, heads), heads, grams, 2 * (np.cumsum(lengths) - lengths))


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each row of ``scores``; text d has rows first[d] to first[d + 1].

    All texts advance together, one word at a time, the longest ones last.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = first[:-1][order], sizes[order]
    most = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(most), side="left")
    labels = np.empty(len(scores), np.int16)
    came = np.empty(len(scores), np.int16)  # the best label before each word
    stays = np.empty(scores.shape, bool)
    total = np.zeros((len(sizes), scores.shape[1]), np.float32)
    for t in range(most):
        n = active[t]
        rows = begins[:n] + t
        now = total[:n]
        best = now.argmax(1)
        jump = now[np.arange(n), best] - np.float32(penalty)
        came[rows] = best
        stays[rows] = stay = now >= jump[:, None]
        total[:n] = np.where(stay, now, jump[:, None]) + scores[rows]
    state = total.argmax(1).astype(np.int16)
    for t in range(most - 1, -1, -1):
        n = active[t]
        rows = begins[:n] + t
        labels[rows] = state[:n]
        state[:n] = np.where(stays[rows, state[:n]], state[:n], came[rows])
    return labels


@dataclass
class Model:
    languages: list[str]
    #: Log likelihood of each bucket, a column for each language.
    table: np.ndarray
    #: Whether a language (column) uses a script (row).
    uses: np.ndarray

    def word_scores(self, found: Words) -> np.ndarray:
        out = np.empty((len(found.starts), len(self.languages)), np.float32)
        for k in range(out.shape[1]):
            out[:, k] = np.add.reduceat(self.table[:, k][found.grams], found.gram_at) if len(out) else 0
        # A script that no language uses narrows nothing.
        allowed = self.uses | ~self.uses.any(1, keepdims=True)
        return np.where(allowed[found.scripts], out, _NEVER)

    def label(self, texts: Iterable[str], penalty: float, spans: bool) -> list[tuple]:
        """Language, share of letters and spans (language, start, length) of each text.

        n-grams live for some texts at a time; word scores for as many texts as fit
        the cells, which then advance together.
        """
        out, scored, held, size, cells = [], [], [], 0, 0

        def score() -> int:
            found = words(held)
            scored.append((self.word_scores(found), np.diff(found.first), found.starts.astype(np.int32), found.lengths.astype(np.int32), found.heads[:-1]))
            held.clear()
            return scored[-1][0].size

        for text in texts:
            held.append(text)
            size += len(text)
            if size >= _CHARS:
                cells, size = cells + score(), 0
            if cells >= _CELLS:
                out += self._labelled(scored, penalty, spans)
                cells = 0
        if held:
            score()
        return out + self._labelled(scored, penalty, spans)

    def _labelled(self, scored: list, penalty: float, spans: bool) -> list[tuple]:
        if not scored:
            return []
        scores, sizes, starts, lengths, heads = (np.concatenate(x) for x in zip(*scored))
        scored.clear()
        first = np.concatenate([[0], sizes.cumsum()])
        labels = viterbi(scores, first, penalty)
        sums = np.stack([np.diff(np.concatenate([[0], np.cumsum(np.where(labels == k, lengths, 0), dtype=np.int64)])[first]) for k in range(len(self.languages))], 1)
        out = []
        for d, row in enumerate(sums):
            if not row.sum():
                out.append(("und", 0.0, []))
                continue
            best = int(row.argmax())
            mine = slice(first[d], first[d + 1])
            out.append((self.languages[best], float(row[best] / row.sum()), self._spans(labels[mine], starts[mine] - heads[d] - 1, lengths[mine]) if spans else []))
        return out

    def _spans(self, labels: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[dict]:
        begin = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1])
        last = np.concatenate([begin[1:], [len(labels)]]) - 1
        return [{"lang": self.languages[labels[b]], "start": int(starts[b]), "length": int(starts[e] + lengths[e] - starts[b])} for b, e in zip(begin, last)]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n-gram and script counts by language, summed over the batch."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            found = words([t or "" for t in texts])
            grams = np.bincount(found.grams, minlength=1 << _BITS)
            scripts = np.bincount(found.scripts, found.lengths, _OTHER + 1)
            counts = np.concatenate([grams, scripts]).astype(np.int64)
            where = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "slot": where, "n": counts[where]})


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of a fixed size from at most ``sample`` whole texts of each language.

    Held-out rows and rows without a language or an id are not learned from.
    """
    told = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = sample_by_class(told.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id")), "lang", "id", sample).select("id").distinct()
    # Bounded by the parameter, so it may be broadcast; so may the counts be gathered.
    texts = told.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    counts = texts.select("lang", "text").mapInPandas(_count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    slots = np.zeros(((1 << _BITS) + _OTHER + 1, max(1, len(languages))))
    slots[counts["slot"], [languages.index(x) for x in counts["lang"]]] = counts["n"]
    grams, scripts = slots[: 1 << _BITS], slots[1 << _BITS :]
    table = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * (1 << _BITS))).astype(np.float32)
    return Model(languages, table, scripts >= np.maximum(1, USES * scripts.sum(0)))


def with_language(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = SWITCH, spans: bool = True, out: str = "language") -> DataFrame:
    """``docs`` with a struct (lang, score, spans) for each text; a column of that name is replaced.

    lang is ``und`` and the score 0 if the text is null or has no letter, or if
    nothing was learned. The score is the share of the letters that the spans of
    the named language hold; of equal shares the language first by code point is
    named. A span runs from its first word to its last, in characters.
    """

    @F.arrow_udf("struct<lang:string,score:double,spans:array<struct<lang:string,start:int,length:int>>>")
    def label(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("length", pa.int32())])))])
        for batch in texts:
            texts = (t or "" for at in range(0, len(batch), 250) for t in batch.slice(at, 250).to_pylist())
            said = model.label(texts, penalty, spans) if model.languages else [("und", 0.0, [])] * len(batch)
            yield pa.array([{"lang": x, "score": s, "spans": p} for x, s, p in said], kind)

    return docs.withColumn(out, label(F.col(text_col)))


def identify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", penalty: float = SWITCH, sample: int = SAMPLE, spans: bool = True) -> DataFrame:
    """One row for each row of ``docs``: id, held_out, lang_pred, score and, if asked, spans.

    Texts are read whole, however long, and repeated rows labelled each. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    model = fit(docs, text_col, lang_col, id_col, sample)
    named = with_language(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model, penalty=penalty, spans=spans)
    found = named.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), *([F.col("language.spans").alias("spans")] if spans else []))
    return found
