"""Media columns: chroma fingerprints of audio, and search by alignment.

A recording (WAV, PCM of 16 bits) becomes frames of twelve pitch-class energies.
Sixteen box filters, read from an integral image of the frames, are quantised to
two bits each and packed into one integer for each frame. Two recordings align
at an offset to which enough integers vote that are equal but for one bit, if the
share of differing bits over the overlap is small; of several such offsets the one
with most votes counts.

Equal fingerprints form one class, so copies are searched once. Queries are a
stated set; they meet all classes in blocks of a fixed number of integers, so what
is sent to the executors at once does not grow with the data.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import join_groups, salt_of, written

#: Seconds of a frame and between frames; lowest and highest pitch in Hz.
FRAME, HOP = 0.256, 0.064
LOW, HIGH = 110.0, 3520.0
#: Frames that the widest filter covers.
SPAN = 16
#: An alignment has so many votes at its offset, overlap and share of differing bits.
VOTES, OVERLAP, ERRORS = 2, 16, 0.15
#: Integers of a block of queries, classes looked up at once, votes counted at once.
BLOCK, ROWS, HITS = 2_000_000, 100, 2_000_000
#: What turns an integer into itself and into those that differ in one bit.
FLIPS = np.concatenate([[0], 1 << np.arange(32, dtype=np.int64)]).astype(np.uint32).view(np.int32)
#: A query is a row whose id this divides.
EVERY = 100

#: The limits between the four levels, and the Gray code of each level.
LEVELS = (-0.25, 0.0, 0.25)
GRAY = (0, 1, 3, 2)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, lowest pitch class, height, width), widths and kinds in turn."""
    heights = [4 + 2 * (i % 3) for i in range(16)]
    return [(i % 4, 5 * i % (13 - h), h, (4, 8, 12, 16)[i // 4]) for i, h in enumerate(heights)]


@cache
def _pitches(size: int, rate: int) -> np.ndarray:
    """Weights that turn a power spectrum into pitch classes."""
    hertz = np.fft.rfftfreq(size, 1 / rate)
    used = (hertz >= LOW) & (hertz <= HIGH)
    out = np.zeros((len(hertz), 12), np.float32)
    out[np.flatnonzero(used), np.round(12 * np.log2(hertz[used] / LOW)).astype(int) % 12] = 1
    return out


def samples(audio: bytes | None) -> tuple[np.ndarray, int]:
    """Samples and rate; nothing if the bytes are no WAV file of 16-bit PCM."""
    try:
        with wave.open(io.BytesIO(audio or b"")) as f:
            if f.getsampwidth() != 2:
                return np.empty(0, np.float32), 1
            raw = np.frombuffer(f.readframes(f.getnframes()), "<i2").astype(np.float32)
            return raw[: len(raw) // f.getnchannels() * f.getnchannels()].reshape(-1, f.getnchannels()).mean(1), f.getframerate()
    except (wave.Error, EOFError):
        return np.empty(0, np.float32), 1


def chroma(signal: np.ndarray, rate: int) -> np.ndarray:
    """Frames of pitch-class shares; a silent frame is all zero."""
    size, hop = int(FRAME * rate), max(1, int(HOP * rate))
    if len(signal) < size or not size:
        return np.zeros((0, 12), np.float32)
    weights, window, parts = _pitches(size, rate), np.hanning(size).astype(np.float32), []
    frames = np.lib.stride_tricks.sliding_window_view(signal, size)[::hop]
    for at in range(0, len(frames), 256):  # long recordings in pieces
        parts.append((np.abs(np.fft.rfft(frames[at : at + 256] * window)) ** 2).astype(np.float32) @ weights)
    energy = np.concatenate(parts)
    total = energy.sum(1, keepdims=True)
    return np.where(total > size, energy / np.maximum(total, 1e-9), 0)


def codes(signal: np.ndarray, rate: int) -> np.ndarray:
    """The packed integers of a recording, one for each frame with a whole span behind it."""
    frames = chroma(signal, rate)
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.int32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)

    def box(a: int, z: int, low: int, high: int) -> np.ndarray:
        return image[z : z + n, high] - image[a : a + n, high] - image[z : z + n, low] + image[a : a + n, low]

    packed = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        all_ = box(0, w, y, y + h)
        if kind == 0:
            first = box(0, w, y, y + h // 2)
        elif kind == 1:
            first = box(0, w // 2, y, y + h)
        elif kind == 2:
            first = box(0, w // 2, y, y + h // 2) + box(w // 2, w, y + h // 2, y + h)
        else:
            first = 1.5 * box(w // 4, w - w // 4, y, y + h) - all_ / 4
        level = np.digitize(np.log((0.1 + np.maximum(first, 0)) / (0.1 + np.maximum(all_ - first, 0))), LEVELS)
        packed = packed << np.uint32(2) | np.array(GRAY, np.uint32)[level]
    return packed.view(np.int32)


def silence() -> int:
    """The integer of a silent span, which tells nothing and takes no vote."""
    return int(codes(np.zeros(8_000 * 4, np.float32), 8_000)[0])


def melody(vector: list[float], key: int, rate: int = 8_000, note: int = 1_024) -> bytes:
    """A recording that a vector decides: a note for each pair of values, behind a rest set by the key.

    Short vectors are played again until there are 64 values.
    """
    values = np.nan_to_num(np.asarray([0.0 if x is None else x for x in vector or [0.0]], np.float64))
    values = np.resize(values, max(64, len(values) + len(values) % 2)).reshape(-1, 2)
    spread = max(float(np.abs(values).max()), 1e-9)
    pitch = np.floor((values[:, 0] / spread + 1) * 11.99)
    hertz = 2 * LOW * 2 ** (pitch / 12)
    time = np.arange(note) / rate
    loud = (6_000 + 3_000 * np.abs(values[:, 1]) / spread)[:, None]
    tone = (loud * np.sin(2 * np.pi * hertz[:, None] * time)).ravel()
    signal = np.concatenate([np.zeros(key % 5 * int(HOP * rate)), tone]).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setparams((1, 2, rate, 0, "NONE", ""))
        f.writeframes(signal.tobytes())
    return out.getvalue()


_KEYED = "id long, codes array<int>"


def _coded(audio) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [codes(*samples(audio(x.as_py(), i))) for i, x in zip(ids, batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["id", "codes"])

    return run


def fingerprints(media: DataFrame, audio_col: str, id_col: str) -> DataFrame:
    """(id, codes) of each row; null, broken or short audio has no codes."""
    rows = media.select(F.col(id_col).cast("long").alias("id"), audio_col)
    return rows.mapInArrow(_coded(lambda audio, _: audio), _KEYED)


def vector_fingerprints(vectors: DataFrame, vector_col: str, id_col: str) -> DataFrame:
    """(id, codes) of the melody of each vector; audio is made and read one row at a time."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector_col)
    return rows.mapInArrow(_coded(lambda vector, i: melody(vector, i or 0)), _KEYED)


def _votes(hits: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key, over pieces of both."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for more, times in hits:
        keys, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, times]), len(keys)).astype(np.int64)
    return keys, counts


def _aligned(names: list[int], lists: list[np.ndarray], rest: int):
    """Matches of batches of classes against a block of queries: for each pair the offset with most votes that passes."""
    flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
    query = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in lists]) if lists else np.empty(0, np.int32)
    order = np.argsort(flat, kind="stable")
    order = order[flat[order] != rest]
    flat, query, place = flat[order], query[order], place[order]
    longest = max(map(len, lists), default=0)

    def pieces(row: np.ndarray, at: np.ndarray, first: np.ndarray, times: np.ndarray, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of (class, query, offset), and how often each is voted for, so many votes at a time."""
        upto, begin = np.cumsum(times), 0
        while begin < len(times):
            stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + HITS, "right")))
            n = times[begin:stop]
            hit = np.arange(n.sum()) + np.repeat(first[begin:stop] - (np.cumsum(n) - n), n)
            offset = np.repeat(at[begin:stop], n) - place[hit]
            keys = (np.repeat(row[begin:stop], n) * len(names) + query[hit]) * (2 * wide) + offset + wide
            yield np.unique(keys, return_counts=True)
            begin = stop

    def match(ids: list[int], rows: list[np.ndarray]) -> Iterator[tuple]:
        mine = np.concatenate(rows)
        if not len(flat) or not len(mine):
            return
        probes = (mine[:, None] ^ FLIPS).ravel()
        first = np.searchsorted(flat, probes)
        found = np.flatnonzero(flat[np.minimum(first, len(flat) - 1)] == probes)
        first = first[found]
        times = np.searchsorted(flat, probes[found], "right") - first
        row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])[found // len(FLIPS)]
        at = np.concatenate([np.arange(len(x)) for x in rows])[found // len(FLIPS)]
        wide = max(longest, *map(len, rows)) + 1
        # Classes one after the other, several at once while their votes are few.
        total = np.cumsum(np.bincount(row, times, len(rows)))
        begin = 0
        while begin < len(rows):
            stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + HITS, "right")))
            part = slice(*np.searchsorted(row, (begin, stop)))
            votes, counts = _votes(pieces(row[part], at[part], first[part], times[part], wide))
            begin = stop
            keep = counts >= VOTES
            votes, counts = votes[keep], counts[keep]
            pair, shift = votes // (2 * wide), votes % (2 * wide) - wide
            ranked, done = np.lexsort((shift, -counts, pair)), -1
            for p, s in zip(pair[ranked].tolist(), shift[ranked].tolist()):
                if p == done:
                    continue
                theirs, own = lists[p % len(names)], rows[p // len(names)]
                low, high = max(0, s), min(len(own), len(theirs) + s)
                if high - low < OVERLAP:
                    continue
                wrong = int(np.bitwise_count(own[low:high].view(np.uint32) ^ theirs[low - s : high - s].view(np.uint32)).sum())
                if wrong <= ERRORS * 32 * (high - low):
                    done = p
                    yield names[p % len(names)], ids[p // len(names)], s, high - low, wrong / (32 * (high - low))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        for batch in batches:
            for begin in range(0, len(batch), ROWS):
                part = batch.slice(begin, ROWS)
                rows = [np.asarray(x.values, np.int32) for x in part.column(1)]
                found = list(match(part.column(0).to_pylist(), rows))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["query", "class", "offset", "overlap", "error"])

    return run


def classes(prints: DataFrame) -> DataFrame:
    """(class, codes, size, asked) of each distinct fingerprint: smallest id, rows, and whether a query is among them."""
    asked = F.coalesce(F.col("id") % EVERY == 0, F.lit(False))
    return prints.groupBy("codes").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("size"), F.bool_or(asked).alias("asked"))


def align(distinct: DataFrame) -> DataFrame:
    """(query, class, offset, overlap, error) for each query class and class that align.

    ``distinct`` is a written table of :func:`classes`. Each block of queries is
    one pass over the classes; a class is not matched with itself.
    """
    spark, rest = distinct.sparkSession, silence()
    queries = distinct.where("asked and size(codes) > 0").select("class", "codes").orderBy("class")
    kind = "query long, class long, offset int, overlap int, error double"
    out, names, lists, size = [], [], [], 0

    def passed() -> None:
        out.append(written(distinct.where("size(codes) > 0").select("class", "codes").mapInArrow(_aligned(list(names), list(lists), rest), kind).where("query <> class"), "aligned"))
        names.clear(), lists.clear()

    for name, held in queries.toLocalIterator():  # one partition at a time, and one block held
        if lists and size + len(held) > BLOCK:
            passed()
            size = 0
        names.append(name)
        lists.append(np.array(held, np.int32))
        size += len(held)
    if lists or not out:
        passed()
    return reduce(DataFrame.union, out)


def search(prints: DataFrame, id_col: str) -> DataFrame:
    """One row for each of ``prints(id, codes)``: id, n_codes, codes_crc32, class_id, n_matches and the best match.

    class_id is the smallest id of equal fingerprints. n_matches counts the query
    classes that align with the row's class, itself left out; the best has the
    smallest share of differing bits, then the longest overlap, then the smallest
    id, and is null if there is none. Rows without codes share a class and match
    nothing; null ids are never queries. Repeated rows and ids have a row each,
    recordings of any length are read whole, other columns are ignored, and an
    empty table gives an empty result.
    """
    rows = written(prints.select("id", "codes", F.xxhash64("codes").alias("key")), "codes")
    distinct = written(classes(rows), "classes")
    matches = align(distinct)
    best = matches.groupBy("class").agg(F.count(F.lit(1)).alias("n_matches"), F.min(F.struct("error", (-F.col("overlap")).alias("o"), "query", "offset")).alias("b"))
    named = distinct.join(best, "class", "left").select("codes", F.xxhash64("codes").alias("key"), "class", "size", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), "b")
    joined = join_groups(rows, written(named, "named"), ["key", "codes"], "size", rows.count(), salt_of(F.col("id")))
    text = F.to_json(F.col("codes"))
    return joined.select(
        F.col("id").alias(id_col), F.size("codes").alias("n_codes"), F.crc32(text.cast("binary")).alias("codes_crc32"), F.col("class").alias("class_id"), "n_matches",
        F.col("b.query").alias("best_query"), F.col("b.offset").alias("best_offset"), F.col("b.error").alias("best_error"),
    )
