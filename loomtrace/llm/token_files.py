"""Token ids in Arrow files of fixed-size lists.

Documents are put in order of their ids, encoded whole, closed with an end id and
laid end to end in sequences of one length. A file is an Arrow IPC file of record
batches with fixed-size lists: ids, a mask of real tokens and a mask of document
ends. Sequence k lies at a known place, so a memory map gives it without a copy.
Only the last sequence of a file is padded. Beside each file lies an index, an
Arrow file too, with the id, the start and the length of each document.

Every file is written under a name of its own and then moved to its final one, so
a task that runs twice leaves the same file. Files go to a folder that all
executors share.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import shared_dir

SEQUENCE = 2_048
#: Sequences of a record batch, documents of a file (about), words that a worker remembers.
BATCH = 64
FILE_DOCS = 100_000
#: Workers outlive their tasks, so what they remember counts against every later task.
_REMEMBER = 900_000
#: Length up to which words are kept when the rest is forgotten: short ones come again.
_KEPT = 9
#: Bytes of text that are encoded at once.
_BYTES = 4 << 20
#: Fixed value: the pattern by which tokenizers of this kind part letters, digits and marks.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A word of Latin letters with marks behind it: the pattern above gives the letters and the marks.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|#%*$&]*)").fullmatch


def by_words(tokenizer) -> bool:
    """Whether a tokenizer folds case, drops white space and parts words as :data:`_PARTS` says.

    Then the ids of a text are those of its words, and a word of plain letters has
    the ids that the model alone gives to its lower-case letters.
    """
    spec = json.loads(tokenizer.to_str())
    normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    cut = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        normal == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in cut] == ["Split", "ByteLevel"]
        and cut[0]["pattern"] == {"Regex": _PARTS} and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
        and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
        and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]
        and not any(c.isspace() or c.isalpha() for x in spec["added_tokens"] for c in (x["content"][0], x["content"][-1]))
    )


class WordEncoder:
    """Encodes texts; with a tokenizer of the kind :func:`by_words` each distinct word once.

    Any other tokenizer gets every text whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.by_words = by_words(self.tokenizer)
        self.known: dict[str, bytes] = {}
        if self.by_words:
            signs = [chr(c) for c in range(33, 256) if _PLAIN(chr(c)) or _PLAIN("a" + chr(c))]
            part = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.signs = {ord(c): part(c)[0][0] for c in signs}

    def _plain(self, text: str) -> bytes:
        """Ids of lower-case Latin letters, or of a run of marks, by the model alone."""
        if (found := self.known.get(text)) is None:
            ids = [t.id for t in self.tokenizer.model.tokenize(text.translate(self.signs) if not text.isascii() else text)]
            found = self.known[text] = np.array(ids, self.dtype).tobytes()
        return found

    def learn(self, words: list[str]) -> None:
        """Encodes new words; those of other signs go to the tokenizer many at a time, and offsets part them again."""
        known, plain, odd = self.known, self._plain, []
        for word in words:
            if found := _PLAIN(word):
                letters, marks = found.groups()
                ids = plain(letters.lower())
                known[word] = ids + plain(marks) if marks else ids
            else:
                odd.append(word)
        for at in range(0, len(odd), 2_000):
            part = odd[at : at + 2_000]
            encoded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            raw, size = np.array(encoded.ids, self.dtype).tobytes(), np.dtype(self.dtype).itemsize
            ends = np.cumsum([len(w) + 1 for w in part])
            cuts = [0, *np.searchsorted([x[0] for x in encoded.offsets], ends).tolist()]
            known |= {w: raw[a * size : z * size] for w, a, z in zip(part, cuts, cuts[1:])}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``texts`` (strings without nulls) laid end to end, and how many each text has."""
        if not self.by_words:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], self.dtype), np.array([len(ids) for ids in found], np.int64)
        if len(self.known) > _REMEMBER:
            self.known = {k: v for k, v in self.known.items() if len(k) <= _KEPT}
            if len(self.known) > _REMEMBER // 2:
                self.known = {}
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words, where = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = self.known
        if new := [w for w in words if w not in known]:
            self.learn(new)
        found = [known[w] for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.dtype).itemsize
        begins, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), self.dtype)
        sizes = sizes[where]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(begins[where] - (ends - sizes), sizes) + np.arange(sizes.sum())]
        return ids, np.diff(np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()])


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _save(folder: str, name: str, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> None:
    files, base = place(folder)
    files.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out, pa.ipc.new_file(out, schema) as writer:
        for batch in batches:
            writer.write_batch(batch)
    files.move(draft, f"{base}/{name}")


def _mask(flags: np.ndarray, length: int) -> pa.Array:
    bits = pa.array(flags.reshape(-1))
    return pa.FixedSizeListArray.from_arrays(bits, length)


class SequenceFile:
    """Writes ids as they come; keeps less than one record batch."""

    def __init__(self, folder: str, name: str, dtype, length: int):
        self.files, self.base = place(folder)
        self.files.create_dir(self.base, recursive=True)
        self.name, self.length, self.dtype = name, length, np.dtype(dtype)
        self.draft = f"{self.base}/.{name}.{uuid.uuid4().hex}"
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("real", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length))])
        self.out = self.files.open_output_stream(self.draft)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.held, self.ends, self.size = [], [], 0

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents laid end to end; ``ends`` are the places of their last ids."""
        self.held.append(ids)
        self.ends.append(ends + self.size)
        self.size += len(ids)
        if self.size >= BATCH * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        step = BATCH * self.length
        whole = len(ids) if last else len(ids) // step * step
        ends = np.concatenate(self.ends) if self.ends else np.empty(0, np.int64)
        for at in range(0, whole, step):
            part = ids[at : min(at + step, whole)]
            rows = -(-len(part) // self.length)
            full = np.zeros(rows * self.length, self.dtype)
            full[: len(part)] = part
            real = np.arange(len(full)) < len(part)
            mark = np.zeros(len(full), bool)
            mark[ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + len(part))] - at] = True
            values = pa.FixedSizeListArray.from_arrays(pa.array(full), self.length)
            self.writer.write_batch(pa.RecordBatch.from_arrays([values, _mask(real, self.length), _mask(mark, self.length)], schema=self.schema))
        self.held, self.size = [ids[whole:]], len(ids) - whole
        self.ends = [ends[ends >= whole] - whole]

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.out.close()
        self.files.move(self.draft, f"{self.base}/{self.name}")


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``_BYTES``, one text at least."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _BYTES, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def _write(folder: str, path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), encoder(path)
        name = f"part-{part:06d}"
        tokens, docs, start, index = None, 0, 0, []
        for batch in batches:
            sizes = [np.empty(0, np.int64)]
            for texts in _pieces(batch.column("text")):
                tokens = tokens or SequenceFile(folder, f"{name}.arrow", enc.dtype, length)
                ids, counts = enc.encode(texts)
                stops = np.cumsum(counts)
                tokens.add(np.insert(ids, stops, end_id), stops + np.arange(len(stops)))
                sizes.append(counts + 1)
            sizes = np.concatenate(sizes)
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            index.append(pa.RecordBatch.from_arrays([batch.column("id"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=_INDEX))
            docs += len(sizes)
        if tokens:
            tokens.close()
            _save(folder, f"{name}.index.arrow", _INDEX, iter(index))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([start], pa.int64())], ["part", "name", "docs", "tokens"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id", length: int = SEQUENCE) -> DataFrame:
    """Writes the files and returns one row for each: folder, part, name, docs, tokens, start.

    Documents stand in ascending order of their ids, null ids first, equal ids in
    the order of a hash of their texts; start counts the ids of all files before. A null or
    empty text has the end id alone. A text may be longer than any sequence or
    batch: it runs on in the next. Repeated rows are written each. An empty table
    writes no file. Other columns of ``docs`` are not written, whatever their names.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(rows.count() / FILE_DOCS))
    ordered = rows.repartitionByRange(parts, F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    made = ordered.mapInArrow(_write(folder, tokenizer, end_id, length), "part int, name string, docs long, tokens long").toPandas().sort_values("part")
    # One row for each file, so this is as small as a listing of the folder.
    made["start"] = made["tokens"].cumsum() - made["tokens"]
    made.insert(0, "folder", folder)
    return spark.createDataFrame(made, "folder string, part int, name string, docs long, tokens long, start long")


def sequences(folder: str, name: str) -> pa.RecordBatchReader:
    """The record batches of a file; a local file is mapped, not copied."""
    files, base = place(folder)
    path = f"{base}/{name}.arrow"
    source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
    return pa.ipc.open_file(source)


def sequence(folder: str, name: str, k: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Ids, mask of real tokens and mask of document ends of sequence ``k`` of a file, all views of it."""
    batch = sequences(folder, name).get_batch(k // BATCH)
    return tuple(batch.column(c)[k % BATCH].values for c in ("ids", "real", "ends"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            files, base = place(row["folder"])
            index = pa.ipc.open_file(files.open_input_file(f"{base}/{row['name']}.index.arrow")).read_all()
            found, sums, count, crc = [], [], 0, 0  # the last two: of the document that goes on in the next batch
            reader = sequences(row["folder"], row["name"])
            for b in range(reader.num_record_batches):
                got = reader.get_batch(b)
                real = got.column("real").flatten().to_numpy(zero_copy_only=False)
                ids = got.column("ids").flatten().to_numpy()[real].astype("<u4")
                stops = np.flatnonzero(got.column("ends").flatten().to_numpy(zero_copy_only=False)[real]) + 1
                raw, at = ids.view(np.uint8), 0
                for stop in stops.tolist():
                    sums.append(zlib.crc32(raw[4 * at : 4 * stop], crc))
                    found.append(stop - at + count)
                    at, count, crc = stop, 0, 0
                count, crc = count + len(ids) - at, zlib.crc32(raw[4 * at :], crc)
            starts = np.cumsum(found) - found if found else np.empty(0, np.int64)
            if found != index["n_tokens"].to_pylist() or starts.tolist() != index["start"].to_pylist():
                raise ValueError(f"index and ids of {row['name']} do not agree")
            columns = [index["doc_id"].combine_chunks(), pa.array(starts + row["start"], pa.int64()), pa.array(found, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in ``files``, from the files.

    The CRC is that of the ids as little-endian unsigned 32-bit integers. A file
    whose index does not agree with its masks raises an error.
    """
    parts = max(1, files.count())
    return files.repartitionById(parts, F.col("part")).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(spark: SparkSession, docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes ``docs`` and reads the files back."""
    return read_documents(write_tokens(docs, tokenizer, **options))
