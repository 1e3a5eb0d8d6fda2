"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch (a run of word marks and the letters behind it)
are laid end to end and indexed by a suffix array as deep as the longest piece.
Every piece of the vocabulary is searched in it by bisection, which gives all its
occurrences as one range. Each occurrence is an edge from its start to its end;
edges are sorted by the position of their end and relaxed in that order.

For a BPE model relaxing goes by compatibility. The encoding of a prefix ends in
exactly one piece, and a sequence of pieces is an encoding if and only if each
neighbouring pair is one (no merge crosses the border between the two). So an edge
is taken if its piece can follow the piece that the prefix before it ends in, and
of all edges with one end exactly one is. Characters that are in no piece are
edges of their own and become bytes. Texts without spaces, of any length, are cut
where no piece of the vocabulary holds the two characters at the border.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Characters of one index, segments that a worker remembers, cells of the table of pairs.
#: Workers outlive their tasks, so what they remember counts against every later task.
_INDEXED = 1 << 18
_REMEMBER = 200_000
#: Length up to which segments are kept when the rest is forgotten: short ones come again.
_KEPT = 8
#: Texts that are encoded at once.
_ROWS = 250
_PAIR_BITS = 20
_START, _NONE = -1, -2
#: Characters beyond which a segment is cut at every border that no piece covers, and
#: beyond which what is left is relaxed by itself, edge by edge, not with the others.
_CUT, _LONG = 256, 2_048


class Pieces:
    """A vocabulary read from a model file, and what encoding needs of it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_known = all(model.is_byte(i) for i in self.byte_ids)
        self.unknown = model.unk_id()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.score = {t: model.get_score(i) for i, t in enumerate(self.texts) if not special[i]}
        whole = [i for i, t in enumerate(self.texts) if not special[i] and self._alone(t)]
        # Suffixes are compared as deep as the longest piece, four characters at a time.
        self.deep = -(-max((len(self.texts[i]) for i in whole), default=1) // 4) * 4
        chars = sorted({c for i in whole for c in self.texts[i]})
        self.code = np.full(0x110000, len(chars) + 1, np.uint16)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.other = len(chars) + 1
        self.ids = np.array(whole)
        self.length = np.ones(n + 1, np.int64)
        self.length[self.ids] = [len(self.texts[i]) for i in whole]
        codes = np.zeros((len(whole), self.deep), np.uint16)
        for row, i in enumerate(whole):
            codes[row, : len(self.texts[i])] = self.code[[ord(c) for c in self.texts[i]]]
        self.low = self._packed(codes)
        self.high = self._packed(np.where(codes == 0, np.uint16(0xFFFF), codes))
        self.no_piece = n
        self.pairs = np.unique([self.code[ord(a)] * np.int64(1 << 16) + self.code[ord(b)] for t in self.score for a, b in zip(t, t[1:])] or [np.int64(0)])
        marks_first = all(MARK not in self.texts[i].lstrip(MARK) for i in whole)
        barrier = "\n" not in chars
        self.segment = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n") if marks_first and barrier else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if marks_first else "(?s).+")
        self.pair_key = np.full(1 << _PAIR_BITS, -1, np.int64)
        self.pair_fits = np.zeros(1 << _PAIR_BITS, bool)
        self.known: dict[str, bytes] = {}
        self.raw = [self._raw(i, t, model) for i, t in enumerate(self.texts)]

    def _raw(self, i: int, text: str, model) -> bytes:
        if model.is_control(i):
            return b""
        if model.is_byte(i):
            return bytes([int(text[3:5], 16)])
        return " ⁇ ".encode() if model.is_unknown(i) else text.replace(MARK, " ").encode()

    def _packed(self, codes: np.ndarray) -> list[np.ndarray]:
        wide = codes.astype(np.uint64)
        return [wide[:, k] << np.uint64(48) | wide[:, k + 1] << np.uint64(32) | wide[:, k + 2] << np.uint64(16) | wide[:, k + 3] for k in range(0, self.deep, 4)]

    def _alone(self, text: str) -> bool:
        """Whether merging the characters of a piece gives the piece."""
        return self._merged(text, 0)

    def _merged(self, text: str, border: int) -> bool:
        """Whether merging never crosses ``border`` (0: whether it ends in one symbol)."""
        symbols, ends, score = list(text), list(range(1, len(text) + 1)), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            if border and ends[at] == border:
                return False
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ends[at]
        return bool(border) or len(symbols) == 1

    def fit(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether each piece of ``after`` can follow that of ``before``; pairs are remembered."""
        keys = before * np.int64(1 << 32) + after
        cells = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)
        fits = self.pair_fits[cells]
        new = np.flatnonzero(self.pair_key[cells] != keys)
        if len(new):
            pairs, where = np.unique(keys[new], return_inverse=True)
            texts = self.texts
            told = np.array([self._merged(texts[p >> 32] + texts[p & 0xFFFFFFFF], len(texts[p >> 32])) for p in pairs.tolist()])
            fits[new] = told[where]
            self.pair_key[cells[new]], self.pair_fits[cells[new]] = keys[new], fits[new]
        return fits

    def _found(self, keys: list[np.ndarray], pieces: list[np.ndarray], right: bool) -> np.ndarray:
        """Bisection of all pieces at once in the sorted suffixes."""
        low, high = np.zeros(len(pieces[0]), np.int64), np.full(len(pieces[0]), len(keys[0]), np.int64)
        for _ in range(len(keys[0]).bit_length()):
            middle = np.minimum((low + high) >> 1, len(keys[0]) - 1)
            less, same = np.zeros(len(low), bool), np.ones(len(low), bool)
            for k, p in zip(keys, pieces):
                here = k[middle]
                less |= same & (here < p)
                same &= here == p
            if right:
                less |= same
            open_ = low < high
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        return low

    def edges(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence of a piece in ``flat`` (codes, 0 between segments)."""
        wide = np.concatenate([flat, np.zeros(self.deep, np.uint16)]).astype(np.uint64)
        four = wide[:-3] << np.uint64(48) | wide[1:-2] << np.uint64(32) | wide[2:-1] << np.uint64(16) | wide[3:]
        n = len(flat)
        words = [four[k : k + n] for k in range(0, self.deep, 4)]
        suffixes = np.lexsort(words[::-1])
        keys = [w[suffixes] for w in words]
        first, last = self._found(keys, self.low, False), self._found(keys, self.high, True)
        times = np.maximum(last - first, 0)
        place = np.arange(times.sum()) + np.repeat(first - (np.cumsum(times) - times), times)
        return suffixes[place], np.repeat(self.ids, times)

    def encode_segments(self, segments: list[str]) -> None:
        """Encodes distinct segments and remembers them."""
        joined = "\0".join(segments) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        begins = np.cumsum(sizes + 1) - sizes - 1
        flat = self.code[points]
        flat[begins + sizes] = 0
        start, piece = self.edges(flat)
        unknown = np.flatnonzero(flat == self.other)
        start, piece = np.concatenate([start, unknown]), np.concatenate([piece, np.full(len(unknown), self.no_piece)])
        end = start + self.length[piece]
        last = np.full(len(flat) + 1, _NONE, np.int64)
        last[begins] = _START
        long = np.flatnonzero(sizes > _LONG)
        if len(long):
            inside = np.isin(np.repeat(np.arange(len(sizes)), sizes + 1)[start], long)
            self._relax(start[inside], piece[inside], end[inside], last)
            start, piece, end = start[~inside], piece[~inside], end[~inside]
        depth = end - np.repeat(begins, sizes + 1)[start]
        order = np.argsort(depth.astype(np.uint16) if depth.max(initial=0) < 1 << 16 else depth, kind="stable")
        start, piece, end, depth = start[order], piece[order], end[order], depth[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]])
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            before, now = last[start[a:z]], piece[a:z]
            good = (before == _START) | (before == self.no_piece) | (now == self.no_piece)
            ask = np.flatnonzero(~good & (before != _NONE))
            good[ask] = self.fit(before[ask], now[ask])
            good &= before != _NONE
            last[end[a:z][good]] = now[good]
        self._walk(segments, points, last, begins, sizes)

    def _relax(self, start: np.ndarray, piece: np.ndarray, end: np.ndarray, last: np.ndarray) -> None:
        """Relaxes the edges of long segments one by one, in the order of their ends."""
        order, held, found = np.argsort(end, kind="stable"), {}, {}
        for a, p, z in zip(start[order].tolist(), piece[order].tolist(), end[order].tolist()):
            before = found.get(a)
            if before is None:
                before = found[a] = int(last[a])
            if before == _NONE:
                continue
            if before not in (_START, self.no_piece) and p != self.no_piece:
                fits = held.get((before, p))
                if fits is None:
                    fits = held[before, p] = self._merged(self.texts[before] + self.texts[p], len(self.texts[before]))
                if not fits:
                    continue
            last[z] = found[z] = p

    def cut(self, segment: str) -> list[str]:
        """A long segment in parts, at borders that no piece covers; characters in no piece stay together."""
        codes = self.code[np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        keys = codes[:-1] * (1 << 16) + codes[1:]
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        cuts = np.flatnonzero((self.pairs[at] != keys) & ~((codes[:-1] == self.other) & (codes[1:] == self.other))) + 1
        return [segment[a:z] for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(segment)])]

    def split(self, text: str) -> list[str]:
        """The segments of a text; a merge never crosses the border between two."""
        parts = self.segment.findall(MARK + text.replace(" ", MARK)) if text else []
        if len(text) > _CUT and max(map(len, parts)) > _CUT:
            return [x for p in parts for x in (self.cut(p) if len(p) > _CUT else (p,))]
        return parts

    def _walk(self, segments, points, last, begins, sizes) -> None:
        """Follows the taken edges back from each segment's end."""
        short = np.flatnonzero(sizes <= _LONG)
        rows, at = short, (begins + sizes)[short]
        found = []
        for row in np.flatnonzero(sizes > _LONG).tolist():
            place, first, taken = int(begins[row] + sizes[row]), int(begins[row]), []
            while place > first:
                taken.append((int(last[place]), place))
                place -= int(self.length[taken[-1][0]])
            # From the first piece to the last, as the rounds below once they are turned round.
            found += [(np.full(len(taken), row), *np.array(taken[::-1], np.int64).T)]
        while len(rows):
            piece = last[at]
            found.append((rows, piece, at))
            at = at - self.length[piece]
            more = at > begins[rows]
            rows, at = rows[more], at[more]
        rows = np.concatenate([f[0] for f in reversed(found)])
        order = np.argsort(rows, kind="stable")
        rows, piece, ends = (np.concatenate([f[k] for f in reversed(found)])[order] for k in range(3))
        odd = set(rows[piece == self.no_piece].tolist())
        cuts = np.searchsorted(rows, np.arange(len(segments) + 1)).tolist()
        ids = piece.astype(np.int32)
        raw = ids.tobytes()
        for k, segment in enumerate(segments):
            a, z = cuts[k], cuts[k + 1]
            self.known[segment] = raw[4 * a : 4 * z] if k not in odd else self._with_bytes(ids[a:z].tolist(), ends[a:z].tolist(), points)

    def _with_bytes(self, ids: list[int], ends: list[int], points: np.ndarray) -> bytes:
        out = []
        for i, end in zip(ids, ends):
            if i != self.no_piece:
                out.append(i)
            elif self.bytes_known:
                out += [self.byte_ids[b] for b in chr(points[end - 1]).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out, at = [], 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= 8 * _INDEXED):
                size += len(texts[stop])
                stop += 1
            split = [self.split(t) for t in texts[at:stop]]
            if len(self.known) > _REMEMBER:
                self.known = {k: v for k, v in self.known.items() if len(k) <= _KEPT}
                if len(self.known) > _REMEMBER // 2:
                    self.known = {}
            new = list({s for parts in split for s in parts if s not in self.known})
            begin = size = 0
            for k, s in enumerate(new):
                size += len(s) + 1
                if size >= _INDEXED or k == len(new) - 1:
                    self.encode_segments(new[begin : k + 1])
                    begin, size = k + 1, 0
            known = self.known
            out += [b"".join([known[s] for s in parts]) for parts in split]
            at = stop
        return out

    def decode(self, ids: list[int]) -> str:
        """The text; bytes that are not UTF-8 become replacement characters."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if ids and self.texts[ids[0]].startswith(MARK) else text


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str, text_col: str = "text", out: str = "piece_ids", check: str | None = None) -> DataFrame:
    """``docs`` with the ids (array of int) of each whole text; a column of that name is replaced.

    Null and empty texts have no ids; texts are encoded whole, however long, and
    repeated rows each; all other columns stay as they are, whatever their names, and an
    empty table gives an empty result. With ``check``, a column of that name says
    whether the ids decode to the text. ``model`` is the path of a BPE model with an
    identity normaliser and a dummy prefix, readable on every executor.
    """

    @F.arrow_udf("struct<ids:array<int>,same:boolean>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pieces(model)
        for batch in batches:
            parts = [pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("same", pa.bool_())]))]
            for at in range(0, len(batch), _ROWS):
                texts = [t or "" for t in batch.slice(at, _ROWS).to_pylist()]
                found = known.encode(texts)
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
                same = [known.decode(np.frombuffer(x, np.int32).tolist()) == t for x, t in zip(found, texts)] if check else [None] * len(texts)
                parts.append(pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], ["ids", "same"]))
            yield pa.concat_arrays(parts)

    coded = docs.select(F.struct("*").alias("doc"), ids(F.col(text_col)).alias("coded"))
    new = {out: F.col("coded.ids")} | ({check: F.col("coded.same")} if check else {})
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in new]
    return coded.select(*kept, *(c.alias(name) for name, c in new.items()))


def decode(docs: DataFrame, model: str, ids_col: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of each list of ids; a null list has a null text, an empty one an empty text."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat, ends = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_numpy()
            known = pieces(model)
            yield pa.array([known.decode(flat[a:z].tolist()) if ok else None for a, z, ok in zip(ends[:-1], ends[1:], batch.is_valid().to_pylist())], pa.string())

    return docs.withColumn(out, text(F.col(ids_col)))


def digest(docs: DataFrame, model: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: id, n_ids, ids_crc32, decoded_crc32, round_trip.

    CRCs are of the ids as little-endian signed 32-bit integers and of the decoded
    text in UTF-8. Ids stay within a batch, so memory is that of a batch. A null
    text counts as empty.
    Repeated rows have a row each; other columns are ignored; an empty table gives
    an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, rows = pieces(model), []
            for at in range(0, len(batch), _ROWS):
                part = [t or "" for t in batch.column(1).slice(at, _ROWS).to_pylist()]
                for raw, text in zip(known.encode(part), part):
                    back = known.decode(np.frombuffer(raw, np.int32).tolist())
                    rows.append((len(raw) // 4, zlib.crc32(raw), zlib.crc32(back.encode()), back == text))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_ids", "ids_crc32", "decoded_crc32", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean").withColumnRenamed("id", id_col)
