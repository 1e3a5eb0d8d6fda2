"""What a task holds while it packs suffixes."""

import tracemalloc

import numpy as np
import pyarrow as pa

from loomtrace.llm import collocations


class Task:
    """Stands for a table: gives the function that Spark would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def packed(texts, table, held):
    batch = pa.RecordBatch.from_arrays([pa.array([p for p, *_ in texts], pa.int64()), pa.array([g for _, g, _ in texts]), pa.array([t for *_, t in texts])], ["part", "grp", "text"])
    return collocations.suffixes(Task(), lambda part, *_: table, held)(iter([batch]))


def test_bytes_for_each_suffix_held():
    rng, n = np.random.default_rng(1), 2_000
    table = pa.table({"grp": ["en"] * n, "word": [b"w%d" % i for i in range(n)], "number": np.arange(n) + 5, "base": np.arange(n) // 10, "slots": np.where(np.arange(n) < 3, 4, 1).astype(np.int32)})
    texts = [(0, "en", " ".join(f"w{i}" for i in rng.integers(0, n, 1_000))) for _ in range(400)]
    held = 300_000
    tracemalloc.start()
    found = sum(len(b["rest"][i].as_py()) // 8 for b in packed(texts, table, held) for i in range(b.num_rows))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Hardly two suffixes are equal here, so nearly all of them are sent.
    assert found > 0.99 * 400 * 999 and most < 110 * held


def test_parts_do_not_mix():
    """A place in one part's table says nothing in the next."""
    tables = {p: pa.table({"grp": ["en", "de", "en"], "word": [b"a", b"a", b"b"], "number": np.array([1, 2, 3]) + 10 * p, "base": [0, 0, 0], "slots": np.ones(3, np.int32)}) for p in (0, 1)}
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 1]), pa.array(["en", "de", "en"]), pa.array(["a b x a", "a a", "b b a"])], ["part", "grp", "text"])
    out = set()
    for b in collocations.suffixes(Task(), lambda part, *_: tables[part], 1_000)(iter([batch])):
        for r in b.to_pylist():
            first, rest = np.frombuffer(r["first"], np.int32), np.frombuffer(r["rest"], np.int64)
            out |= {(int(a), int(c >> 32), int(c & 0xFFFFFFFF) - 1) for a, c in zip(first, rest)}
    assert out == {(1, 3, -1), (2, 2, -1), (13, 13, 11), (13, 11, -1)}


def test_suffixes_take_sixteen_bytes_on_their_way():
    table = pa.table({"grp": ["en"] * 9, "word": [b"w%d" % i for i in range(9)], "number": np.arange(9), "base": np.zeros(9, np.int64), "slots": np.ones(9, np.int32)})
    rows = [r for b in packed([(0, "en", " ".join(f"w{i * i % 9}" for i in range(99)))], table, 1_000) for r in b.to_pylist()]
    assert len(rows) == 1 and sum(len(rows[0][c]) for c in ("first", "rest", "n")) == 2 * len(rows[0]["rest"])
