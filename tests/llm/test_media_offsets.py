"""Alignments of recordings when several offsets have votes."""

import numpy as np
import pyarrow as pa

from loomtrace.llm import chroma_media


def test_a_looped_sound_does_not_hide_the_true_offset():
    rng = np.random.default_rng(3)
    noise = lambda n: rng.integers(-(2**31), 2**31 - 1, n, np.int64).astype(np.int32)
    sound, query = np.full(6, 12345, np.int32), noise(100)
    query[40:46] = sound
    mine = query.copy()
    changed = np.arange(100) % 5 != 0
    mine[changed] ^= 1  # the true offset, 0, has 20 equal integers and few differing bits
    mine[40:46] = query[40:46] ^ 1
    mine[:40:5] = query[:40:5]
    other = np.concatenate([mine, noise(60)])
    other[110:135] = query[50:75]  # offset 60 has 25 equal integers and else noise
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([other.tolist()], pa.list_(pa.int32()))], ["class", "codes"])
    equal = lambda s: int((other[s : s + 100] == query[: len(other[s : s + 100])]).sum())
    assert equal(60) > equal(0) >= chroma_media.VOTES
    found = [r for b in chroma_media._aligned([3], [query], -1)(iter([batch])) for r in b.to_pylist()]
    assert [(r["query"], r["class"], r["offset"], r["overlap"]) for r in found] == [(3, 7, 0, 100)]
