"""Class-based scores against definitions and brute force on small corpora."""

import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from loomtrace.llm import brown_lm

SCHEMA = "doc_id long, text string, grp string, part string, c long"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA).repartition(3)


def learned(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2


def base(texts, ids):
    words = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    counts = Counter()
    for i, t in zip(ids, texts):
        if learned(i):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in zip(ids, texts):
        tokens = [*words(t), None]
        yield i, not learned(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(log10((counts[w] + 1) / (n + v + 1)) for w in tokens)


def prose(seed, n=80):
    """Two invented languages; a word says much of the next one."""
    rng = random.Random(seed)
    langs = [[f"{p}{k}" for k in range(12)] for p in ("a", "b")]
    texts = []
    for _ in range(n):
        words = rng.choice(langs)
        texts.append(" ".join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randint(0, 60))) + f" once{rng.random()}")
    return [*texts, *texts[:3], None, "", " \n\t", "a1 " * 5_000, "é x\x1cy", "unseen words here"]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = prose(1)
    ids = [*range(len(texts) - 2), 4, None]
    return texts, ids, brown_lm.score(table(spark, texts, ids), classes=6).collect()


def test_base_scores_and_counts(corpus):
    texts, ids, out = corpus
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 6))
    want = sorted(base(texts, ids), key=key)
    got = sorted((tuple(r)[:6] for r in out), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * (1 + abs(b[5]))


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    texts = prose(2, 200)
    found = brown_lm.perplexity(brown_lm.score(table(spark, texts), classes=6)).collect()
    assert len(found) == 2 and all(r.perplexity < 0.8 * r.base_perplexity for r in found)


def test_probabilities_after_a_class_add_up_to_one():
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 5, (9, 9))
    pairs[3] = 0
    assert np.abs((10 ** brown_lm.transitions(pairs)).sum(axis=1) - 1).max() < 1e-12
    assert np.abs((10 ** brown_lm.transitions(np.zeros((4, 4), int))).sum(axis=1) - 1).max() < 1e-12


def likelihood(sequence, of, k):
    pairs = np.zeros((k, k))
    np.add.at(pairs, (of[sequence[:-1]], of[sequence[1:]]), 1)
    return pairs, brown_lm._phi(pairs).sum() - 2 * brown_lm._phi(pairs.sum(axis=1)).sum()


def test_gain_of_a_move_is_the_change_of_the_likelihood():
    rng = np.random.default_rng(3)
    k, n = 6, 14
    sequence = np.concatenate([[0], rng.integers(1, n, 300), [0]])
    of = np.concatenate([[0, 1], rng.integers(2, k, n - 2)])
    for word in range(2, n):
        pairs, now = likelihood(sequence, of, k)
        before, after = np.zeros(k), np.zeros(k)
        for a, b in zip(sequence[:-1], sequence[1:]):
            if (a == word) != (b == word):
                if b == word:
                    before[of[a]] += 1
                else:
                    after[of[b]] += 1
        itself = sum(a == b == word for a, b in zip(sequence[:-1], sequence[1:]))
        best, gain = brown_lm.best_class(before, after, itself, of[word], pairs, brown_lm._phi(pairs))
        tried = {}
        for c in range(2, k):
            other = of.copy()
            other[word] = c
            tried[c] = likelihood(sequence, other, k)[1] - now
        assert abs(gain - max(tried.values())) < 1e-8 and abs(tried[best] - gain) < 1e-8
        of[word] = best


def test_class_pairs_from_contexts(spark):
    rng = np.random.default_rng(5)
    k, n = 7, 20
    sequence = np.concatenate([[0], rng.integers(1, n, 400), [0]])
    of = np.concatenate([[0, 1], rng.integers(1, k, n - 2)]).astype(np.int16)
    counts = Counter(zip(sequence[:-1].tolist(), sequence[1:].tolist()))
    pairs = spark.createDataFrame([(a, b, c) for (a, b), c in counts.items()], "a int, b int, n long")
    fixed = np.zeros((k, k), np.int64)
    for (a, b), c in counts.items():
        if a < 2 and b < 2:
            fixed[a, b] = c
    assert (brown_lm.class_pairs(brown_lm.contexts(pairs), of, k, fixed) == likelihood(sequence, of, k)[0]).all()


def test_words_of_one_kind_share_a_class(spark):
    """Two kinds of words that only follow each other's: exchange tells them apart."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdef" if i % 2 else "uvwxyz") for i in range(40)) for _ in range(60)]
    pairs = Counter()
    order = {w: brown_lm.FIRST + i for i, w in enumerate("audvwbxcyezf")}
    for t in texts:
        path = [0, *(order[w] for w in t.split()), 0]
        pairs.update(zip(path, path[1:]))
    near = brown_lm.contexts(spark.createDataFrame([(a, b, c) for (a, b), c in pairs.items()], "a int, b int, n long")).cache()
    k = brown_lm.FIRST + 2
    of, found = brown_lm.exchanged(near, 12, np.zeros((k, k), np.int64), classes=2, sweeps=4)
    assert len({of[order[w]] for w in "abcdef"}) == 1 == len({of[order[w]] for w in "uvwxyz"}) and of[order["a"]] != of[order["u"]]
    assert found.sum() == sum(pairs.values())


def test_no_training_rows_and_empty_tables(spark):
    ids = [i for i in range(60) if not learned(i)][:3]
    out = brown_lm.score(table(spark, ["a b", None, "c"], ids)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0), (2, 0, 0, 0.0)}
    assert all(np.isfinite(r.score) and r.score < 0 for r in out)
    assert brown_lm.score(table(spark, ["a"]).limit(0)).count() == 0
