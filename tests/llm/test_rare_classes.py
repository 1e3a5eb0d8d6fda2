"""Classes of words that are too rare to move in every sweep: each training word has one."""

import random
from collections import Counter

import numpy as np
import pytest

from loomtrace.llm import brown_lm
from tests.llm.test_brown_lm import base, learned, table


def test_judged_together_as_one_by_one():
    rng = np.random.default_rng(7)
    k, n = 9, 300
    sequence = np.concatenate([[0], rng.integers(1, n, 4_000), [0]])
    sequence[100:140] = 5
    of = np.concatenate([[0, 1], rng.integers(2, k, 20), np.ones(n - 22, int)])
    pairs = np.zeros((k, k))
    np.add.at(pairs, (of[sequence[:-1]], of[sequence[1:]]), 1)
    entries, want = [], []
    rare = [w for w in range(n) if w and of[w] == 1 and (sequence == w).any()]
    for row, word in enumerate(rare):
        found = Counter()
        for a, b in zip(sequence[:-1], sequence[1:]):
            if a == b == word:
                found[2 * k] += 1
            elif b == word:
                found[of[a]] += 1
            elif a == word:
                found[k + of[b]] += 1
        entries += [(row, code, x) for code, x in sorted(found.items())]
        near = np.array([found[c] for c in range(2 * k)])
        want.append(brown_lm.best_class(near[:k], near[k:], found[2 * k], 1, pairs, brown_lm._phi(pairs))[0])
    got = brown_lm.best_classes(*np.array(entries).T, pairs)
    assert got.tolist() == want and len(set(want)) > 3 and max(x for *_, x in entries) > brown_lm._TABLED


@pytest.mark.parametrize("held", [1_000_000, 30])
def test_contexts_by_brute_force(spark, held):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "B", "c", "r1", "r1 r1", "r2", "r3"]) for _ in range(rng.randint(0, 30))) + f" once{i}" for i in range(60)]
    numbers, of, k = {b"a": 2, b"b": 3, b"c": 4}, np.array([0, 1, 2, 3, 3, 1], np.int16), 5
    rows = spark.createDataFrame([(i // 25, bool(learned(i)), t) for i, t in enumerate(texts)], "part long, counted boolean, text string").coalesce(1)
    want, seen = Counter(), set()
    for i, t in enumerate(texts):
        path = [None, *t.lower().encode().split(), None]
        kind = [0 if w is None else int(of[numbers.get(w, 5)]) for w in path]
        for at, w in enumerate(path):
            if w is not None and w not in numbers:
                seen.add((w, i // 25))
                if learned(i):
                    want[w, 2 * k if path[at + 1] == w else k + kind[at + 1]] += 1
                    if path[at - 1] != w:
                        want[w, kind[at - 1]] += 1
    got, met = Counter(), set()
    near = brown_lm.class_contexts(rows, numbers, of, k, held)
    for r in near.collect():
        met.add((bytes(r.word), r.part))
        for x in np.frombuffer(bytes(r.near), np.int32).tolist():
            got[bytes(r.word), x & (1 << brown_lm._bits(k)) - 1] += x >> brown_lm._bits(k)
    assert got == want and met == seen
    answers = brown_lm.placed(near, np.ones((k, k), int)).collect()
    counts = Counter(w for i, t in enumerate(texts) if learned(i) for w in t.encode().split() if w not in numbers)
    assert {(bytes(r.word), r.part) for r in answers} == seen and len(answers) >= len(seen)
    assert all(r.c == counts[bytes(r.word)] and (r["class"] == 1) == (r.c == 0) for r in answers)


def languages(seed, n=240):
    """Two kinds of words in turn, few of them frequent: only a word's kind says what comes next."""
    rng = random.Random(seed)
    kinds = [[f"{p}{i}" for i in range(4)] + [f"{p}{i}" for i in range(100, 400)] for p in "uv"]
    pick = lambda kind: rng.choice(kind[:4] if rng.random() < 0.3 else kind[4:])
    return [" ".join(pick(kinds[i % 2]) for i in range(40)) for _ in range(n)]


def test_rare_words_have_the_class_of_their_kind(spark, monkeypatch):
    """Most of these words are under one of 50 tokens; what follows is known from their classes alone."""
    monkeypatch.setattr(brown_lm, "SHARE", 50)
    texts = languages(1)
    out = brown_lm.score(table(spark, texts), classes=2).collect()
    # All of one kind in one class: a token is one of some 304 words, not of 608.
    assert all(10 ** ((r.base_score - r.score) / r.n_tokens) < 0.65 for r in out)
    assert sorted(tuple(r)[:5] for r in out) == sorted(x[:5] for x in base(texts, range(len(texts))))


def test_unseen_words_stand_where_words_met_once_do(spark):
    texts = [f"a b a b x{i}" for i in range(60)]
    out = brown_lm.score(table(spark, texts), classes=3).collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.n_known == 5 and r.score > r.base_score for r in held)
