"""Phrase collocations against brute force."""

import random
import re
from collections import Counter

import pytest

from loomtrace.llm import collocations

SCHEMA = "doc_id long, text string, lang string, number string, grp string, _k long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", "y", 1) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)


def brute(rows, least=10, top=2_000):
    found, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    found.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in found.items():
        rows_ = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and b >= least and 100 * b >= 50 * a for q, b in f.items()):
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_of(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a\x01", "a", "né", "日本", "x-y", "z\x1c", " ", "b", "c", "d", "of the", "new york city", "hot hot hot"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "\x0c", "? "]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return [*rows, *rows[:5], (None, "en"), ("", None), (" \t\n..", "fr"), ("solo", "fr"), ("one two. " * 12, "es"), ("u v w " * 3_000, "long")]


@pytest.mark.parametrize("budget", [2_000_000, 40, 3])
def test_all_counts_by_brute_force(spark, budget):
    """Whatever the groups: all packed into one, several, and words split over many."""
    rows = rows_of(budget)
    out = collocations.mine(table(spark, rows), budget=budget, held=500).collect()
    assert sorted(map(tuple, out)) == brute(rows)
    assert out[0].asDict().keys() == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}


def test_top_and_ties(spark):
    rows = [(f"w{i} v{i}. " * 10, "en") for i in range(30)]
    out = collocations.mine(table(spark, rows), top=7).collect()
    assert sorted(map(tuple, out)) == brute(rows, top=7) and len(out) == 7


def test_nothing_to_find(spark):
    docs = table(spark, [("a b", "en"), (None, None)])
    assert collocations.mine(docs).count() == 0 and collocations.mine(docs.limit(0)).count() == 0


def test_scores_of_large_counts_are_exact(spark):
    a, left, right = 3_000_000_000_001, 3_000_000_000_007, 9_999_999_999_999
    rows = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert rows.select(collocations._share("a", "l", "r")).first()[0] == 1_000_000 * a * a // (left * right)


def test_no_group_holds_more_than_its_budget(spark):
    seen = spark.createDataFrame([("en", f"w{i}".encode(), 5 + i) for i in range(300)], "grp string, word binary, c long")
    found = collocations.vocabulary(seen, 10, 200).collect()
    assert len(found) == 295 and len({r.number for r in found}) == 295
    groups = {}
    for r in found:
        if r.slots == 1:
            groups[r.base] = groups.get(r.base, 0) + r.c
    assert max(groups.values()) <= 200 and all(r.slots > 1 for r in found if r.c > 100) and len(groups) < 200
