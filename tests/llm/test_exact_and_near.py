"""Exact and near duplicates against brute force on small tables."""

import hashlib
import random

import numpy as np
import pytest

from loomtrace.llm import golomb_dedup, simhash_grid
from loomtrace.llm.components import components

SCHEMA = "doc_id long, text string, _fp string, kept string"


def table(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts)], SCHEMA).repartition(3)


@pytest.mark.parametrize("n", [1, 2, 1000])
def test_rice_round_trip(n):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, 1 << 40, n, dtype=np.uint64))
    assert (golomb_dedup.rice_decode(len(values), *golomb_dedup.rice_encode(values)) == values).all()


def test_exact_groups_with_nulls_ties_and_repeats(spark):
    texts = ["a", "b", "a", None, "", "A", "a ", "b", "x" * 100_000, "x" * 100_000, "z", "z"]
    ids = [5, 6, 7, 1, 2, 8, 9, 6, 10, 11, None, None]
    out = golomb_dedup.exact_groups(table(spark, texts, ids)).collect()
    assert len(out) == len(texts)
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    for sha, members in groups.items():
        mine = [r for r in out if r.text_sha256 == sha]
        keep = max((m for m in members if m is not None), default=None)
        assert len(mine) == len(members) and {r.group_size for r in mine} == {len(members)} and {r.keep_id for r in mine} == {keep}
        assert [r.doc_id for r in mine if r.kept] == [keep]
    left = golomb_dedup.drop_exact_copies(table(spark, texts, ids))
    assert left.columns == ["doc_id", "text", "_fp", "kept"] and left.count() == len(groups)


def test_exact_groups_of_an_empty_table(spark):
    assert golomb_dedup.exact_groups(table(spark, ["a"]).limit(0)).count() == 0


def test_simhash_by_definition():
    import re

    import xxhash

    def slow(text):
        found = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))] if found else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 6, 50, 40_000):
        text = " ".join(rng.choice(["Aé", "b B", "c", "dd\x1c"]) for _ in range(n)).replace(" ", "\t\n", 1)
        assert simhash_grid.simhash(text.encode()) == slow(text)


def brute(prints, limit=4):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= limit:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_grid_loses_no_link(spark):
    rng = random.Random(3)
    prints = []
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            prints.append(base)
            for _ in range(rng.randint(1, 5)):
                base ^= 1 << rng.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    truth = brute(signed)
    found = {r.node: r.root for r in simhash_grid.near_links(spark.createDataFrame([(p,) for p in set(signed)], "fp long")).collect()}
    classes = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert {c for c in classes(truth) if len(c) > 1} == classes(found)


def test_near_groups_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    prints = {i: simhash_grid.simhash((t or "").encode()) for i, t in texts.items()}
    roots = brute(list(prints.values()))
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    out = simhash_grid.near_groups(docs).collect()
    assert {(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in out} == {(i, p, least[roots[p]]) for i, p in prints.items()}
    assert simhash_grid.drop_near_copies(docs).count() == len(least)


def test_near_copies_edge_rows(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    docs = table(spark, [None, "", "  \n", long, long.upper(), "one", "one", "two words"], [3, 2, None, 9, 8, 4, 4, 5])
    groups = {r.doc_id: r.component_id for r in simhash_grid.near_groups(docs).collect()}
    assert groups == {3: 2, 2: 2, None: 2, 9: 8, 8: 8, 4: 4, 5: 5}
    left = simhash_grid.drop_near_copies(docs)
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 8] and left.columns == docs.columns
    assert simhash_grid.near_groups(docs.limit(0)).count() == 0 and simhash_grid.drop_near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("full", [1_000, 5])
def test_dense_and_hot_cells_lose_no_link(spark, monkeypatch, full):
    monkeypatch.setattr(simhash_grid, "FULL", full)
    rng = random.Random(5)
    prints = {0}
    for _ in range(300):  # a ball and its neighbours, and others whose vectors agree with it on most segments
        value = rng.choice(sorted(prints))
        prints.add(value ^ 1 << rng.randrange(64))
        prints.add(sum(rng.choice([0, 1, 2, 3]) << 2 * k for k in range(8)) | rng.choice(sorted(prints)) & ~0xFFFF)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    truth = brute(signed)
    table_ = spark.createDataFrame([(p,) for p in signed], "fp long")
    for fixed in (1, 3, 4):
        found = {r.node: r.root for r in simhash_grid.near_links(table_, fixed=fixed).collect()}
        assert all(found.get(p, p) == truth[p] for p in signed)


def test_nothing_but_suspects_moves_beyond_the_broadcast_bound(spark, monkeypatch, tmp_path):
    from loomtrace.llm import common

    texts = [f"text {i}" for i in range(60)] + ["copy"] * 5 + ["same words here again now"] * 3 + [None, ""]
    table(spark, texts).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    before = sorted(map(tuple, golomb_dedup.exact_groups(docs).collect()), key=str), sorted(golomb_dedup.drop_exact_copies(docs).collect()), sorted(simhash_grid.drop_near_copies(docs).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    seen = []
    real = common.told

    def told(*a):
        seen.append(real(*a))
        return seen[-1]

    monkeypatch.setattr(golomb_dedup, "told", told)
    monkeypatch.setattr(simhash_grid, "told", told)
    after = sorted(map(tuple, golomb_dedup.exact_groups(docs).collect()), key=str), sorted(golomb_dedup.drop_exact_copies(docs).collect()), sorted(simhash_grid.drop_near_copies(docs).collect())
    assert after == before and len(seen) == 3
    for marked in seen:
        verdict = marked.columns[-1]
        assert marked.where(f"{verdict} is null").count() == 0


def test_a_scan_cut_another_way_is_still_whole(spark, monkeypatch):
    from loomtrace.llm import common

    texts = [f"text {i}" for i in range(40)] + ["copy"] * 5 + ["x"] * 2
    docs = table(spark, texts)
    want = sorted(golomb_dedup.drop_exact_copies(docs).collect()), sorted(simhash_grid.drop_near_copies(docs).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    for module in (golomb_dedup, simhash_grid):
        monkeypatch.setattr(module, "told", lambda rows, key, verdicts, n, out: common.told(rows, key, verdicts.where("part = 0").withColumn("part", common.F.lit(1)), n, out))
    assert (sorted(golomb_dedup.drop_exact_copies(docs).collect()), sorted(simhash_grid.drop_near_copies(docs).collect())) == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1050)] + [(5, 5), (None, 3)]
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(1000, 1050)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
