"""Starts whose ways are all short do not walk."""

from loomtrace.operators import packed, walk


def test_only_starts_with_long_ways_walk(spark, monkeypatch):
    """A chain of six hops, a circle of two, and fifty starts with one hop each, at a depth of three."""
    lines = [(f"c{i}", f"c{i + 1}") for i in range(6)] + [("r0", "r1"), ("r1", "r0")] + [(f"x{i}", "end") for i in range(50)]
    edges = spark.createDataFrame([(f, t, "feeds", "exact") for f, t in lines], "f string, t string, edge_type string, confidence string")
    ids = sorted({i for line in lines for i in line})
    walked, plain = [], packed.walk

    def seen(hops, seeds, *more):
        walked.extend(r.node for r in seeds.select("node").collect())
        return plain(hops, seeds, *more)

    monkeypatch.setattr(packed, "walk", seen)
    nodes = spark.createDataFrame([(i,) for i in ids], "node_id string")
    found = {r.start: r.truncated for r in walk.truncated_starts(nodes, edges, nodes, 3).collect()}
    assert found == {i: i in ("c0", "c1", "c2") for i in ids}
    assert sorted(walked) == ["c0", "c1", "c2", "r0", "r1"]
