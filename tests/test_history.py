"""The stored history: snapshots replaced, dropped and read by their partitions."""

from loomtrace.sources import history

NODE = "estate_id string, snapshot_id string, node_id string, node_type string"
EDGE = "estate_id string, snapshot_id string, f string, t string, edge_type string, confidence string"
HEAD = "estate_id string, snapshot_id string, seq int, sha string, generated_at string"


def put(spark, path, snapshots, columns=("a", "b"), estate="e"):
    nodes = spark.createDataFrame([(estate, s, c, "column") for s, _ in snapshots for c in columns], NODE)
    edges = spark.createDataFrame([(estate, s, "a", "b", "feeds", "exact") for s, _ in snapshots], EDGE)
    history.store(nodes, edges, spark.createDataFrame([(estate, s, seq, s, None) for s, seq in snapshots], HEAD), path)


def test_five_and_twenty_snapshots(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, [(f"s{i:02}", i) for i in range(25)])
    put(spark, path, [("x", 1)], estate="other")
    put(spark, path, [("s03", 30)], ("a", "b", "c"))
    builds = {(r.estate_id, r.snapshot_id): r for r in history.ranked(history.read_builds(spark, path)).collect()}
    # Stored again it is the newest, once, with its new content; the other estate is untouched.
    assert len(builds) == 26 and builds["e", "s03"].slot == 1 and builds["e", "s03"].nodes == 3 and builds["e", "s04"].nodes == 2 and builds["e", "s03"].previous == "s24"
    assert (builds["e", "s03"].traced, builds["e", "s03"].total) == (1, 3)
    assert history.drop_old(spark, path) == 5 and history.drop_old(spark, path) == 0
    left = {(r.estate_id, r.snapshot_id) for r in history.read_builds(spark, path).collect()}
    assert left == {("other", "x"), ("e", "s03"), *(("e", f"s{i:02}") for i in range(6, 25))}
    assert {r.snapshot_id for r in spark.read.parquet(f"{path}/nodes").where("estate_id = 'e'").select("snapshot_id").distinct().collect()} == {s for e, s in left if e == "e"}
    nodes, edges = history.read_previous(spark, path, "e", "s03")
    assert {r.snapshot_id for r in nodes.collect()} == {"s24"} and edges.count() == 1
    assert history.read_previous(spark, path, "e", "s06") is None and history.read_previous(spark, path, "e", "none") is None
    assert history.drop_old(spark, path, 0) == 21


def test_one_snapshot_scans_its_files_alone(spark, tmp_path):
    put(spark, str(tmp_path), [(f"s{i}", i) for i in range(5)])
    nodes, edges = history.read_snapshot(spark, str(tmp_path), "e", "s2")
    for df in (nodes, edges):
        plan = df._jdf.queryExecution().executedPlan().toString()
        filters = plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
        assert "(estate_id" in filters and "(snapshot_id" in filters
    assert nodes.count() == 2
