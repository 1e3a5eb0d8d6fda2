"""Cells are an explode of the fingerprints, which Spark takes for as small as these; joins of cells must be dealt all the same."""

from pyspark.sql import functions as F

from loomtrace.llm import simhash_grid


def test_joins_of_cells_are_shuffled(spark):
    prints = simhash_grid.written(spark.range(100).select(F.xxhash64("id").alias("fp")), "prints")
    masks = [m for m, _ in simhash_grid.block_masks()]
    first = simhash_grid._first(simhash_grid._cells(prints, masks), simhash_grid.LIMIT)
    labelled = simhash_grid._cells(prints.withColumn("root", F.col("fp")), masks)
    second = simhash_grid._pairs(labelled, labelled, simhash_grid.LIMIT)
    for found in (first, second):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
