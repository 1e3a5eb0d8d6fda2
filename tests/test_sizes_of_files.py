"""Tables whose files are small but whose rows are many are not built on the driver."""

from pyspark.sql import functions as F

from loomtrace.plans.closure import settled
from loomtrace.plans.estate import Estate


def test_a_small_file_of_many_rows_is_shuffled(spark, sf):
    estate = Estate(spark, sf)
    many = settled(spark.range(1_500_000).select("id", F.lit("a long text that is the same in every row").alias("text")))
    plan = many.join(spark.range(10_000_000).select(F.col("id")), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    near = estate.sql("select c_custkey from customer join nation on c_nationkey = n_nationkey")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in near
