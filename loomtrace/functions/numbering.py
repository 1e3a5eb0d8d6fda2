"""Row numbers over a whole table without passing it through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.plans.closure import settled


def numbered(df: DataFrame, *order: Column, out: str = "n") -> DataFrame:
    """``df`` with numbers from 1 in the given order.

    Rows are dealt to ranges and numbered within; what stands before a range is
    added from a table with one row for each range.
    """
    cut = settled(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return cut.withColumn("_within", within).join(F.broadcast(before), "_range").withColumn(out, (F.col("_within") + F.col("_before")).cast("long")).drop("_range", "_within", "_before")
