"""Which labelled rows may be learned from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm.common import small_enough, written

#: Rows whose CRC-32 of the id as text leaves this remainder are never learned from.
PARTS, HELD_OUT = 4, 2


def held_out(id_col: Column) -> Column:
    """A null id counts as an empty text."""
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % PARTS == HELD_OUT


def sample_by_class(rows: DataFrame, class_col: str, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows of each class, by a hash of the id, and each class's ``total``.

    The window passes narrow rows only: give ids and classes, not texts.
    """
    order = F.xxhash64(id_col)
    # A hash threshold leaves about twice the sample, so no class passes whole through a window.
    totals = rows.groupBy(class_col).agg(F.count(F.lit(1)).alias("total"))
    share = F.least(F.lit(1.0), F.lit(2.0 * most + 200) / F.col("total"))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 30)) < share * F.lit(float(1 << 30))
    totals = written(totals, "totals")
    near = rows.join(F.broadcast(totals) if small_enough(totals, 64) else totals, class_col).where(drawn)
    return near.withColumn("_k", F.row_number().over(Window.partitionBy(class_col).orderBy(order, id_col))).where(F.col("_k") <= most).drop("_k")
