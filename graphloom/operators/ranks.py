"""Row numbers over a whole table without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import materialize


def numbered(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Rows with their number from 0 in an order that should be total. The table is dealt by ranges and
    sorted within them, written down once so that numbers and offsets come from the same ranges, and the
    counts by range, a row a partition, give the offsets."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = materialize(dealt.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "ranges")
    sizes = kept.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_p", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(offsets), "_p").select(*df.columns, (F.col("_before") + F.col("_i") - F.col("_first")).alias(name))
