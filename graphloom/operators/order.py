"""Places in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.stash import stash


def numbered(rows: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """Adds ``name``: each row's place from 0 in the order.

    Rows are sorted in ranges (a range shuffle) and numbered there, and the
    sizes of the ranges before are added: one row a range.
    """
    line = rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id())
    line = stash(line, "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = line.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_in").alias("_first"))
    sizes = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = line.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_in") - F.col("_first"))
    return out.drop("_part", "_in", "_before", "_first")
