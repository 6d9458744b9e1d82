"""Places of rows in an order, for tables and groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.stage import Stage


def numbered(rows: DataFrame, group: str, order: list[str], stage: Stage, name: str) -> DataFrame:
    """Add ``pos``, the place of each row in its group from 0, and ``n``, the rows of the group.

    ``rows`` is a written table: its range bounds come from a sample, which must not change.  Rows are
    range-partitioned by group and order, so a hot group is many slices; a row's place is its number in
    its slice and the sizes of the slices of its group before.
    """
    at = F.monotonically_increasing_id()  # the partition, then the number of the row in it
    ordered = stage.save(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", at), name)
    sliced = ordered.withColumn("_slice", F.shiftright("_at", 33))
    slices = sliced.groupBy(group, "_slice").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    places = slices.select(
        group, "_slice",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy(group)).alias("n"),
    )
    return sliced.join(places, [group, "_slice"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_slice", "_shift")
