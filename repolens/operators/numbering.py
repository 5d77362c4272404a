"""Row numbers within a group of any size, without one task that holds the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, group: str, order: Sequence[str], store: str, name: str = "n") -> DataFrame:
    """The rows with their number in their group, from 1, in the given order, which must be a total one.

    Rows are dealt into ranges of (group, order) and written to ``store``, a folder every executor sees, with the number of their range.
    They are numbered within their range; what stands before it is a running sum over one row for each range and group.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id())
    dealt.write.mode("overwrite").parquet(store)
    dealt = spark.read.schema(dealt.schema).parquet(store)
    within = Window.partitionBy("_range", group).orderBy(*order)
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range", group).agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select("_range", group, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    placed = dealt.withColumn("_place", F.row_number().over(within)).join(starts, ["_range", group])
    return placed.withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")
