"""Places of rows in an order over a whole table, without a task that sees the whole table or one key of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.session import materialize

#: the low bits of a row number that Spark gives count inside a partition
INSIDE = (1 << 33) - 1


def sorted_ranges(df: DataFrame, *order) -> DataFrame:
    """``df`` dealt over partitions by ranges of ``order`` and sorted inside them.

    Equal rows are told apart by their place in the input, so a key that all rows share still falls in many ranges.
    ``order`` is evaluated twice, once for a sample: hash long texts, and write that, beforehand.
    """
    return df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")


def placed(df: DataFrame, group: str, *order) -> DataFrame:
    """``df`` with pos, the row's place from 0 among the rows of its ``group`` (never null), and n, their number.

    Rows are numbered inside sorted ranges and written; what lies before a range's part of a group comes from one count
    for each such part. A group may span any number of ranges.
    """
    rows = materialize(sorted_ranges(df, group, *order).withColumns({"_p": F.spark_partition_id(), "_r": F.monotonically_increasing_id().bitwiseAND(F.lit(INSIDE))}))
    part = rows.groupBy("_p", group).agg(F.min("_r").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.select("_p", group, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("n"))
    return rows.join(part, ["_p", group]).withColumn("pos", F.col("_r") + F.col("_shift")).drop("_p", "_r", "_shift")
