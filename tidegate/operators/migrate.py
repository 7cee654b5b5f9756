"""Applying a change to a table: DataFrame in, DataFrame out. Rows move by projection; nothing is collected but one count per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.session import materialize


def migrate(df: DataFrame, ops: list[dict]) -> DataFrame:
    """The table's rows in its new shape. ops, in order: rename_column (col, new_name), drop_column (col), add_column (col, type, default), alter_type (col, new_type)."""
    for op in ops:
        kind, col = op["kind"], op["col"]
        if kind == "rename_column":
            df = df.withColumnRenamed(col, op["new_name"])
        elif kind == "drop_column":
            df = df.drop(col)
        elif kind == "add_column":
            df = df.withColumn(col, F.lit(op.get("default")).cast(op["type"]))
        elif kind == "alter_type":
            df = df.withColumn(col, F.col(col).try_cast(op["new_type"]))
        else:
            raise ValueError(f"{kind} doesn't change rows")
    return df


def backfill(df: DataFrame, col: str, value: str, where: str) -> DataFrame:
    """UPDATE ... SET col = value WHERE where, as a projection."""
    return df.withColumn(col, F.when(F.expr(where), F.expr(value)).otherwise(F.col(col)))


def delete_rows(df: DataFrame, where: str) -> DataFrame:
    return df.where(~F.coalesce(F.expr(where), F.lit(False)))


def insert_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns that the new rows lack are null in them."""
    return df.unionByName(rows, allowMissingColumns=True)


def backfill_batches(df: DataFrame, key: str, size: int = 5_000, where: str = "true") -> DataFrame:
    """(batch, min_key, max_key, n): key ranges that cover exactly the rows where ``where`` holds, ``size`` rows each but the last.

    Rows are range-partitioned by key and numbered inside each partition; the offsets of partitions come from one count
    for each partition, so no window sees the whole table. Keys are taken in order; equal keys may span two batches.
    """
    need = df.where(F.expr(where)).select(F.col(key).alias("k"))
    parts = need.repartitionByRange("k").sortWithinPartitions("k").select("k", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    local = materialize(parts.withColumn("r", F.col("m").bitwiseAND(F.lit((1 << 33) - 1))))  # written: both uses see the same partitions
    counts = sorted((r["p"], r["n"]) for r in local.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    at = df.sparkSession.createDataFrame(offsets, "p int, o long")
    numbered = local.join(F.broadcast(at), "p").withColumn("batch", F.floor((F.col("o") + F.col("r")) / size))
    return numbered.groupBy("batch").agg(F.min("k").alias("min_key"), F.max("k").alias("max_key"), F.count(F.lit(1)).alias("n"))


def expand_column(df: DataFrame, old: str, new: str, new_type: str) -> DataFrame:
    """``df`` with the new column beside the old one, filled by a cast that gives null where it fails."""
    return df.withColumn(new, F.col(old).try_cast(new_type))


def expansion_loss(df: DataFrame, old: str, new: str) -> DataFrame:
    """(failed, changed): values of an expanded column that failed to cast, or differ when cast back."""
    back = F.col(new).cast(dict(df.dtypes)[old])
    return df.agg(F.count_if(F.col(old).isNotNull() & F.col(new).isNull()).alias("failed"), F.count_if(F.col(new).isNotNull() & (back != F.col(old))).alias("changed"))


def dependent_objects(objects: DataFrame, ops: DataFrame) -> DataFrame:
    """(script_id, idx, name, object_kind, effect): constraints and indexes that go with a dropped column or follow a rename.

    ``objects`` (tbl, name, object_kind, columns array); ``ops`` (script_id, idx, kind, tbl, col).
    """
    o = ops.where(F.col("kind").isin("drop_column", "rename_column"))
    return o.join(objects, "tbl").where(F.array_contains("columns", F.col("col"))).select("script_id", "idx", "name", "object_kind", F.when(F.col("kind") == "drop_column", "dropped").otherwise("renamed").alias("effect"))
