"""Connected components of a link table as Spark jobs (alternating large-star and small-star)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.session import discard, materialize


def local_forest(a: list, b: list) -> list[tuple]:
    """A spanning forest of the given links, each node linked with the least node of its tree. The order of links is immaterial."""
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in up if find(x) != x]


def _thin(batches):
    """Links of each batch as a forest: a batch is bounded by the session's Arrow batch size."""
    for t in batches:
        f = local_forest(t.column(0).to_pylist(), t.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in f], pa.int64()), pa.array([y for _, y in f], pa.int64())], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(u long, v long)`` that has a link to another node.

    root is the least node that links reach. Null ends, loops and repeated links are of no account; an empty table
    gives an empty table. Each round is two grouped minima and two equi-joins on the same key, whose heavy hubs
    adaptive execution splits; the rounds needed grow with the logarithm of the longest chain.
    """
    spark = links.sparkSession
    e = links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u <> v")
    e = materialize(e.mapInArrow(_thin, "u long, v long").distinct())
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(e)
    while seen[0]:
        # e has u > v always: the lesser end is v
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        lo = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lo, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x")).select(F.col("x.a").alias("u"), F.col("x.b").alias("v")).where("u <> v")
        last, e = e, materialize(small.distinct())
        discard(last)
        if (now := mark(e)) == seen:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
    return spark.createDataFrame([], "node long, root long")


def spread(rows: DataFrame, node: str, comp: DataFrame, out: str) -> DataFrame:
    """Add ``out``: the root of ``node``, or node itself where it has no links."""
    return rows.join(comp.select(F.col("node").alias(node), F.col("root").alias("_root")), node, "left").withColumn(out, F.coalesce("_root", F.col(node))).drop("_root")

