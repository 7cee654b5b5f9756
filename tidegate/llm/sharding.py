"""Sharding as a minimax contiguous partition: the largest shard is as small as cuts of an ordered row of groups allow.

Groups are rows of equal text, which stay together. They stand in order of their texts' hashes, each at the bytes that
stand before it (``heads``). For a capacity, shards are filled greedily: from one cut the next is the last head that the
capacity reaches. The smallest capacity for which the shards suffice is found by binary search, and its greedy cuts are
the shards' bounds.

Heads are as many as there are texts, so the driver never gets them. It gets cells of their range, ``CELLS`` at most,
each with its first and last head. A cut that falls between these two lies within a known range, which bounds the
capacity from both sides; only cells that cuts can fall in are then asked for again, in finer cells, until every cut
falls on a known head. Each round narrows cells about three hundredfold, so five rounds do for 100 TB, whatever the
texts. The outcome is the same as with all heads at hand.

A group larger than an even share would set the capacity alone, and the rest would fill few shards up to it; so such
groups get a shard each, the largest first, and the others are partitioned over the shards that are left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.ordering import sorted_ranges
from tidegate.session import materialize, ship

#: cells that the driver holds in one round
CELLS = 1 << 16
KEY = ["h", "crc", "size"]


def text_key(text: Column) -> dict[str, Column]:
    """Hash, CRC-32 and size of a text; null is as empty. Texts that agree in all three are one group."""
    filled = F.coalesce(text.cast("string"), F.lit(""))
    return {"h": F.xxhash64(filled), "crc": F.crc32(filled.cast("binary")), "size": F.octet_length(filled).cast("long") + 1}


def _measure(batches):
    """Adds, to sorted rows of one partition: its number, the row's number, the bytes before it, and whether a group begins here."""
    part, rows, size, last = TaskContext.get().partitionId(), 0, 0, None
    for t in batches:
        n = t.num_rows
        if not n:
            continue
        key = np.stack([np.asarray(t.column(k)) for k in KEY])
        head = np.ones(n, bool)
        head[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        head[0] = last is None or bool((key[:, 0] != last).any())
        ends = size + np.cumsum(key[2])
        more = {"p": pa.array(np.full(n, part, np.int32)), "r": pa.array(rows + np.arange(n)), "s": pa.array(ends - key[2]), "head": pa.array(head)}
        rows, size, last = rows + n, int(ends[-1]), key[:, -1]
        yield pa.RecordBatch.from_arrays([*t.columns, *more.values()], [*t.schema.names, *more])


@dataclass
class Shards:
    """Where texts go: bounds and sizes of shards, of which there are few."""

    n: int
    #: keys of groups with a shard of their own, the largest first, each with its first row's rank and its number of rows
    alone: list[tuple[tuple, int, int]]
    #: of each further shard: the first key, and the number of rows before it that aren't alone; None for an empty shard
    first: list[tuple[tuple, int] | None]
    capacity: int

    def shard_of(self, text: Column) -> Column:
        """The shard of a text; needs no join."""
        return self._shard(text_key(text))

    def _shard(self, key: dict[str, Column]) -> Column:
        past = [F.when(~_before(key, f[0]), 1).otherwise(0) for f in self.first[1:] if f]
        out = F.lit(len(self.alone)) + (sum(past[1:], past[0]) if past else F.lit(0))
        for k in range(len(self.alone) - 1, -1, -1):
            out = F.when(_same(key, self.alone[k][0]), k).otherwise(out)
        return out.cast("int")


def _same(key: dict[str, Column], other: tuple) -> Column:
    return (key["h"] == other[0]) & (key["crc"] == other[1]) & (key["size"] == other[2])


def _before(key: dict[str, Column], other: tuple) -> Column:
    h, crc, size = (key[k] for k in KEY)
    return (h < other[0]) | ((h == other[0]) & ((crc < other[1]) | ((crc == other[1]) & (size < other[2]))))


class _Cells:
    """First and last heads of cells, in order. Between two cells there is no head."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, total: int):
        self.lo, self.hi, self.total = lo, hi, total

    def path(self, capacity: int, shards: int, far: bool) -> list[int]:
        """Ends of shards filled greedily, at their least, or (far) at their most, as far as the cells tell."""
        at, out = 0, []
        for _ in range(shards):
            reach = at + capacity
            if reach >= self.total:
                at = self.total
            else:
                i = int(np.searchsorted(self.lo, reach, "right")) - 1
                at = int(self.hi[i]) if self.hi[i] <= reach else reach if far else int(self.lo[i])
            out.append(at)
        return out

    def least(self, shards: int, far: bool) -> int:
        """The smallest capacity with which the shards suffice."""
        lo, hi = -(-self.total // shards), self.total
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.path(mid, shards, far)[-1] >= self.total else (mid + 1, hi)
        return lo


def minimax_cuts(ask: Callable[[list[tuple[int, int]], int], tuple[np.ndarray, np.ndarray]], total: int, shards: int, cells: int = CELLS) -> tuple[int, list[int]]:
    """The smallest capacity and the ends of its greedily filled shards, of groups in a row of ``total``.

    ``ask(ranges, width)``: the first and last heads of all cells of that width in these ranges that hold heads. Cuts
    can fall in ranges that grow with the square of the number of shards, so there are more cells than that.
    """
    cells = max(cells, 8 * shards * shards)
    ranges = [(0, total - 1)]
    found = _Cells(np.zeros(0, np.int64), np.zeros(0, np.int64), total)
    while True:
        width = max(1, -(-sum(b - a + 1 for a, b in ranges) // cells))
        keep = np.ones(len(found.lo), bool)
        for a, b in ranges:
            keep &= (found.hi < a) | (found.lo > b)
        lo, hi = (np.concatenate([old[keep], new]) for old, new in zip((found.lo, found.hi), ask(ranges, width), strict=True))
        turn = np.argsort(lo)
        found = _Cells(lo[turn], hi[turn], total)
        most, least = found.least(shards, False), found.least(shards, True)
        near, far = found.path(least, shards, False), found.path(most, shards, True)
        if most == least and near == far:
            return least, near
        ranges = []
        for a, b in zip(near, far, strict=True):  # the cells that a cut may fall in
            i, j = int(np.searchsorted(found.hi, a, "left")), int(np.searchsorted(found.lo, b, "right"))
            wide = [k for k in range(i, j) if found.lo[k] < found.hi[k]]
            if wide:
                a, b = int(found.lo[wide[0]]), int(found.hi[wide[-1]])
                if ranges and a <= ranges[-1][1]:
                    last = ranges.pop()
                    a, b = min(a, last[0]), max(b, last[1])
                ranges.append((a, b))


def cells_of(heads: DataFrame) -> Callable[[list[tuple[int, int]], int], tuple[np.ndarray, np.ndarray]]:
    """Answers ``minimax_cuts`` about ``heads`` (x long), by one aggregation for each question."""

    def ask(ranges, width):
        x, cell = F.col("x"), F.lit(None).cast("string")
        for k, (a, b) in enumerate(ranges):
            cell = F.when(x.between(a, b), F.concat_ws(":", F.lit(k), F.floor((x - a) / F.lit(width)))).otherwise(cell)
        got = heads.select("x", cell.alias("cell")).where("cell is not null").groupBy("cell").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).select("lo", "hi").toArrow()
        return np.asarray(got["lo"], np.int64), np.asarray(got["hi"], np.int64)

    return ask


def _measured(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, h, crc, size, p, r, s, head), written in order of their keys, and what stands before each of their partitions (p, rows, bytes, tail: the last key before it)."""
    ship(docs.sparkSession)
    flat = materialize(docs.select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in text_key(F.col(text_col)).items())))
    kind = dict(flat.dtypes)["id"]
    rows = materialize(sorted_ranges(flat, *KEY, "id").select("id", *KEY).mapInArrow(_measure, f"id {kind}, h long, crc long, size long, p int, r long, s long, head boolean"))
    part = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.max(F.struct("r", *KEY)).alias("tail"))
    past = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    return rows, materialize(part.select("p", *(F.coalesce(F.sum(c).over(past), F.lit(0)).alias(k) for k, c in (("rows", "n"), ("bytes", "b"))), F.lag("tail").over(Window.orderBy("p")).alias("tail")))


def _placed(rows: DataFrame, part: DataFrame) -> DataFrame:
    """With the row's rank and the bytes before it in the whole order; head now knows the partition before."""
    met = rows.join(part, "p")
    goes_on = (F.col("r") == 0) & F.coalesce(F.reduce(F.array(*(F.col(f"tail.{k}") == F.col(k) for k in KEY)), F.lit(True), lambda a, b: a & b), F.lit(False))
    return met.select("id", *KEY, (F.col("rows") + F.col("r")).alias("rank"), (F.col("bytes") + F.col("s")).alias("x"), (F.col("head") & ~goes_on).alias("head"))


def _less(df: DataFrame, name: str, alone: list[tuple[tuple, int]]) -> Column:
    """A rank or place without what groups with shards of their own put before it."""
    key = {k: F.col(k) for k in KEY}
    out = F.col(name)
    for group, amount in alone:
        out = out - F.when(_before(key, group) | _same(key, group), 0).otherwise(amount)
    return out


def shard(docs: DataFrame, n: int = 16, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> tuple[DataFrame, Shards]:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``, and the plan that says where a text goes.

    size: the text's UTF-8 bytes and one. law is `bytes`, grown_shard null. Equal texts share a shard; a null text is as
    an empty one. slot numbers a shard's rows from 0, in order of their texts' keys, then ids (null first); rows that
    are equal in all that take either's place. With fewer groups than shards, shards stay empty. An empty table gives no
    rows. Other columns aren't read.
    """
    rows, part = _measured(docs, id_col, text_col)
    total = rows.agg(F.sum("size")).first()[0] or 0
    every = _placed(rows, part)
    large = rows.groupBy(*KEY).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).orderBy(F.desc("bytes"), *KEY).limit(n).collect()
    alone, left = [], total
    for g in large[: n - 1]:
        if g["bytes"] * (n - len(alone)) <= left:
            break
        alone.append(g)
        left -= g["bytes"]
    keys = [tuple(g[k] for k in KEY) for g in alone]
    own, x, rank = {k: F.col(k) for k in KEY}, _less(every, "x", [(k, g["bytes"]) for k, g in zip(keys, alone, strict=True)]), _less(every, "rank", [(k, g["rows"]) for k, g in zip(keys, alone, strict=True)])
    others = F.lit(True)
    for k in keys:
        others &= ~_same(own, k)
    starts = {}
    heads = every.where("head")
    if keys:
        starts = {tuple(r[k] for k in KEY): r["rank"] for r in heads.where(~others).select(*KEY, "rank").collect()}
    plan = Shards(n, [(k, starts[k], g["rows"]) for k, g in zip(keys, alone, strict=True)], [None] * (n - len(keys)), 0)
    if left:
        rest = heads.where(others).select(*KEY, x.alias("x"), rank.alias("rank"))
        plan.capacity, ends = minimax_cuts(cells_of(rest.select("x")), left, n - len(keys), cells)
        cuts = [0, *ends[:-1]]
        at = {r["x"]: (tuple(r[k] for k in KEY), r["rank"]) for r in rest.where(F.col("x").isin(*cuts)).collect()}
        plan.first = [at.get(c) if c < left and c not in cuts[:k] else None for k, c in enumerate(cuts)]
    where = plan._shard(own)
    befores = F.array(*(F.lit(v).cast("long") for v in [s for _, s, _ in plan.alone] + [f[1] if f else 0 for f in plan.first]))
    slot = F.when(F.col("shard") < len(keys), F.col("rank")).otherwise(rank) - F.get(befores, F.col("shard"))
    out = every.withColumn("shard", where).withColumn("slot", slot)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")), plan


def write_shards(docs: DataFrame, plan: Shards, path: str, files: int = 1, text_col: str = "text") -> None:
    """Writes ``docs`` as Parquet, a folder ``_shard=k`` for each shard with about ``files`` files each. Rows are dealt over the files by row."""
    out = docs.withColumn("_shard", plan.shard_of(F.col(text_col)))
    out.repartition(plan.n * files, "_shard", F.pmod(F.monotonically_increasing_id(), F.lit(files))).write.partitionBy("_shard").parquet(path)
