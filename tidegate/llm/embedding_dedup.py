"""Near-duplicate embeddings by PCA-ordered, tiled comparison.

Unit vectors are rotated to the principal axes of all vectors, so leading coordinates carry most of a product. Vectors
at an angle within the threshold lie within a fixed distance of each other on every axis: a grid of that width over some
leading axes needs comparing cell by cell with itself and its neighbours only, which are found axis by axis. The number of those axes grows with the
largest label (``grid_axes``), so that cells hold about a tile's vectors at any size, and a vector goes to its
neighbouring cells and not to its whole label. Cells are cut into tiles of bounded size, and pairs of tiles are compared:
products of leading coordinates are accumulated first, the rest is bounded by the norms of what is left (Cauchy-Schwarz),
and pairs that can't reach the threshold are dropped. What is left is decided in double precision on the vectors as
given. Equal vectors are one class with a count from the start, and a pair of tiles gives one row for each class: its
number of links and its tree in a spanning forest. So copies never become rows for pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.components import components, local_forest, spread
from tidegate.llm.text import tidy
from tidegate.session import materialize, ship

STEPS = (8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096)


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of lists of one length."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1)


def _moments(batches):
    """Second moments of the unit vectors, for each number of dimensions."""
    for t in batches:
        n = np.asarray(t.column(1))
        for d in np.unique(n):
            x = _matrix(t.column(0).filter(pa.array(n == d)))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            m = (x.T @ x).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d), pa.int32()), pa.array(np.arange(d * d), pa.int32()), pa.array(m)], ["d", "k", "m"])


def axes(unit: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes (columns, the largest first) for each number of dimensions. The driver gets their square in numbers."""
    t = unit.select("v", "d").mapInArrow(_moments, "d int, k int, m double").groupBy("d", "k").agg(F.sum("m").alias("m")).toArrow()
    d, k, m = (np.asarray(t[c]) for c in ("d", "k", "m"))
    out = {}
    for n in np.unique(d):
        own = d == n
        square = np.zeros(n * n)
        square[k[own]] = m[own]
        square = square.reshape(n, n)
        out[int(n)] = np.linalg.eigh((square + square.T) / 2)[1][:, ::-1]
    return out


def linked_pairs(a: np.ndarray, b: np.ndarray, rotate: np.ndarray, threshold: float, portion: int = 1 << 15):
    """Yields (rows of a, rows of b) whose cosine is at least ``threshold``."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ra, rb = (a / na[:, None]) @ rotate, (b / nb[:, None]) @ rotate
    dim = a.shape[1]
    cuts = [*(s for s in STEPS if s < dim), dim]
    left = lambda x, s: np.sqrt(np.maximum((x[:, s:] ** 2).sum(axis=1), 0))
    slack = threshold - 1e-9
    s = cuts[0]
    dot = ra[:, :s] @ rb[:, :s].T
    i, j = np.nonzero(dot + left(ra, s)[:, None] * left(rb, s)[None, :] >= slack)
    part = dot[i, j]
    rest = {s: (left(ra, s), left(rb, s)) for s in cuts[1:]}
    for at in range(0, len(i), portion):
        x, y, p = i[at : at + portion], j[at : at + portion], part[at : at + portion]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            p = p + np.einsum("ij,ij->i", ra[x, lo:hi], rb[y, lo:hi])
            ok = p + rest[hi][0][x] * rest[hi][1][y] >= slack
            x, y, p = x[ok], y[ok], p[ok]
        ok = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
        yield x[ok], y[ok]


def grid_axes(largest: int, tile: int) -> int:
    """Leading axes of the grid: each divides a label into about four cells that hold most of it. The result is the same for any number."""
    return 1 + max(0, int(math.log(max(1, largest / tile), 4)))


def neighbours(cells: DataFrame, axes: int) -> DataFrame:
    """(label, d, cell, other) of cells (label, d, cell) that lie at most one apart on each of ``axes`` axes, the lesser one first.

    Pairs of beginnings of cells grow by one axis at a time, each beginning to those that there are: the work follows
    the pairs that exist, and not the 3 ** axes places around a cell. Rounds are joins on beginnings.
    """
    pairs = cells.select("label", "d").distinct().select("label", "d", F.array().cast("array<int>").alias("cell"), F.array().cast("array<int>").alias("other"))
    for k in range(1, axes + 1):
        begun = cells.select("label", "d", F.slice("cell", 1, k).alias("_to")).distinct()
        mine = begun.select("label", "d", F.slice("_to", 1, k - 1).alias("cell"), F.element_at("_to", -1).alias("_x"))
        ahead = pairs.join(mine, ["label", "d", "cell"]).withColumn("_y", F.explode(F.array(*(F.col("_x") + s for s in (-1, 0, 1)))))
        grown = ahead.where((F.col("cell") < F.col("other")) | (F.col("_x") <= F.col("_y")))  # of equal beginnings the lesser stays first
        grown = grown.select("label", "d", F.concat("cell", F.array("_x")).alias("cell"), F.concat("other", F.array("_y")).alias("_to"))
        pairs = grown.join(begun, ["label", "d", "_to"]).withColumnRenamed("_to", "other")
    return pairs.where("cell <> other").select("label", "d", "cell", "other")


def _compare(turn: dict[int, np.ndarray], threshold: float):
    def compare(t: pa.Table) -> pa.Table:
        node, count, side = (np.asarray(t[c]) for c in ("node", "copies", "side"))
        v = _matrix(t["v"])
        rotate = turn[v.shape[1]]
        same = t["lo"][0].as_py() == t["hi"][0].as_py()
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        degree = np.zeros(len(node), np.int64)
        us, vs = [], []
        for x, y in linked_pairs(v[one], v[two], rotate, threshold):
            x, y = one[x], two[y]
            if same:
                x, y = x[x < y], y[x < y]
            np.add.at(degree, x, count[y])
            np.add.at(degree, y, count[x])
            for f in local_forest(node[x].tolist(), node[y].tolist()):
                us.append(f[0])
                vs.append(f[1])
        root = dict(local_forest(us, vs))
        own = np.flatnonzero(degree > 0)
        return pa.table({"node": pa.array(node[own]), "links": pa.array(degree[own]), "root": pa.array([root.get(n, n) for n in node[own].tolist()], pa.int64())})

    return compare


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tile: int = 1024) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of ``vectors``.

    Rows link when their labels are equal and not null, their vectors have equal numbers of dimensions, and the cosine
    in double precision is at least ``threshold`` (over 0). Vectors that are null, empty, zero, or hold a null or
    non-finite component link with nothing. n_links counts other rows linked directly; component_id is the least id
    that links reach, itself included; kept: it is the row's own id. Rows with equal ids are different rows with links
    of their own; a null id takes part in links (its component_id is null only if no id is in reach). An empty table
    gives an empty result. Other columns aren't read. Ids are
    integers or null.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    # sizes that a square would overflow or lose are scaled first; a cosine doesn't change
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = rows.withColumn("node", F.when(fine, F.xxhash64("label", "v")))
    classes = materialize(rows.where("node is not null").groupBy("node", "label").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")).withColumn("v", F.when((top > 1e100) | (top < 1e-100), F.transform("v", lambda x: x / top)).otherwise(F.col("v"))).withColumn("d", F.size("v")))
    turn = axes(classes)
    width = math.sqrt(2 - 2 * threshold) + 1e-6
    sent = vectors.sparkSession.sparkContext.broadcast(turn)  # a square of the dimensions

    largest = classes.groupBy("label", "d").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    m = grid_axes(largest, tile)

    def cells(batches):
        for t in batches:
            n = np.asarray(t.column(4))
            at = np.zeros((len(n), m), np.int32)
            for d in np.unique(n):
                x = _matrix(t.column(2).filter(pa.array(n == d)))
                lead = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ sent.value[int(d)][:, :m]
                at[n == d, : lead.shape[1]] = np.floor(lead / width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * m), pa.array(at.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(t.column(i) for i in range(5)), lists], ["node", "label", "v", "copies", "d", "cell"])

    kind, key = dict(classes.dtypes)["label"], ["label", "d", "cell"]
    placed = classes.select("node", "label", "v", "copies", "d").mapInArrow(cells, f"node long, label {kind}, v array<double>, copies long, d int, cell array<int>")
    units = materialize(placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("k")))
    # of two neighbouring cells the lesser one names the pair
    near = neighbours(units.select(*key), m)
    pairs = units.join(near, key).join(units.select("label", "d", F.col("cell").alias("other"), F.col("k").alias("other_k")), ["label", "d", "other"])
    where = F.concat_ws("|", F.array_join("cell", ","), F.array_join("other", ","))
    own = units.select(*key, "k", F.col("k").alias("others"), F.array_join("cell", ",").alias("at"), F.lit(None).cast("int").alias("side"))
    first = pairs.select(*key, "k", F.col("other_k").alias("others"), where.alias("at"), F.lit(0).alias("side"))
    second = pairs.select("label", "d", F.col("other").alias("cell"), F.col("other_k").alias("k"), F.col("k").alias("others"), where.alias("at"), F.lit(1).alias("side"))
    tiled = placed.join(own.unionByName(first).unionByName(second), key).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("o", F.explode(F.expr("sequence(0, others - 1)")))
    lo, hi = F.when(F.col("side").isNull(), F.least("tile", "o")).when(F.col("side") == 0, F.col("tile")).otherwise(F.col("o")), F.when(F.col("side").isNull(), F.greatest("tile", "o")).when(F.col("side") == 0, F.col("o")).otherwise(F.col("tile"))
    far = F.when(F.col("side").isNull(), "s").otherwise("n")
    met = tiled.select("node", "label", "d", "v", "copies", "at", F.concat(F.lit("s"), lo).alias("lo"), F.concat(far, hi).alias("hi"), F.coalesce("side", F.when(F.col("tile") <= F.col("o"), 0).otherwise(1)).alias("side"))
    found = materialize(met.groupBy("label", "d", "at", "lo", "hi").applyInArrow(tidy(_compare(turn, threshold)), "node long, links long, root long"))
    comp = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    direct = found.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = spread(classes.select("node", "copies", "least"), "node", comp, "root").join(direct, "node", "left")
    ids = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("id", "node").join(ids, "node", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").cast("long").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
