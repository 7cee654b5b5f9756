"""N-gram Jaccard join: size-aware heavy-light join over sets of word shingles, with exact links and components.

Light sets (at most ``light_boundary`` shingles) enumerate the fixed-size subsets that a partner would have to share, and
rows meet on a subset's key: such a meeting is a link by itself. Heavy sets scan inverted lists, but only those of the
rarest shingles that any partner must share in part (the whole corpus is counted, by a block exchange). The boundary is
the size up to which enumeration costs no more than a scan.

A list is scanned with each set's size and sketch (how many of its shingles fall into each of some cells of hash space):
the overlap of two sets is at most the sum of the lesser counts, so most pairs that share a rare shingle by chance fall
out here, and a passage that many rows share makes no cluster of them. What is left forms clusters, whose sets are then
compared whole: their inverted lists are the columns of incidence matrices, and products of these count overlaps.

Lists and clusters are both dealt into tiles of bounded size (``tiled_forest``): a tile gives back a spanning forest
only, and two tiles meet only if their sets aren't yet known to be connected. So copies and near copies never become
rows for pairs, groups of them cost what their number is, and no link is lost.

Equal sets are one class from the start. Shingles are compared by 64-bit hashes and sets by 64-bit sums of mixed hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm import blocks as B
from tidegate.llm import text as X
from tidegate.llm.components import components, local_forest, spread
from tidegate.session import discard, materialize, ship

U = np.uint64
ROWS = "id long, n long, cls long, toks array<long>, lkeys array<long>, lcs array<int>, sketch binary, shingles binary"
LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
#: cells of a sketch, by whether the set has ``MANY`` shingles; the first must divide the second
CELLS, FINE_CELLS, MANY = 64, 256, 512
#: sets beyond this size aren't judged by sketches, whose cells hold 16 bits
UNSKETCHED = 1 << 20


def need(a: int, b: int, pct: int) -> int:
    """Least overlap with which sets of sizes a and b reach pct / 100."""
    return -(-pct * (a + b) // (100 + pct))


def overlaps(a: int, pct: int) -> list[int]:
    """Overlaps that a set of size a may need with a partner, by size of the partner."""
    sizes = range(-(-pct * a // 100), 100 * a // pct + 1)
    return sorted({c for b in sizes if (c := need(a, b, pct)) <= min(a, b)})


def subsets(a: int, pct: int) -> int:
    return sum(comb(a, c) for c in overlaps(a, pct))


def light_boundary(pct: int, list_cost: float = 8.0) -> int:
    """Largest size for which enumerating subsets costs no more than scanning inverted lists and comparing.

    A scan costs ``list_cost`` for each of the rarest shingles it has to look up, and a comparison costs the size.
    """
    for a in count(1):
        if subsets(a, pct) > list_cost * (a - -(-pct * a // 100) + 1) + a:
            return a - 1


def shingle_hashes(t: pa.Table, width: int):
    """Yields (row, sorted distinct shingle hashes) for each row with words, in order of rows."""
    data, off = X.column_bytes(t["text"])
    mult = X.mix(np.arange(1, width + 1).astype(U))
    for a, b in X.pieces(off):
        o = off[a : b + 1] - off[a]
        h, at = X.space_words(data[off[a] : off[b]], o)
        n = len(h)
        if n >= width:
            s = np.zeros(n - width + 1, U)
            for k in range(width):
                s += h[k : n - width + 1 + k] * (mult[k] | U(1))
            s = X.mix(s)
        for r in range(b - a):
            i, j = at[r], at[r + 1]
            if j - i >= width:
                yield a + r, np.unique(s[i : j - width + 1])
            elif j > i:
                yield a + r, X.mix(np.array([sum(int(x) * int(m | U(1)) for x, m in zip(h[i:j], mult, strict=False)) + 0x5BD1E995 * int(j - i) & (1 << 64) - 1], U))


def class_of(s: np.ndarray) -> tuple[int, np.ndarray]:
    m = X.mix(s ^ U(0xA5A5A5A55A5A5A5A))
    return m.sum(dtype=U), m


def _make(width: int, buckets: int):
    def make(t: pa.Table) -> pa.Table:
        sets = [s for _, s in shingle_hashes(t, width)]
        keys, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, U), np.zeros(0, np.int64))
        return B.sent_rows(t["block"][0].as_py(), [(0, keys, counts)], buckets)

    return make


def _subset_keys(s: np.ndarray, m: np.ndarray, c: int) -> np.ndarray:
    """Hashes of all subsets of ``c`` elements, from the mixed hashes ``m`` of a set."""
    gone = np.zeros(1, U)
    last = np.full(1, -1)
    for _ in range(len(m) - c):  # leave out one more element, after the last left out
        gone = np.concatenate([g + m[k + 1 :] for g, k in zip(gone, last, strict=True)])
        last = np.concatenate([np.arange(k + 1, len(m)) for k in last])
    return m.sum(dtype=U) - gone


def rarity(df: np.ndarray) -> np.ndarray:
    """Document counts in eight bits, in their order: as they are up to 31, then five steps for each doubling."""
    return np.where(df < 32, df, 32 + np.floor(5 * np.log2(np.maximum(df, 32) / 32))).astype(U)


def sketch(s: np.ndarray) -> bytes:
    """Shingles in each cell of hash space."""
    if len(s) > UNSKETCHED:
        return np.full(FINE_CELLS, 0xFFFF, np.uint16).tobytes()
    cells = FINE_CELLS if len(s) >= MANY else CELLS
    return np.bincount((X.mix(s) >> U(40)).astype(np.int64) % cells, minlength=cells).astype(np.uint16).tobytes()


def _rows(width: int, pct: int, light: int):
    """Each row's class, and for the first row of a class in its block: light keys, or the shingles by which lists are scanned."""

    def rows(t: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("id", "n", "cls", "toks", "lkeys", "lcs", "sketch", "shingles")}
        ids = t["id"].to_pylist()
        found = dict(shingle_hashes(t, width))
        df = np.zeros(0, np.int64)
        if found:
            _, place = np.unique(np.concatenate(list(found.values())), return_inverse=True)
            df = B.answer(replies, 0)[place]
        at, kept = 0, set()
        for r, ident in enumerate(ids):
            s = found.get(r)
            toks = lkeys = lcs = cells = packed = cls = None
            n = 0
            if s is not None:
                n = len(s)
                d = rarity(df[at : at + n])
                at += n
                total, m = class_of(s)
                cls = int(total.view(np.int64))
                if cls not in kept:
                    kept.add(cls)
                    if n <= light:
                        keys = [(c, _subset_keys(s, m, c)) for c in overlaps(n, pct)]
                        lkeys = X.signed(X.mix(np.concatenate([k + U(c) for c, k in keys]))).tolist()
                        lcs = np.repeat([c for c, _ in keys], [len(k) for _, k in keys]).tolist()
                    if n * 100 >= (light + 1) * pct:
                        order = np.sort((d << U(56)) | (s >> U(8)))[: n - -(-pct * n // 100) + 1]
                        toks = X.signed(order[order >> U(56) > 1]).tolist() or None
                        if toks:
                            cells, packed = sketch(s), B.pack_keys(s)
            for k, v in zip(out, (ident, n, cls, toks, lkeys, lcs, cells, packed), strict=True):
                out[k].append(v)
        return pa.table(out, pa.schema([("id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("toks", pa.list_(pa.int64())), ("lkeys", pa.list_(pa.int64())), ("lcs", pa.list_(pa.int32())), ("sketch", pa.binary()), ("shingles", pa.binary())]))

    return rows


# ---- comparing groups ----------------------------------------------------------------------------------------------
def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in runs of equal ``g`` (rows come sorted by it), no run cut, with the offsets of the runs."""
    rest: list[pa.RecordBatch] = []

    def cut(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        g = np.asarray(t["g"])
        return t, np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])

    for b in batches:
        if not b.num_rows:
            continue
        g = np.asarray(b["g"])
        last = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
        if last or (rest and rest[-1]["g"][-1].as_py() != g[0]):
            done = [*rest, *([b.slice(0, last)] if last else [])]
            yield cut(done)
            rest = []
        rest.append(b.slice(last))
    if rest:
        yield cut(rest)


def _links(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v = (np.concatenate([x[i] for x in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=LINKS)


def _sketches(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Coarse cells of every sketch, and the fine ones of those that have them (rows of zeros else)."""
    raw = [np.frombuffer(x.as_py(), np.uint16) for x in column]
    fine = np.zeros((len(raw), FINE_CELLS), np.uint16)
    coarse = np.zeros((len(raw), CELLS), np.int64)
    for i, x in enumerate(raw):
        coarse[i] = x if len(x) == CELLS else x.reshape(-1, CELLS).sum(0, dtype=np.int64)  # a fine cell's remainder is its coarse cell
        if len(x) == FINE_CELLS:
            fine[i] = x
    return coarse, fine


def _may_link(pct: int):
    """Forests of the pairs in each tile of a list that sizes and sketches leave possible."""

    def reach(n, coarse, fine, i, j):
        a, b = n[i], n[j]
        least = (pct * (a + b) + 99 + pct) // (100 + pct)
        most = np.minimum(coarse[i], coarse[j]).sum(-1)
        both = (np.minimum(a, b) >= MANY) & np.ones(np.shape(most), bool)
        if both.any():
            most = np.where(both, np.minimum(most, np.minimum(fine[i], fine[j]).sum(-1, dtype=np.int64)), most)
        return (np.minimum(a, b) * 100 >= np.maximum(a, b) * pct) & ((most >= least) | (np.minimum(a, b) > UNSKETCHED))

    def run(batches):
        for t, at in whole_groups(batches):
            cls, n = np.asarray(t["cls"]), np.asarray(t["n"])
            coarse, fine = _sketches(t["sketch"])
            size = np.diff(at)
            i = at[:-1][size == 2]
            ok = reach(n, coarse, fine, i, i + 1) if len(i) else np.zeros(0, bool)
            out = [(cls[i[ok]], cls[i[ok] + 1])]
            for a, b in zip(at[:-1][size > 2], at[1:][size > 2], strict=True):
                comp = np.arange(b - a)
                for k in range(b - a - 1):
                    other = np.flatnonzero(comp != comp[k])
                    other = other[other > k]
                    if len(other) and len(hit := other[reach(n, coarse, fine, a + k, a + other)]):
                        comp[np.isin(comp, comp[hit])] = comp[k]
                        out.append((np.full(len(hit), cls[a + k]), cls[a + hit]))
            yield _links(out)
            X.release()

    return run


def _forest_of(pct: int, cls: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among some sets: overlaps are counted on their inverted lists."""
    cls, first = np.unique(cls, return_index=True)
    sets = [B.unpack_keys(raw[i]) for i in first]
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[place] > 1
    col, row = place[shared], row[shared]
    by = np.argsort(col, kind="stable")
    col, row = col[by], row[by]
    col = np.concatenate([[0], np.cumsum(col[1:] != col[:-1])]) if len(col) else col
    both = np.zeros((len(sets), len(sets)), np.float32)
    wide = 64 if len(sets) < 64 else 2048
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, wide):
        i, j = np.searchsorted(col, [c, c + wide])
        m = np.zeros((len(sets), wide), np.float32)
        m[row[i:j], col[i:j] - c] = 1
        both += m @ m.T
    linked = both.astype(np.int64) * (100 + pct) >= pct * (size[:, None] + size[None, :])
    i, j = np.nonzero(np.triu(linked, 1))
    f = local_forest(cls[i].tolist(), cls[j].tolist())
    return np.array([x for x, _ in f], np.int64), np.array([y for _, y in f], np.int64)


def _do_link(pct: int):
    """Forests of the links in each tile of a cluster."""

    def run(batches):
        for t, at in whole_groups(batches):
            cls, out = np.asarray(t["cls"]), []
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b - a > 1:
                    out.append(_forest_of(pct, cls[a:b], t["shingles"].slice(a, b - a).to_pylist()))
            yield _links(out)
            X.release()

    return run


def tiled_forest(members: DataFrame, carried: DataFrame, compare: Callable, most: int, most_bytes: int) -> DataFrame:
    """(u, v): a spanning forest, for each group, of the pairs that ``compare`` finds.

    ``members`` (grp, cls, rank, bytes): the sets of each group. ``carried`` (cls, …): what ``compare`` needs of a set; it
    sees the rows of one tile, or of two, under one value of ``g``. A group of more than ``most`` members or ``most_bytes``
    is dealt into tiles. Its member of the highest rank is in all of them, so sets that all link with it are connected
    after one pass; two tiles meet in a second pass only where their members aren't all connected.
    """
    found = "u long, v long"
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"), F.max_by("cls", F.struct("rank", "cls")).alias("hub")).where("size > 1")
    tiles = sizes.select("grp", "hub", F.greatest(F.ceil(F.col("size") / most), F.ceil(F.col("bytes") / most_bytes)).cast("int").alias("k"))
    placed = members.select("grp", "cls").join(tiles, "grp").withColumn("tile", F.pmod(F.xxhash64("cls", "grp"), F.col("k")).cast("int"))
    placed = materialize(placed)

    def compared(rows: DataFrame) -> DataFrame:
        full = rows.join(carried, "cls")
        return materialize(full.repartition("g").sortWithinPartitions("g").mapInArrow(compare, found))

    hubs = placed.where("k > 1 and cls = hub").select("grp", "cls", "tile", F.explode(F.expr("sequence(0, k - 1)")).alias("at")).where("at <> tile")
    links = compared(placed.select(F.xxhash64("grp", "tile").alias("g"), "cls").unionByName(hubs.select(F.xxhash64("grp", "at").alias("g"), "cls")))
    several = placed.where("k > 1")
    if several.isEmpty():
        return links
    state = spread(several, "cls", components(links), "comp").groupBy("grp", "tile").agg(F.min("comp").alias("lo_c"), F.max("comp").alias("hi_c"))
    state = materialize(state)
    other = state.select("grp", F.col("tile").alias("other"), F.col("lo_c").alias("lo_o"), F.col("hi_c").alias("hi_o"))
    open_pairs = state.join(other, "grp").where("tile < other and not (lo_c = hi_c and lo_o = hi_o and lo_c = lo_o)")
    pairs = open_pairs.select("grp", F.xxhash64("grp", "tile", "other").alias("g"), F.explode(F.array("tile", "other")).alias("tile"))
    return links.unionByName(compared(several.join(pairs, ["grp", "tile"]).select("g", "cls")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, pct: int = 80, block_bytes: int = 6 << 20, tile: int = 1024, tile_bytes: int = 8 << 20) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of ``docs``.

    Rows link when 100 * intersection >= pct * union of their sets of distinct ``width``-word shingles (A-Z lower-cased,
    words divided by ASCII white space; a text of fewer words is one shingle). component_id is the least id that links
    reach, itself included. Null or empty text and text without words: n_shingles 0, linked with nothing. Repeated rows
    and equal ids give one row each; a null id takes part in links, and is its own component only if all ids there are
    null. Ties don't matter: a component's id is a minimum. An empty table gives an empty result. Ids are integers.
    Other columns, whatever their names, are not read.
    """
    ship(docs.sparkSession)
    n = B.block_count(docs, text_col, block_bytes)
    blocks = B.blocked(docs, id_col, text_col, n)
    light = light_boundary(pct)
    replies = B.reply(B.send(blocks, _make(width, n)))
    rows = materialize(B.finish(blocks, replies, _rows(width, pct, light), ROWS))

    # light: everything that shares a subset large enough links with the smallest set that has it
    keyed = rows.where("lkeys is not null").select("cls", "n", F.explode(F.arrays_zip("lkeys", "lcs")).alias("x")).select("cls", "n", F.col("x.lkeys").alias("key"), F.col("x.lcs").alias("c")).distinct()
    first = keyed.groupBy("key").agg(F.min(F.struct("n", "cls")).alias("f"), F.count(F.lit(1)).alias("k")).where("k > 1")
    fits = (F.col("c") * (100 + pct) >= pct * (F.col("n") + F.col("f.n"))) & (F.col("cls") != F.col("f.cls"))
    links = keyed.join(first, "key").where(fits).select(F.col("cls").alias("u"), F.col("f.cls").alias("v"))

    # heavy: scan the inverted lists of rare shingles, then compare what may link
    heavy = materialize(rows.where("toks is not null").select("cls", "n", "toks", "sketch").dropDuplicates(["cls"]))
    lists = heavy.select(F.explode("toks").alias("grp"), "cls", F.xxhash64("cls").alias("rank"), F.octet_length("sketch").cast("long").alias("bytes"))
    near = tiled_forest(lists, heavy.select("cls", "n", "sketch"), _may_link(pct), 2 * tile, tile_bytes)
    clusters = materialize(components(near).join(heavy.select(F.col("cls").alias("node"), F.size("toks").alias("rank"), (8 * F.col("n")).alias("bytes")), "node"))
    # only the sets of clusters are moved; a class that several blocks hold comes once
    sets = rows.where("shingles is not null").select("cls", "shingles").join(clusters.select(F.col("node").alias("cls")), "cls", "left_semi").dropDuplicates(["cls"])
    met = tiled_forest(clusters.select(F.col("root").alias("grp"), F.col("node").alias("cls"), "rank", "bytes"), sets, _do_link(pct), tile, tile_bytes)
    discard(clusters)
    discard(heavy)

    comp = components(links.unionByName(met))
    labelled = spread(rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least")), "cls", comp, "root")
    ids = labelled.join(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "component_id")
    return rows.join(ids, "cls", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, pct: int = 80, **options) -> DataFrame:
    """Exactly one row of ``docs`` for each component, and every row without words.

    Rows are told apart by id and text, and rows equal in both by a row number. The row with the least id stays, null
    ids last; of equal ids the one with the least key. Rows that only their other columns tell apart are ordered by a
    hash of these. Only texts of rows that repeat both id and text are shuffled.
    """
    names = {c.lower() for c in docs.columns}
    free = lambda name: name if name not in names else free(name + "_")
    key, num = free("_row_key"), free("_row_number")
    rows = docs.withColumn(key, F.xxhash64(id_col, text_col))
    found = materialize(jaccard_components(rows, key, text_col, width, pct, **options).where("n_shingles > 0").groupBy(key).agg(F.min("component_id").alias("comp"), F.count(F.lit(1)).alias("copies")))
    several = found.join(found.groupBy("comp").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "comp").select(key, "comp")
    ids = rows.select(key, F.col(id_col).alias("id")).distinct()
    best = several.join(ids, key).groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col(key).alias("stays"))).alias("best"))
    gone = materialize(several.join(best, "comp").where(F.col(key) != F.col("best.stays")).select(key))  # of known size: broadcast if small
    left = rows.join(gone, key, "left_anti")
    again = materialize(found.where("copies > 1").select(key))
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    one = Window.partitionBy(key).orderBy(F.xxhash64(*plain))
    repeated = left.join(again, key, "left_semi").withColumn(num, F.row_number().over(one)).where(F.col(num) == 1).drop(num)
    return left.join(again, key, "left_anti").unionByName(repeated).select(*docs.columns)
