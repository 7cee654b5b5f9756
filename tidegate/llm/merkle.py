"""Merkle manifest of a dataset: a tree of hashes for each group of rows, and one over the groups' roots.

Every ``FANOUT`` consecutive nodes are the children of one. A slot pivot makes a parent's row: conditional aggregates
spread its children into FANOUT columns. The columns in a row, concatenated, hash to the parent; the columns but the own
one are a child's siblings. So a level is one grouped aggregate over the level below, a sixteenth of its size, and
proofs come back down by one equi-join for each level, on keys of which each side has one row.

Places of leaves come from ``ordering.placed``: no group, however large, is sorted in one task. Every level is written
(``materialize``) before the next reads it. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.ordering import placed
from tidegate.session import materialize

FANOUT = 16
SLOTS = [f"s{k}" for k in range(FANOUT)]
STEP = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of strings, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """`-` for null, else the value's number of UTF-8 bytes, a colon and the value: no two rows of values read alike."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


@dataclass
class Manifest:
    #: rows as slots of their parents: (tree, parent, n, s0..s15 of struct<id, leaf, claim>)
    rows: DataFrame
    #: (tree, parent, n, s0..s15) of the levels above, the lowest first
    levels: list[DataFrame]
    #: (tree, subroot, top): each tree's root, and the level at which it stands alone
    tops: DataFrame
    #: levels of the tree over the subroots
    upper: list[DataFrame]
    #: places of subroots: (tree, subroot, top, pos)
    order: DataFrame
    #: None if there are no rows
    root: str | None


def _pivot(nodes: DataFrame, value: Column) -> DataFrame:
    slot = F.col("pos") % FANOUT
    spread = (F.max(F.when(slot == k, value)).alias(s) for k, s in enumerate(SLOTS))
    return nodes.groupBy("tree", F.floor(F.col("pos") / FANOUT).alias("parent")).agg(F.max("n").alias("n"), *spread)


def _hash(slots: list[Column]) -> Column:
    return digest(*(F.coalesce(s, F.lit("")) for s in slots))


def _above(level: DataFrame, slots: list[Column]) -> DataFrame:
    """The nodes (tree, pos, n, digest) that a level's rows are. A lone leaf is itself."""
    return level.select("tree", F.col("parent").alias("pos"), F.ceil(F.col("n") / FANOUT).alias("n"), F.when(F.col("n") == 1, slots[0]).otherwise(_hash(slots)).alias("digest"))


def _grow(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels over ``nodes`` (tree, pos, n, digest), of which a tree has ``most`` at most, and the trees' roots (tree, subroot, top)."""
    levels, tops = [], []
    while True:
        tops.append(nodes.where("n = 1").select("tree", F.col("digest").alias("subroot"), F.lit(len(levels)).alias("top")))
        if most <= 1:
            return levels, reduce(DataFrame.unionByName, tops)
        levels.append(materialize(_pivot(nodes.where("n > 1"), F.col("digest"))))
        nodes, most = _above(levels[-1], [F.col(s) for s in SLOTS]), -(-most // FANOUT)


def build(rows: DataFrame, group: str, order: str, leaf_col: str, claim: str) -> Manifest:
    """Manifest of ``rows``: a tree for each ``group``, whose leaves ascend by ``order``, null first, then by leaf.

    ``claim``: another leaf, or null, that ``proofs`` folds in place of the row's own. Groups ascend by their UTF-8
    bytes, null first.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # never null, in the same order
    flat = materialize(rows.select(tree.alias("tree"), F.col(order).alias("id"), F.col(leaf_col).alias("leaf"), F.when(F.col(claim) != F.col(leaf_col), F.col(claim)).alias("claim")))
    low = materialize(_pivot(placed(flat, "tree", "id", "leaf"), F.struct("id", "leaf", "claim")))
    most = low.agg(F.max("n")).first()[0]
    levels, tops = _grow(_above(low, [F.col(f"{s}.leaf") for s in SLOTS]), -(-(most or 1) // FANOUT))
    tops = materialize(tops)
    ranked = materialize(placed(tops.withColumn("one", F.lit(0)), "one", "tree"))
    upper, roots = _grow(ranked.select(F.lit("").alias("tree"), "pos", "n", F.col("subroot").alias("digest")), ranked.count())
    top = roots.first()
    return Manifest(low, levels, tops, upper, ranked.select("tree", "subroot", "top", "pos"), top["subroot"] if top else None)


def _siblings(values: list[Column], k: int) -> Column:
    """What stands left and right of slot k, and k."""
    side = lambda some: F.concat(*(F.coalesce(v, F.lit("")) for v in some)) if some else F.lit("")
    return F.struct(side(values[:k]).alias("left"), side(values[k + 1 :]).alias("right"))


def _children(level: DataFrame, values: list[Column], parents: DataFrame) -> DataFrame:
    """One row for each child of ``level``: parents (tree, pos, subroot, path) with pos and path of the child, and slot, what the column holds."""
    met = level.withColumnRenamed("parent", "pos").join(parents, ["tree", "pos"])
    own = (F.when(F.col(s).isNotNull(), F.struct((F.col("pos") * FANOUT + k).alias("pos"), F.col(s).alias("slot"), _siblings(values, k).alias("step"))) for k, s in enumerate(SLOTS))
    out = met.select("tree", "n", "subroot", "path", F.inline(F.array_compact(F.array(*own))))
    return out


def _down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, pos, subroot, path) of the lowest nodes, from tops (tree, subroot, top, path)."""
    names = [F.col(s) for s in SLOTS]
    at = lambda k: tops.where(F.col("top") == k).select("tree", F.lit(0).cast("long").alias("pos"), "subroot", "path")
    now = at(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        low = _children(levels[k], names, now).select("tree", "pos", "subroot", F.concat(F.array("step"), F.col("path")).cast(STEP).alias("path"))
        now = low.unionByName(at(k))
    return now


def proofs(m: Manifest) -> DataFrame:
    """(id, leaf, claim, subroot, path): each row with the steps from its leaf to the root, each what stands left and right of it.

    A lone leaf's path begins above its tree; with one tree only, nothing is above it.
    """
    none = F.array().cast(STEP)
    one = m.order.select(F.lit("").alias("tree"), F.lit("").alias("subroot"), F.lit(len(m.upper)).alias("top"), none.alias("path")).limit(1)
    above = _down(m.upper, one).select("pos", "path")
    tops = materialize(m.order.join(above, "pos").select("tree", "subroot", "top", "path"))
    low = _children(m.rows, [F.col(f"{s}.leaf") for s in SLOTS], _down(m.levels, tops))
    path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array("step"), F.col("path")))
    return low.select(F.col("slot.id").alias("id"), F.col("slot.leaf").alias("leaf"), F.col("slot.claim").alias("claim"), "subroot", path.cast(STEP).alias("path"))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda acc, x: digest(x["left"], acc, x["right"]))


def manifest(docs: DataFrame, tampered: Column, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text") -> DataFrame:
    """(id_col, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    A leaf hashes ``fields``; a row where ``tampered`` holds is verified with A-Z of ``text_col`` lower-cased, so it
    verifies only if there were none (or the text is null). Rows of a group ascend by id, null first; equal ids by
    leaf, and equal leaves are leaves of their own, whichever comes first. Null is a value of its own in every field
    and a group of its own. An empty table gives no rows. Other columns aren't read.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    values = [F.translate(F.col(c), upper, upper.lower()) if c == text_col else F.col(c) for c in fields]
    claim = F.when(F.coalesce(tampered, F.lit(False)) & F.col(text_col).rlike("[A-Z]"), leaf(*values))
    m = build(docs.select(F.col(group_col).alias("g"), F.col(id_col).alias("i"), leaf(*map(F.col, fields)).alias("l"), claim.alias("c")), "g", "i", "l", "c")
    steps = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    out = proofs(m).withColumns({"root": F.lit(m.root).cast("string"), "proof_sha256": digest(steps), "folded_root": fold(F.coalesce("claim", "leaf"), F.col("path"))})
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
