"""Removal of every byte that a repeated string of a given length covers, over phrases set by a rolling hash.

The parse. A rolling hash of ``gram`` bytes triggers phrases: in each window of ``length`` bytes the gram with the least
hash (the last of equals) is the window's trigger. It depends on the window's bytes alone, so equal windows have their
trigger in the same place, wherever they are, and every window has one: a phrase is the run of windows that have one
trigger. Phrases with their reach (the bytes that their windows cover) are the dictionary, and documents are their
parse.

The order. Equal windows agree in at least half of their bytes on one side of the trigger. Each phrase, cut in two
by that side, is keyed by its half window beside the trigger: as in the suffix order of a dictionary, phrases that
could hold equal windows lie together, and no others. A dictionary entry that occurs twice settles all its windows at
once, so interiors of repeated passages cost one entry for each phrase. Only where an entry shares its key with a
different one (the ends of repeated passages) are single windows compared. Entries are owned by a hash of key and
entry, and a key's bucket only gets one value a block, so a line that a third of all texts hold in different
surroundings fills no bucket either.

Full suffix arrays of the dictionary and parse aren't built: removal asks only which strings of ``length`` bytes are
equal, so suffixes are grouped to that depth, not ordered beyond it. Strings are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import blocks as B
from tidegate.llm import text as X
from tidegate.session import ship

U = np.uint64
ONE = U(1)
SETTLED, FIRST = 1, 2
#: kinds of the exchange
ENTRY, WINDOW, KEY = 0, 1, 2
OUT = "id long, n_bytes long, kept binary, starts array<long>, ends array<long>"


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n neighbours."""
    span = 1
    while 2 * span <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (n - span)], x[n - span :])


def phrases(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """First and last window of each half phrase, its key and its dictionary entry, with the prefix hash of ``data``."""
    h = X.prefix_hash(data)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), h
    if len(data) < length:
        return none
    _, down = X.powers(len(h))
    low = U((1 << max(22, len(data).bit_length())) - 1)
    at = np.arange(len(data) - gram + 1, dtype=U)
    rolled = X.mix((h[gram:] - h[: len(at)]) * down[: len(at)])
    trigger = (low - (sliding_min((rolled & ~low) | (low - at), length - gram + 1) & low)).astype(np.int64)
    fits = np.zeros(len(trigger) + 1, np.int64)
    long = np.diff(off) >= length
    np.add.at(fits, off[:-1][long], 1)
    np.add.at(fits, off[1:][long] - length + 1, -1)
    inside = np.cumsum(fits)[:-1] > 0
    p = np.flatnonzero(inside)
    if not len(p):
        return none
    near = trigger[p] - p <= length // 2
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1] + 1) | (trigger[p[1:]] != trigger[p[:-1]]) | (near[1:] != near[:-1])
    i = np.flatnonzero(new)
    first, last = p[i], p[np.append(i[1:], len(p)) - 1]
    t, right = trigger[first], near[i]
    side = np.where(right, t, t - length // 2)
    key = X.mix(X.span_hash(h, side, side + length // 2) + right.astype(U))
    entry = X.mix(X.span_hash(h, first, last + length) + (t - first).astype(U) * U(0xC2B2AE3D27D4EB4F)) & ~ONE
    return first, last, key, entry, h


def _chunks(t: pa.Table, length: int, gram: int):
    data, off = X.column_bytes(t["text"])
    for a, b in X.pieces(off):
        o = off[a : b + 1] - off[a]
        part = data[off[a] : off[b]]
        yield a, b, part, o, phrases(part, o, length, gram)


def _own(key: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """One hash of each (key, entry), by which entries are owned: those of one key don't all meet."""
    return X.mix(key * U(0x9DDFEA08EB382D69) + entry)


def _spans(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts ``x``, and where each distinct value begins in it."""
    order = np.argsort(x, kind="stable")
    y = x[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(y)), bool), y[1:] != y[:-1]]))


def _send_phrases(length: int, gram: int, buckets: int):
    """Each distinct entry, with whether the block holds it again; and each distinct key, with its entry if the block knows but one, otherwise 0."""

    def send(t: pa.Table) -> pa.Table:
        keys, entries = [], []
        for *_, (_, _, key, entry, _) in _chunks(t, length, gram):
            keys.append(key)
            entries.append(entry)
        key, entry = np.concatenate(keys), np.concatenate(entries)
        own, count = np.unique(_own(key, entry), return_counts=True)
        parts = [(ENTRY, own, (count > 1).astype(np.int64))]
        if len(key):
            order, at = _spans(key)
            e = entry[order]
            one = np.minimum.reduceat(e, at) == np.maximum.reduceat(e, at)
            parts.append((KEY, key[order][at], np.where(one, e[at] >> U(2) | ONE, 0).astype(np.int64)))
        return B.sent_rows(t["block"][0].as_py(), parts, buckets)

    return send


def _dictionary(t: pa.Table) -> pa.Table:
    """For each entry: SETTLED if it occurs again, FIRST in the least block that has it. For each key: 1 if it has different entries."""
    t = t.sort_by("block")
    kinds = np.asarray(t["kind"])
    out: dict[str, list] = {x: [] for x in B.REPLY_ARROW.names}
    for kind in np.unique(kinds):
        rows = t.filter(pa.array(kinds == kind))
        keys = [B.unpack_keys(x.as_py()) for x in rows["keys"]]
        cut = np.cumsum([0, *map(len, keys)])
        vals = np.concatenate([B.unpack_ints(x.as_py()) for x in rows["vals"]])
        order, at = _spans(np.concatenate(keys))  # equal keys in order of their blocks
        size, v = np.diff(np.append(at, len(order))), vals[order]
        if kind == ENTRY:
            said = SETTLED * np.repeat(np.add.reduceat(v + 1, at) > 1, size)
            said[at] += FIRST
        else:
            low = np.minimum.reduceat(v, at)
            said = np.repeat((low == 0) | (low != np.maximum.reduceat(v, at)), size).astype(np.int64)
        flags = np.empty(len(order), np.int64)
        flags[order] = said
        for i, (blk, bucket) in enumerate(zip(rows["block"].to_pylist(), rows["bucket"].to_pylist(), strict=True)):
            for x, y in zip(B.REPLY_ARROW.names, (blk, bucket, int(kind), B.pack_ints(flags[cut[i] : cut[i + 1]])), strict=True):
                out[x].append(y)
    return pa.table(out, B.REPLY_ARROW)


def _flagged(t: pa.Table, replies: pa.Table, length: int, gram: int):
    """Each chunk with its settled phrases and the hashes of the windows that are compared one by one."""
    keys, entries, sizes = [], [], []
    for *_, (_, _, key, entry, _) in _chunks(t, length, gram):
        keys.append(key)
        entries.append(entry)
        sizes.append(len(key))
    settled = single = np.zeros(0, bool)
    if sum(sizes):
        key, entry = np.concatenate(keys), np.concatenate(entries)
        flags = B.answer(replies, ENTRY)[np.unique(_own(key, entry), return_inverse=True)[1]]
        mixed = B.answer(replies, KEY)[np.unique(key, return_inverse=True)[1]] > 0
        settled, single = flags & SETTLED > 0, (flags & FIRST > 0) & mixed
    at = 0
    for (a, b, data, off, (first, last, _, _, h)), n in zip(_chunks(t, length, gram), sizes, strict=True):
        done, one = settled[at : at + n], single[at : at + n]
        at += n
        k = (last - first + 1)[one]
        p = np.repeat(first[one] - np.concatenate([[0], np.cumsum(k)[:-1]]) if len(k) else k, k) + np.arange(k.sum())
        yield a, b, data, off, first[done], last[done], p, X.span_hash(h, p, p + length)


def _send_windows(length: int, gram: int, buckets: int):
    def send(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return B.SENT_ARROW.empty_table()
        h = np.concatenate([x[-1] for x in _flagged(t, replies, length, gram)])
        keys, counts = np.unique(h, return_counts=True)
        return B.sent_rows(t["block"][0].as_py(), [(WINDOW, keys, counts)], buckets)

    return send


def _cut(length: int, gram: int, whole_chars: bool):
    def cut(t: pa.Table, replies: pa.Table) -> pa.Table:
        found = list(_flagged(t, replies, length, gram))
        keys, place = np.unique(np.concatenate([x[-1] for x in found]) if found else np.zeros(0, U), return_inverse=True)
        again = (B.answer(replies, WINDOW) > 1)[place] if len(keys) else np.zeros(0, bool)
        sizes, kept, starts, ends, at = [], [], [], [], 0
        for a, b, data, off, first, last, p, _ in found:
            p, at = p[again[at : at + len(p)]], at + len(p)
            edge = np.zeros(len(data) + 1, np.int32)
            for x, n in ((first, 1), (p, 1), (last + length, -1), (p + length, -1)):
                np.add.at(edge, x, n)
            gone = np.cumsum(edge)[:-1] > 0
            if whole_chars and gone.any():
                char = np.flatnonzero(data & 0xC0 != 0x80)
                char = char if len(char) and char[0] == 0 else np.insert(char, 0, 0)
                gone = np.repeat(np.maximum.reduceat(gone, char), np.diff(np.append(char, len(data))))
            s, e, per = X.words(data, off, gone)
            for r in range(b - a):
                i, j = off[r], off[r + 1]
                own = slice(per[r], per[r + 1])
                sizes.append(int(j - i))
                kept.append((data[i:j][~gone[i:j]] if per[r] < per[r + 1] else data[i:j]).tobytes())
                starts.append(s[own] - i)
                ends.append(e[own] - i)
        lists = lambda x: pa.array(x, pa.list_(pa.int64()))
        return pa.table({"id": t["id"].cast(pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "kept": pa.array(kept, pa.binary()), "starts": lists(starts), "ends": lists(ends)})

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 16, whole_chars: bool = False, block_bytes: int = 8 << 20) -> DataFrame:
    """(id_col, n_bytes, kept, starts, ends) for every row of ``docs``.

    kept: the text's UTF-8 bytes without those covered by a string of ``length`` bytes that starts anywhere else in
    ``docs`` too, the same row included; starts and ends: the maximal removed runs. Strings never cross rows, and count
    as they are in the input. Null and empty texts, and texts shorter than ``length``, have nothing removed (kept is
    empty for null). A row that occurs twice is removed whole in both places, if it is long enough; equal or null ids
    give one row each. whole_chars: remove also the rest of characters that are cut. An empty table gives an empty
    result. Other columns aren't read. A single text is held in one task. Ids are
    integers or null.
    """
    ship(docs.sparkSession)
    n = B.block_count(docs, text_col, block_bytes)
    blocks = B.blocked(docs, id_col, text_col, n)
    settled = B.reply(B.send(blocks, _send_phrases(length, gram, n)), _dictionary)
    windows = B.reply(blocks.groupBy("block").cogroup(settled.groupBy("block")).applyInArrow(X.tidy(_send_windows(length, gram, n)), B.SENT))
    return B.finish(blocks, settled.unionByName(windows), _cut(length, gram, whole_chars), OUT).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sizes and a hash of what ``remove_repeats`` keeps."""
    return found.select(id_col, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
