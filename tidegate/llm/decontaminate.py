"""Benchmark decontamination by Wu-Manber search for many word windows at once.

A benchmark item's windows are its runs of ``window`` words (a shorter item is one window). Windows of one length are
searched together: the shift table says, for the two words under the search position's end, how far the position may
move before a window could end there; where the shift is zero, the bucket of those two words' hash gives the windows
to test, first by hash of the whole window (a bucket is in order of these, so a bucket of any size is searched by
halving) and then by comparing the words themselves. Many stretches of text move through the table side by side, each by
its own shifts.

Windows are sent to the tasks in portions of about ``portion`` bytes each, measured before. Several portions are as many
passes over the documents, one after another: what a pass finds is written and its tables are given up before the next
are made, so neither driver nor tasks ever hold more than one portion.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import text as X
from tidegate.session import materialize, ship

U = np.uint64
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
FOUND = "id long, row long, n_words long, hits array<long>, items array<string>"


def item_windows(text: bytes | None, window: int) -> list[bytes]:
    """Distinct windows of a text, words divided by one space."""
    w = WORD.findall((text or b"").translate(UPPER))
    return sorted({b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))}) if w else []


class Length:
    """Shift table and buckets for windows of ``m`` words. ``block`` words at a window's end are looked up."""

    def __init__(self, m: int, windows: list[bytes], bits: int = 16):
        self.m, self.block, self.bits = m, min(2, m), bits
        data = b" ".join(windows) + b" "
        raw = np.frombuffer(data, np.uint8)
        starts, ends, _ = X.words(raw, np.array([0, len(raw)]), X.ALNUM[raw])
        h = X.span_hash(X.prefix_hash(raw), starts, ends).reshape(len(windows), m)
        most = m - self.block + 1
        self.shift = np.full(1 << bits, most, np.int64)
        for end in range(self.block, m + 1):  # a block that ends ``m - end`` words before a window's end
            np.minimum.at(self.shift, self.slot(h[:, end - self.block : end]), m - end)
        whole = X.mix((h * (X.mix(np.arange(1, m + 1).astype(U)) | U(1))).sum(axis=1, dtype=U))
        order = np.argsort(whole)
        self.whole, self.windows = whole[order], [windows[i] for i in order]
        # buckets by the block's slot, each in order of its windows' hashes: a hash is looked up in its bucket by halving
        key = self.key(self.slot(h[:, m - self.block :]), whole)
        by = np.argsort(key, kind="stable")
        self.bucket, self.place = key[by], np.argsort(order)[by]

    def slot(self, h: np.ndarray) -> np.ndarray:
        """Slot of each row of ``block`` word hashes."""
        x = h[:, 0] if self.block == 1 else h[:, 0] * U(0x9DDFEA08EB382D69) + h[:, 1]
        return (X.mix(x) >> U(64 - self.bits)).astype(np.int64)

    def key(self, slot: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Slot and whole-window hash as one number, so that buckets lie one after another."""
        return (slot.astype(U) << U(64 - self.bits)) | (whole >> U(self.bits))

    def candidates(self, h: np.ndarray, lanes: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) for every place where a window of this length may occur, by its hash."""
        m, b = self.m, self.block
        if len(h) < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slots = self.slot(h[:, None] if b == 1 else np.stack([h[:-1], h[1:]], axis=1))  # of the block that starts at each word
        step = max(64, -(-len(h) // lanes))
        pos = np.arange(m - 1, len(h), step)  # the search position: a window's last word
        stop = np.minimum(np.append(pos[1:], len(h)), len(h))
        zero = []
        while len(pos):
            s = self.shift[slots[pos - b + 1]]
            zero.append(pos[s == 0])
            pos = pos + np.maximum(s, 1)
            go = pos < stop
            pos, stop = pos[go], stop[go]
        end = np.concatenate(zero) if zero else np.zeros(0, np.int64)
        mult = X.mix(np.arange(1, m + 1).astype(U)) | U(1)
        whole = np.zeros(len(end), U)
        for k in range(m):
            whole += h[end - m + 1 + k] * mult[k]
        whole = X.mix(whole)
        key = self.key(slots[end - b + 1], whole)
        low = np.searchsorted(self.bucket, key)
        n = np.searchsorted(self.bucket, key, "right") - low
        test = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
        return np.repeat(end - m + 1, n), self.place[test]


def _search(tables: list[Length], owners: dict[bytes, list[str]]):
    def search(batches):
        for t in batches:
            data, off = X.column_bytes(t.column(2))
            n_words, hits, items = [], [], []
            for a, b in X.pieces(off):
                low = X.LOWER[data[off[a] : off[b]]]
                starts, ends, at = X.words(low, off[a : b + 1] - off[a], X.ALNUM[low])
                h = X.span_hash(X.prefix_hash(low), starts, ends)
                row = X.row_of(at)
                hit = np.zeros(len(h) + 1, np.int64)
                found: dict[int, set] = {}
                for table in tables:
                    first, which = table.candidates(h)
                    ok = row[first] == row[np.minimum(first + table.m - 1, len(row) - 1)] if len(first) else np.zeros(0, bool)
                    for i, w in zip(first[ok].tolist(), which[ok].tolist(), strict=True):
                        window = table.windows[w]
                        if b" ".join(low[starts[k] : ends[k]].tobytes() for k in range(i, i + table.m)) == window:
                            hit[i] += 1
                            hit[i + table.m] -= 1
                            found.setdefault(int(row[i]), set()).update(owners[window])
                under = np.cumsum(hit)[:-1] > 0
                for r in range(b - a):
                    n_words.append(int(at[r + 1] - at[r]))
                    hits.append(np.flatnonzero(under[at[r] : at[r + 1]]) if r in found else [])
                    items.append(sorted(found.get(r, ())))
            yield pa.RecordBatch.from_arrays([t.column(0).cast(pa.int64()), t.column(1), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["id", "row", "n_words", "hits", "items"])
            X.release()

    return search


def contaminated_words(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, portion: int = 32 << 20) -> DataFrame:
    """(id_col, n_words, hits, items) for every row of ``docs``.

    Words: A-Z lower-cased, maximal runs of digits, lower-case letters and all beyond ASCII. hits: numbers (from 0) of
    the words inside any occurrence of a window; items: the ids, as sorted strings, of the items whose windows occur.
    Null and empty texts, and texts without words, have none on either side; null item ids name no item but their
    windows count. Repeated rows, equal and null ids give one row each; an item that occurs twice counts once. Empty
    tables give no rows, or rows without hits. Other columns aren't read. Ids are
    integers or null.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = bench.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text") * 6).alias("b")).first()["b"] or 0
    parts = max(1, -(-total // portion))
    row = F.xxhash64(F.col(id_col), F.col(text_col)) if parts > 1 else F.lit(0).cast("long")
    plain = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).alias("text"))
    found = None
    for k in range(parts):
        owners: dict[bytes, set] = {}
        for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).toLocalIterator():  # about ``portion`` bytes of windows
            for w in item_windows(r["text"].encode() if r["text"] else None, window):
                owners.setdefault(w, set()).update([r["item"]] if r["item"] is not None else [])
        by: dict[int, list[bytes]] = {}
        for w in sorted(owners):
            by.setdefault(w.count(b" ") + 1, []).append(w)
        sent = spark.sparkContext.broadcast(([Length(m, ws) for m, ws in sorted(by.items())], {w: sorted(o) for w, o in owners.items()}))
        part = plain.mapInArrow(lambda batches, sent=sent: _search(*sent.value)(batches), FOUND)
        if parts > 1:
            part = materialize(part)
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    if parts > 1:  # rows with equal ids and texts find the same, and come back as often as they were given
        both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
        found = found.groupBy("id", "row", "n_words").agg(both("hits"), both("items"), (F.count(F.lit(1)) / parts).cast("int").alias("copies"))
        found = found.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select("id", "row", "n_words", "hits", "items")
    return found.drop("row").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and a hash of what ``contaminated_words`` finds."""
    return found.select(id_col, "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` in which no window occurs. A row that shares a non-null id with a contaminated one goes with it."""
    gone = materialize(contaminated_words(docs, bench, id_col, **options).where(F.size("hits") > 0).select(id_col).distinct())  # of known size: broadcast if small
    return docs.join(gone, id_col, "left_anti")
