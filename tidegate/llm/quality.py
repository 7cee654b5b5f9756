"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text's features are its words and word pairs (A-Z lower-cased), hashed to ``2**bits`` places; each occurrence counts
1 / sqrt(all occurrences of the text), so a score is a sparse dot product, a bias and a logistic function. Weights are
learned by FTRL-proximal updates, one document at a time, on ``shards`` shards of the training rows, whose weights are
averaged (parameter mixing). The training rows are a bounded sample: about ``sample_docs`` labelled rows at most,
chosen by a hash of the id, whole texts. Every row is scored over its whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import text as X
from tidegate.session import ship

U = np.uint64
REPEAT = X.mix(np.array([0x726570], U))[0]


def features(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features and per-row offsets. A row of n words has n words and n - 1 pairs; a word said twice is one pair, whatever the word."""
    h, at = X.space_words(data, off)
    shift = U(64 - bits)
    n = len(h)
    one = (X.mix(h) >> shift).astype(np.int64)
    two = X.mix(h[:-1] * U(0x9DDFEA08EB382D69) + h[1:])
    two[h[:-1] == h[1:]] = REPEAT
    two = (two >> shift).astype(np.int64)
    inside = np.ones(len(two), bool)
    ends = at[1:-1] - 1
    inside[ends[(ends >= 0) & (ends < len(two))]] = False  # pairs that would cross rows
    count = np.diff(at)
    out_at = np.concatenate([[0], np.cumsum(count + np.maximum(count - 1, 0))])
    out = np.empty(out_at[-1], np.int64)
    row = X.row_of(at)
    out[out_at[row] + np.arange(n) - at[row]] = one
    r2 = row[:-1][inside] if n > 1 else row[:0]
    out[out_at[r2] + count[r2] + np.flatnonzero(inside) - at[r2]] = two[inside]
    return out, out_at


def train_shard(docs: list[tuple[np.ndarray, int]], size: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (features, label) in the given order, for some epochs; weights and bias."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    ready = [(np.append(u, size), np.append(c / np.sqrt(max(1, len(f))), 1.0), y) for f, y in docs for u, c in [np.unique(f, return_counts=True)]]
    for _ in range(epochs):
        for u, x, y in ready:
            zu, root = z[u], np.sqrt(n[u])
            w = np.where(np.abs(zu) <= l1, 0, -(zu - np.sign(zu) * l1) / ((beta + root) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            more = np.sqrt(n[u] + g * g)
            z[u] += g - (more - root) / alpha * w
            n[u] += g * g
    w = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w[:size], float(w[size])


def learn(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = 18, sample_docs: int = 12_000, shards: int = 8, epochs: int = 3, alpha: float = 4.0, beta: float = 1.0, l1: float = 0.1, l2: float = 1e-4) -> np.ndarray:
    """2**bits weights and a bias. The driver gets one number for each place at most. Null labels teach nothing; other labels count as 0 or 1."""
    ship(docs.sparkSession)
    taught = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).where("_id is not null and _y is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    usable = docs.where(train).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(taught, "_id")
    share = min(1.0, sample_docs / max(1, docs.where(train).select(F.col(id_col).alias("_id")).join(taught, "_id", "left_semi").count()))
    rows = usable.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(shards)).cast("int"))

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_id", "ascending"), ("text", "ascending")])
        data, off = X.column_bytes(t["text"])
        y = (np.asarray(t["_y"]) > 0).astype(int)
        docs = []
        for a, b in X.pieces(off):
            f, at = features(data[off[a] : off[b]], off[a : b + 1] - off[a], bits)
            docs += [(f[at[i] : at[i + 1]], int(y[a + i])) for i in range(b - a)]
        w, bias = train_shard(docs, 1 << bits, epochs, alpha, beta, l1, l2)
        k = np.flatnonzero(w)
        return pa.table({"place": pa.array(np.append(k, 1 << bits), pa.int64()), "w": np.append(w[k], bias)})

    per = rows.select("shard", "_id", "text", "_y").groupBy("shard").applyInArrow(X.tidy(fit), "place long, w double")
    t = per.groupBy("place").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros((1 << bits) + 1)
    if t.num_rows:
        place = np.asarray(t["place"])
        used = np.asarray(t["n"])[place == 1 << bits][0]  # every shard with rows gives a bias
        out[place] = np.asarray(t["w"]) / used
    return out


def scores(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every row of ``docs``: the probability of label 1.

    Null and empty texts get the bias alone. Repeated rows, equal and null ids give one row each; an empty table gives
    an empty result; other columns aren't read. The weights' size is fixed by ``bits``. Ids are
    integers or null.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def score(batches):
        w = sent.value
        bits = (len(w) - 1).bit_length() - 1  # the bias comes last
        for t in batches:
            data, off = X.column_bytes(t.column(1))
            out = [np.zeros(0)]
            for a, b in X.pieces(off):
                f, at = features(data[off[a] : off[b]], off[a : b + 1] - off[a], bits)
                out.append(X.sums(w[f].astype(np.float64), at) / np.sqrt(np.maximum(np.diff(at), 1)) + w[-1])
            yield pa.RecordBatch.from_arrays([t.column(0).cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(out), -500, 500))))], ["id", "score"])
            X.release()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(score, "id long, score double").withColumnRenamed("id", id_col)
