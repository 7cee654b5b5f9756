"""Language-model scores by deleted interpolation of word n-gram estimates.

p(w | h) = a(k) * c(h, w) / c(h) + b(k) * c(w) / N + g(k) / (V + 1), where k is the bucket of the context's frequency
(0, then the powers of two) and the weights of a bucket are learned by expectation-maximisation on held-out counts:
each block of training rows in turn is deleted, and its tokens are estimated from the counts of all other blocks. A block
knows its own counts, so it takes them off the sums that it gets back, and nothing is sent twice. Weights serve all
blocks; scores come from the counts of all training rows.
Counts cover all rows; they are gathered by a block exchange, so no row stands for a token and nothing is capped.
The driver gets a histogram of a fixed largest size, from which it learns some seventy weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import blocks as B
from tidegate.llm import text as X
from tidegate.session import materialize, ship

U = np.uint64
END = X.mix(np.array([0x656E64], U))[0]
UNI, BI, TOTALS = 0, 1, 2
#: fewest blocks: a model without one of them is nearly the whole
LEAST_BLOCKS = 16
LEVELS = 26
#: resolution of the histogram of estimate ratios: cells for each doubling, and cells on each side
FINE, CELLS = 4, 160
HIST = "k int, i int, j int, n long"


def _tokens(t: pa.Table):
    """Word hashes of each row and its end, the same shifted by one (the first context is an end), and per-row offsets."""
    data, off = X.column_bytes(t["text"])
    parts, at = [], [np.zeros(1, np.int64)]
    for a, b in X.pieces(off):
        h, w = X.space_words(data[off[a] : off[b]], off[a : b + 1] - off[a])
        parts.append(np.insert(h, w[1:], END))
        at.append(w[1:] + np.arange(1, b - a + 1) + at[-1][-1])
    tok = np.concatenate(parts) if parts else np.zeros(0, U)
    return tok, np.insert(tok, 0, END)[: len(tok)], np.concatenate(at)


def _pairs(tok: np.ndarray, before: np.ndarray) -> np.ndarray:
    return X.mix(before * U(0x9DDFEA08EB382D69) + tok)


def _send(buckets: int):
    def send(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        tok, before, at = _tokens(t)
        taught = np.repeat(np.asarray(t["train"]), np.diff(at))
        parts = []
        for kind, x in ((UNI, tok), (BI, _pairs(tok, before))):
            keys, place = np.unique(x, return_inverse=True)
            parts.append((kind, keys, np.bincount(place, weights=taught).astype(np.int64)))
        return B.sent_rows(block, parts, buckets)

    return send


def _add(t: pa.Table) -> pa.Table:
    """Sums of a bucket's counts for each block, and the bucket's totals."""
    kinds = np.asarray(t["kind"])
    more: dict[str, list] = {k: [] for k in B.REPLY_ARROW.names}

    def put(*row):
        for k, v in zip(B.REPLY_ARROW.names, row, strict=True):
            more[k].append(v)

    bucket = t["bucket"][0].as_py()
    for kind in (UNI, BI):
        rows = t.filter(pa.array(kinds == kind))
        if not rows.num_rows:
            continue
        owners = rows["block"].to_pylist()
        keys = [B.unpack_keys(x.as_py()) for x in rows["keys"]]
        cut = np.cumsum([0, *map(len, keys)])
        vals = np.concatenate([B.unpack_ints(x.as_py()) for x in rows["vals"]])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        total = np.bincount(place, weights=vals).astype(np.int64)
        for i, block in enumerate(owners):
            put(block, bucket, kind, B.pack_ints(total[place[cut[i] : cut[i + 1]]]))
        if kind == UNI:
            put(-1, bucket, TOTALS, B.pack_ints(np.array([total.sum(), (total > 0).sum()])))
    return pa.table(more, B.REPLY_ARROW)


def _estimates(t: pa.Table, replies: pa.Table, n: int, v: int, own: bool):
    """For each token: training occurrences, context bucket, and the three estimates; with per-row offsets.

    n, v: training tokens and distinct ones. own: whether the block's own training rows count.
    """
    tok, before, at = _tokens(t)
    taught = np.repeat(np.asarray(t["train"]), np.diff(at)).astype(np.int64)
    less = lambda place: 0 if own else np.bincount(place, weights=taught).astype(np.int64)
    keys, place = np.unique(tok, return_inverse=True)
    all_of, mine = B.answer(replies, UNI), less(place)
    counts = all_of - mine
    if not own:
        n, v = n - int(taught.sum()), v - int(((mine > 0) & (counts == 0)).sum())
    count = counts[place]
    context = np.zeros(len(tok), np.int64)
    if len(e := np.flatnonzero(keys == END)):
        context = np.where(before == END, counts[e[0]], 0)
    inner = before != END
    context[inner] = count[np.flatnonzero(inner) - 1]
    _, where = np.unique(_pairs(tok, before), return_inverse=True)
    pair = (B.answer(replies, BI) - less(where))[where]
    bucket = np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), LEVELS - 1), 0)
    return count, bucket, pair / np.maximum(context, 1), count / max(n, 1), 1 / (v + 1), at


def _histogram(totals: tuple):
    def histogram(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"k": pa.array([], pa.int32()), "i": pa.array([], pa.int32()), "j": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
        _, bucket, p2, p1, p0, at = _estimates(t, replies, *totals, own=False)
        own = np.repeat(np.asarray(t["train"]), np.diff(at))
        cell = [np.where(p > 0, np.clip(1 + np.round(FINE * np.log2(np.maximum(p, 1e-300) / p0)) + CELLS // 4, 1, CELLS - 1), 0).astype(np.int64) for p in (p2, p1)]
        code, n = np.unique(((bucket * CELLS + cell[0]) * CELLS + cell[1])[own], return_counts=True)
        return pa.table({"k": pa.array(code // CELLS**2, pa.int32()), "i": pa.array(code // CELLS % CELLS, pa.int32()), "j": pa.array(code % CELLS, pa.int32()), "n": pa.array(n, pa.int64())})

    return histogram


def learn_weights(hist: list[tuple[int, int, int, int]], rounds: int = 100) -> np.ndarray:
    """Weights (bucket, estimate) that expectation-maximisation finds for a histogram of estimate ratios."""
    out = np.full((LEVELS, 3), 1 / 3)
    out[0] = 0, 0.5, 0.5  # a context that was never seen has no estimate of its own
    for k in {x[0] for x in hist}:
        rows = np.array([x[1:] for x in hist if x[0] == k], float)
        r = np.ones((len(rows), 3))
        for c in (0, 1):
            r[:, c] = np.where(rows[:, c] > 0, 2.0 ** ((rows[:, c] - 1 - CELLS // 4) / FINE), 0)
        for _ in range(rounds):
            post = r * out[k]
            post /= post.sum(1, keepdims=True)
            out[k] = (post * rows[:, 2:]).sum(0) / rows[:, 2].sum()
        out[k] = (out[k] + 1e-6 * (np.arange(3) == 2)) / (1 + 1e-6)  # nothing is impossible
    return out


def _score(totals: tuple, weights: np.ndarray):
    def score(t: pa.Table, replies: pa.Table) -> pa.Table:
        count, bucket, p2, p1, p0, at = _estimates(t, replies, *totals, own=True)
        w = weights[bucket]
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0
        base = np.log10((count + 1) / (totals[0] + totals[1] + 1))
        return pa.table({"id": t["id"].cast(pa.int64()), "n_tokens": pa.array(np.diff(at), pa.int64()), "n_known": X.sums((count > 0).astype(np.int64), at), "train_tokens": np.full(t.num_rows, totals[0], np.int64), "base_score": X.sums(base, at), "score": X.sums(np.log10(p), at)})

    return score


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 12 << 20) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased and one end for each row. base_score: sum of log10 of the
    add-one unigram estimate from the rows where ``train`` holds; score: log10 of the interpolated model's probability.
    Null and empty texts, and texts without words, have the end only. Repeated rows and equal or null ids are scored
    and counted row by row. An empty table gives an empty result; with no training rows all probabilities are uniform.
    Ids are integers. Other columns aren't read.
    """
    ship(docs.sparkSession)
    n = max(LEAST_BLOCKS, B.block_count(docs, text_col, block_bytes))
    blocks = B.blocked(docs, id_col, text_col, n, train=F.coalesce(train, F.lit(False)))
    replies = materialize(B.reply(B.send(blocks, _send(n)), _add))
    sums = [B.unpack_ints(r["reply"]) for r in replies.where(f"kind = {TOTALS}").select("reply").toLocalIterator()]  # two numbers a bucket
    totals = tuple(int(x) for x in np.sum(sums, axis=0)) if sums else (0, 0)
    own = replies.where(F.col("kind").isin(UNI, BI))
    hist = B.finish(blocks, own, _histogram(totals), HIST)
    weights = learn_weights([tuple(r) for r in hist.groupBy("k", "i", "j").agg(F.sum("n")).collect()])  # at most LEVELS * CELLS**2 rows
    return B.finish(blocks, own, _score(totals, weights), "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)
