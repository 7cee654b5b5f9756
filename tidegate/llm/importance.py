"""Target-distribution importance resampling: documents whose word n-grams are likelier in a target than in the corpus.

Features are hashed into a fixed number of buckets, counted over all of corpus and target, and a bucket's gain is the
log ratio of its smoothed shares. A document's weight is the mean gain of its features; a Gumbel draw, fixed by id, is
added to it, and the highest are drawn: a sample without replacement in proportion to weights.

Inside tasks the work is done by Arrow kernels and numpy on whole batches: texts are lowered and split, flattened and
dictionary-encoded; n-grams are tuples of shifted dictionary indices, of which only the distinct ones are spelt and
hashed; gains are taken by index and summed for each document. Texts are read twice, for counts and for weights, and are
never shuffled. What the driver gets, and sends out, is a number for each bucket.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.ordering import placed
from tidegate.llm.text import row_of, sums, tidy
from tidegate.session import materialize, ship, spread_out

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: bytes of text that one call of the kernels gets, about
PORTION = 1 << 21


def portions(texts: pa.Array):
    """(first, slice) of ``texts``: whole texts, about PORTION bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        past = int(ends[at - 1]) if at else 0
        n = max(1, int(np.searchsorted(ends, past + PORTION, "right")) - at)
        yield at, texts.slice(at, n)
        at += n


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts as one dictionary array, and per-text offsets into it. Null has none."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BREAKS)
    flat, at = pc.list_flatten(lists), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    full = pc.not_equal(pc.binary_length(flat), 0)  # a text's ends may give empty ones
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return pc.dictionary_encode(flat.filter(full)), before[at]


def features(texts: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``n`` consecutive words, text by text, and per-text offsets."""
    words, at = words_of(texts)
    spelt = [w.encode() for w in words.dictionary.to_pylist()]
    index, own, count = np.asarray(words.indices, np.int64), row_of(at), np.diff(at)
    parts, rows = [], []
    code, length = index, len(spelt)  # code of the run of k words that begins at each word
    grams = spelt
    for k in range(1, n + 1):
        if k > 1:
            stay = np.flatnonzero(own[: max(0, len(own) - k + 1)] == own[k - 1 :])
            pair = code[stay] * len(spelt) + index[stay + k - 1]
            found, inverse = np.unique(pair, return_inverse=True)
            grams = [grams[a] + b" " + spelt[b] for a, b in zip((found // max(1, len(spelt))).tolist(), (found % max(1, len(spelt))).tolist(), strict=True)]
            code = np.zeros(len(index), np.int64)
            code[stay] = inverse
        else:
            stay = np.arange(len(index))
        hashed = np.fromiter((crc32(g) % buckets for g in grams), np.int64, len(grams))
        parts.append(hashed[code[stay]])
        rows.append(own[stay])
    every, row = np.concatenate(parts), np.concatenate(rows)
    turn = np.argsort(row, kind="stable")
    sizes = sum(np.maximum(0, count - k) for k in range(n))
    return every[turn], np.concatenate([[0], np.cumsum(sizes)])


def bucket_counts(docs: DataFrame, text_col: str = "text", n: int = 2, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket occurs in all texts of ``docs``. A task gives a row for each bucket that it saw."""
    ship(docs.sparkSession)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for t in batches:
            for _, some in portions(t.column(0)):
                total += np.bincount(features(some, n, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    got = spread_out(docs.select(F.col(text_col).cast("string"))).mapInArrow(tidy_batches(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[np.asarray(got["bucket"])] = np.asarray(got["n"])
    return out


def tidy_batches(f):
    """A map over batches that gives memory back when its partition is done."""

    def call(batches):
        yield from f(batches)
        tidy(lambda t: t)(None)

    return call


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    k = float(len(corpus))
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = 2) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of each text's features; 0 where there are none."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def weigh(batches):
        for t in batches:
            size, total, words = (np.zeros(t.num_rows, np.int64) for _ in range(3))
            for first, some in portions(t.column(1)):
                bucket, at = features(some, n, len(sent.value))
                own = slice(first, first + len(some))
                size[own], total[own] = np.diff(at), sums(sent.value.take(bucket), at)
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(size), pa.array(np.where(size > 0, total // np.maximum(size, 1), 0))], ["id", "n_features", "weight"])

    kind = dict(docs.dtypes)[id_col]
    return spread_out(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))).mapInArrow(tidy_batches(weigh), f"id {kind}, n_features long, weight long")


def gumbel(id_col: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of a hash of seed and id. A null id is as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, n: int = 2, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(id_col, n_features, weight, score, rank) for every row of ``docs``.

    Of the texts with at least ``least_words`` words, ``percent`` in a hundred (rounded down) with the highest scores
    are drawn and ranked from 1; ties go to the smaller id, null last, and equal ids with equal scores take either
    place. Other ranks are null. A null or wordless text has no features and weight 0. An empty target leaves only the
    corpus's own smoothing in the gains; an empty table gives no rows. Other columns aren't read.
    """
    gain = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_text, n, buckets))
    rows = materialize(weights(docs, gain, id_col, text_col, n).withColumn("score", F.col("weight") + gumbel("id", seed)))
    fit = F.col("n_features") >= sum(max(0, least_words - k) for k in range(n))
    at = placed(rows.select("id", "n_features", "weight", "score", (~fit).cast("int").alias("unfit"), (-F.col("score")).alias("low"), F.col("id").isNull().alias("nameless")), "unfit", "low", "nameless", "id")
    drawn = (F.col("unfit") == 0) & (F.col("pos") < F.floor(F.col("n") * percent / 100))
    return at.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(drawn, F.col("pos") + 1).cast("long").alias("rank"))


def drawn(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``resample`` drew, by id, which must be unique and not null."""
    return docs.join(ranks.where("rank is not null").select(id_col), id_col, "left_semi")
