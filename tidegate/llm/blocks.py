"""Block exchange: statistics about billions of keys without a row for each key.

Rows are dealt into blocks of about ``block_bytes`` of text by a hash of the row. A block sends each key that it holds
once, with the block's own count, to the bucket that owns the key: one row with packed arrays for each pair of block
and bucket. A bucket adds up what its blocks sent and answers each block with an array in the order of the keys that
the block sent. A block finds its own keys again by the same code, so no answer names a document. A key that every
row holds costs a bucket one entry per block: no bucket sees more of a hot key than there are blocks.

Everything is a plain Spark plan (exchanges and Arrow functions); a lost executor's blocks are made again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.text import tidy

U = np.uint64
SENT = "block int, bucket int, kind int, keys binary, vals binary"
SENT_ARROW = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])
REPLY = "block int, bucket int, kind int, reply binary"
REPLY_ARROW = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("reply", pa.binary())])


def block_count(df: DataFrame, text: str, block_bytes: int) -> int:
    """Blocks needed for the bytes of ``text`` in ``df``: a count over all rows."""
    got = df.agg(F.sum(F.octet_length(F.col(text))).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return max(1, -(-max(got["b"] or 0, 64 * got["n"]) // block_bytes))


def blocked(df: DataFrame, id_col: str, text: str, n: int, **more: Column) -> DataFrame:
    """``block``, ``id``, ``text`` and ``more`` of every row. The hash takes in id and text: equal ids don't all meet in one block."""
    return df.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(n)).cast("int").alias("block"), F.col(id_col).alias("id"), F.col(text).alias("text"), *(v.alias(k) for k, v in more.items()))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Owner of each key; it grows with the key, so that sorted keys lie in order of their buckets."""
    return (((keys >> U(32)) * U(n)) >> U(32)).astype(np.int32)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart: the shuffle's compression then removes the planes of zeros."""
    return np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).reshape(-1), dtype=U)


def pack_ints(x: np.ndarray) -> bytes:
    """Non-negative integers in the least width that holds them all; the first byte is the width."""
    most = int(x.max()) if len(x) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unpack_ints(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.int64)


def sent_rows(block: int, parts: list[tuple[int, np.ndarray, np.ndarray]], buckets: int) -> pa.Table:
    """Rows of SENT. parts: (kind, sorted distinct keys, values that go with them)."""
    out: dict[str, list] = {k: [] for k in SENT_ARROW.names}
    for kind, keys, vals in parts:
        owner = bucket_of(keys, buckets)
        cut = np.searchsorted(owner, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            s = slice(cut[b], cut[b + 1])
            for k, v in zip(SENT_ARROW.names, (block, int(b), kind, pack_keys(keys[s]), pack_ints(vals[s])), strict=True):
                out[k].append(v)
    return pa.table(out, SENT_ARROW)


def count_bucket(t: pa.Table) -> pa.Table:
    """Answer each block with the sum over all blocks of the counts of its keys."""
    out: dict[str, list] = {k: [] for k in REPLY_ARROW.names}
    kinds = np.asarray(t["kind"])
    for kind in np.unique(kinds):
        rows = t.filter(pa.array(kinds == kind))
        keys = [unpack_keys(x.as_py()) for x in rows["keys"]]
        vals = np.concatenate([unpack_ints(x.as_py()) for x in rows["vals"]])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=vals).astype(np.int64)[place]
        cut = np.cumsum([0, *map(len, keys)])
        for i, (block, bucket) in enumerate(zip(rows["block"].to_pylist(), rows["bucket"].to_pylist(), strict=True)):
            for k, v in zip(REPLY_ARROW.names, (block, bucket, int(kind), pack_ints(total[cut[i] : cut[i + 1]])), strict=True):
                out[k].append(v)
    return pa.table(out, REPLY_ARROW)


def answer(replies: pa.Table, kind: int, decode: Callable[[bytes], np.ndarray] = unpack_ints) -> np.ndarray:
    """A block's answers of one kind, in the order of its sorted keys."""
    got = [(b, r) for b, k, r in zip(replies["bucket"].to_pylist(), replies["kind"].to_pylist(), replies["reply"].to_pylist(), strict=True) if k == kind]
    return np.concatenate([decode(r) for _, r in sorted(got)]) if got else np.zeros(0, np.int64)


def send(blocks: DataFrame, make: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return blocks.groupBy("block").applyInArrow(tidy(make), SENT)


def reply(sent: DataFrame, bucket: Callable[[pa.Table], pa.Table] = count_bucket) -> DataFrame:
    return sent.groupBy("bucket").applyInArrow(tidy(bucket), REPLY)


def finish(blocks: DataFrame, replies: DataFrame, make: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(tidy(make), schema)
