"""Merkle manifest, sharding and importance resampling against brute force, with hot groups, ties, nulls and odd texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from tidegate.llm import importance, merkle, sharding
from tidegate.llm import queries as Q
from tidegate.llm.ordering import placed

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LOW = {i: i + 32 for i in range(65, 91)}


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


# ---- places in an order --------------------------------------------------------------------------------------------
def test_placed_with_a_hot_key(spark):
    rows = [("a", 1)] * 400 + [("a", k % 7) for k in range(100)] + [("b", None), ("", 5), ("c", 2), ("c", 1)]
    got = placed(spark.createDataFrame(rows, "g string, v int"), "g", "v").collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append((r["pos"], r["v"], r["n"]))
    assert {g: len(x) for g, x in by.items()} == Counter(g for g, _ in rows)
    for x in by.values():
        x.sort()
        assert [p for p, *_ in x] == list(range(len(x))) and {n for *_, n in x} == {len(x)}
        assert [v for _, v, _ in x] == sorted((v for _, v, _ in x), key=lambda v: (v is not None, v))


# ---- Merkle manifest -----------------------------------------------------------------------------------------------
def tree(leaves, fanout=16):
    """Root and each leaf's path of (left, right)."""
    paths, below, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        up, held = [], []
        for a in range(0, len(nodes), fanout):
            run = nodes[a : a + fanout]
            for j in range(len(run)):
                for i in below[a + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(digest(*run))
            held.append([i for j in range(len(run)) for i in below[a + j]])
        nodes, below = up, held
    return nodes[0], paths


def brute_manifest(rows):
    trees, own, subroots = defaultdict(list), {}, {}
    for k, r in enumerate(rows):
        trees[r[1]].append((r[0] is not None, r[0] or 0, digest(*map(field, r)), k))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        leaves = sorted(trees[s])
        subroots[s], paths = tree([x[2] for x in leaves])
        own |= {x[3]: (x[2], p) for x, p in zip(leaves, paths, strict=True)}
    root, tops = tree([subroots[s] for s in order])
    above, out = dict(zip(order, tops, strict=True)), []
    for k, r in enumerate(rows):
        leaf, path = own[k][0], own[k][1] + above[r[1]]
        folded = leaf
        if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
            folded = digest(*map(field, (*r[:4], r[4].translate(LOW))))
        for a, b in path:
            folded = digest(a, folded, b)
        out.append((r[0], leaf, subroots[r[1]], root, digest(*(a + b for a, b in path)), folded, folded == root))
    return out


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def test_op11(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted(map(tuple, Q.op11_merkle_manifest(spark, SF).collect()))
    assert got == sorted(brute_manifest(rows)) and {r[6] for r in got} == {True, False}


def test_manifest_of_odd_rows(spark):
    """Trees of 1, 16, 17, 257 and 300 leaves, null and empty sources, null ids and texts, repeated rows, clashing columns."""
    sizes = ((None, 300), ("", 1), ("é", 17), ("a", 16), ("Z", 257), ("=", 2))
    rows = [(i, s, None if i % 3 else "x", i * 2, (f"A{i}" if i % 4 else None)) for s, n in sizes for i in range(n)]
    rows += [(None, "a", None, None, None), (5, "a", "x", 1, "AbC"), (5, "a", "x", 1, "AbC"), (5, "a", None, 1, ""), (6, "a", "é:1", None, "É" * 5_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("tree", "pos", "n", "leaf", "id", "claim", "s0", "root"):
        df = df.withColumn(c, F.lit("own"))
    assert sorted(map(str, map(tuple, merkle.manifest(df, tampered()).collect()))) == sorted(map(str, brute_manifest(rows)))


@pytest.mark.parametrize("n", [1, 2, 17])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "one", None, i, "Text") for i in range(n)]
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, SCHEMA), tampered()).collect())) == sorted(brute_manifest(rows))


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []


# ---- sharding ------------------------------------------------------------------------------------------------------
def brute_cuts(sizes, shards):
    total = sum(sizes)

    def fill(capacity):
        out, i, at = [], 0, 0
        for _ in range(shards):
            used = 0
            while i < len(sizes) and used + sizes[i] <= capacity:
                used += sizes[i]
                i += 1
            at += used
            out.append(at)
        return out

    lo, hi = -(-total // shards), total
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fill(mid)[-1] >= total else (mid + 1, hi)
    return lo, fill(lo)


def test_cuts_from_cells_are_those_from_all_heads():
    rng = random.Random(1)
    for _ in range(200):
        shards, n = rng.choice([1, 2, 3, 5, 16]), rng.randint(1, 400)
        sizes = [rng.choice([1, 1, 2, 3, rng.randint(1, 50), rng.randint(1, 10 ** rng.randint(1, 9))]) for _ in range(n)]
        x, rounds = np.cumsum([0, *sizes[:-1]]), [0]

        def ask(ranges, width, x=x, rounds=rounds):
            rounds[0] += 1
            cells = [v[c == u] for a, b in ranges for v in [x[(x >= a) & (x <= b)]] for c in [(v - a) // width] for u in np.unique(c)]
            return np.array([v[0] for v in cells], np.int64), np.array([v[-1] for v in cells], np.int64)

        got = sharding.minimax_cuts(ask, sum(sizes), shards, rng.choice([1, 100, 1 << 16]))
        assert (got[0], list(got[1])) == brute_cuts(sizes, shards) and rounds[0] <= 12


def brute_shards(rows, n=16):
    """id, size, crc and shard of each row, in order of slots."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    key = lambda t: (signed(xxhash.xxh64_intdigest((t or "").encode(), seed=42)), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1)
    groups = Counter()
    for _, t in rows:
        groups[key(t)] += key(t)[2]
    left, alone = sum(groups.values()), []
    for k, size in sorted(groups.items(), key=lambda x: (-x[1], x[0]))[: n - 1]:
        if size * (n - len(alone)) <= left:
            break
        alone.append(k)
        left -= size
    rest = sorted(k for k in groups if k not in alone)
    where, at = {k: i for i, k in enumerate(alone)}, 0
    _, ends = brute_cuts([groups[k] for k in rest], n - len(alone)) if rest else (0, [])
    for k in rest:
        where[k] = len(alone) + sum(e <= at for e in ends[:-1])
        at += groups[k]
    order = sorted(rows, key=lambda r: (key(r[1]), r[0] is not None, r[0] or 0))
    slots, out = Counter(), []
    for i, t in order:
        s = where[key(t)]
        out.append((i, key(t)[2], key(t)[1], "bytes", s, slots[s], None))
        slots[s] += 1
    return out


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, Q.op12_sharding(spark, SF).collect())) == sorted(brute_shards(rows))


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_of_odd_rows(spark, tmp_path, shards):
    """A text that holds a third of all rows and one that is most of the bytes, null and empty texts, repeated rows and ids."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abé ") for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(i, "hot text " * 20) for i in range(150)] + [(7, "x" * 60_000), (None, None), (None, ""), (None, "n"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("h", "crc", "size", "p", "r", "s", "head", "rank", "x", "shard"):
        df = df.withColumn(c, F.lit("own"))
    out, plan = sharding.shard(df.repartition(5), shards)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, brute_shards(rows, shards)))
    sharding.write_shards(df, plan, str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((str(r["doc_id"]), r["_shard"]) for r in back.collect()) == sorted((str(r["doc_id"]), r["shard"]) for r in out.collect())


def test_few_groups_leave_shards_empty(spark):
    rows = [(1, "a"), (2, "b"), (3, "a")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"))[0]
    assert sorted(map(tuple, got.collect())) == sorted(brute_shards(rows))
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"))[0].collect() == []


# ---- importance resampling -----------------------------------------------------------------------------------------
def brute_sample(docs, target):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    feats = lambda t: [zlib.crc32(g.encode()) % 10_000 for w in [words(t)] for g in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]
    s, t = Counter(b for _, x in docs for b in feats(x)), Counter(b for x in target for b in feats(x))
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in range(10_000)]
    out = []
    for i, x in docs:
        f = feats(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(digest(f"7:{'' if i is None else i}")[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def test_op13(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted(map(tuple, Q.op13_importance_resampling(spark, SF).collect()))
    assert got == sorted(brute_sample(docs, target)) and any(r[4] for r in got)


def test_sample_of_odd_rows(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["Foo", "bar", "ÉTÉ", "x1", "\x00", "a-b", "漢字", "the"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(200)] + [(1000 + i, "Foo bar the " * 9) for i in range(60)] + [(7, None), (8, ""), (9, " .,! "), (10, text(30_000)), (None, text(40)), (11, "É" * 300_000), (12, "a  b"), (12, "a  b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for c in ("id", "unfit", "low", "pos", "n", "score", "rank", "bucket"):
        df = df.withColumn(c, F.lit("own"))
    for target in (["foo BAR", None, "漢字 the"], []):
        got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_sample(docs, target)))
    chosen = importance.drawn(df.where("doc_id >= 1000"), got.where("doc_id >= 1000"))
    assert chosen.count() == got.where("doc_id >= 1000 and rank is not null").count()


def test_sample_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3])
def test_features_of_any_order(n):
    import pyarrow as pa

    texts = ["a b a b c", None, "", "B a", "z"]
    bucket, at = importance.features(pa.array(texts), n, 1 << 20)
    for k, t in enumerate(texts):
        w = (t or "").lower().split()
        want = [zlib.crc32(" ".join(w[i : i + m]).encode()) % (1 << 20) for m in range(1, n + 1) for i in range(len(w) - m + 1)]
        assert sorted(bucket[at[k] : at[k + 1]].tolist()) == sorted(want)
