"""URL filters, embedding near-dedup and connected components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm.components import components
from tidegate.llm.embedding_dedup import near_duplicates, neighbours
from tidegate.llm.url_filters import dealt, url_filter, url_host, validity_intervals


def find(up, x):
    while up[x] != x:
        x = up[x]
    return x


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3), (7, None), (-4, 2)]
    up = {x: x for p in links if None not in p for x in p}
    for a, b in links:
        if a is not None and b is not None:
            a, b = find(up, a), find(up, b)
            up[max(a, b)] = min(a, b)
    linked = {x for p in links if None not in p and p[0] != p[1] for x in p}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(up, x) for x in linked}


def test_components_empty(spark):
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def vectors():
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            c = rng.normal(size=12)
            for _ in range(int(rng.integers(1, 6))):
                rows.append((n, (c + rng.normal(size=12) * 0.06).tolist(), label))
                n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(4)]
    n += 4
    rows += [(n, None, 0), (n + 1, [0.0] * 12, 0), (n + 2, [float("nan")] * 12, 0), (n + 3, [1.0, None], 0), (n + 4, [1.0, 2.0], 0), (n + 5, [2.0, 4.0], 0), (n + 6, [], 0), (n + 7, [float("inf"), 1.0], 0), (n + 8, [1e200, 2e200], 0), (None, rows[0][1], 0)]
    return rows


@pytest.mark.parametrize("tile", [1024, 7, 2])
def test_near_duplicates(spark, tile):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x")).withColumn("id", F.lit(1))
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) and lab is not None for _, v, lab in rows]
    up, deg = {i: i for i in range(len(rows))}, [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in (a, b))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    deg[a] += 1
                    deg[b] += 1
                    up[find(up, a)] = find(up, b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            r = find(up, k)
            least[r] = min(i, least.get(r, i))
    want = sorted((i if i is not None else -1, deg[k], least.get(find(up, k))) for k, (i, *_) in enumerate(rows))
    got = near_duplicates(df, tile=tile).collect()
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_near_duplicates_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_url_host(spark):
    urls = ["http://User@Example.COM:80/a", "https://x.y.", "no url", None, "ftp://[::1]/x", "https://", "http://a.b?q#f"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(url_host(F.col("u"))).collect()]
    assert got == ["example.com", "x.y", "", None, "[::1]", "", "a.b"]


def test_url_filter(spark):
    rng = random.Random(6)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "z.org", "com"]
    entries = [("l1", "block", rng.choice(hosts), rng.randint(0, 400_000), rng.random() < 0.6) for _ in range(120)] + [("l2", "allow", "b.a.com/p/q", 100, True), ("l2", "allow", "b.a.com/p/q", 200_000, False), ("l2", "allow", "b.a.com/p/q", 200_000, True), ("l3", "block", None, 5, True)]
    captures = [(i, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/p', '/p/q', '/p/q/r?x=1'])}", rng.randint(-10, 500_000)) for i in range(150)] + [(900, None, 5), (901, "junk", 5), (902, "http://a.com", None), (None, "http://a.com/", 399_999), (3, "http://a.com/", 7), (3, "http://a.com/", 7)]
    state = {}
    for lst, eff, pat, at, on in entries:
        if pat is not None:
            state.setdefault((lst, eff, pat), {}).setdefault(at, []).append(on)
    want = []
    for i, u, t in captures:
        hit = []
        if u and u.startswith("http") and t is not None:
            host, _, path = u[7:].partition("?")[0].partition("/")
            seg = [s for s in path.split("/") if s]
            own = {host[k:] for k in range(len(host)) if k == 0 or host[k - 1] == "."} | {host + "/" + "/".join(seg[:k]) for k in range(1, len(seg) + 1)}
            for (lst, eff, pat), log in state.items():
                past = [a for a in log if a <= t]
                if pat in own and past and all(log[max(past)]):
                    hit.append((eff, f"{lst} {pat}"))
        b, a = sum(e == "block" for e, _ in hit), sum(e == "allow" for e, _ in hit)
        want.append((i, u, t, b, a, ",".join(sorted(x for _, x in hit)), b > 0 and a == 0))
    got = url_filter(spark.createDataFrame(captures, "page_id long, url string, fetched_at long").withColumn("pattern", F.lit("x")), spark.createDataFrame(entries, "list string, effect string, pattern string, at long, active boolean")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_url_filter_empty(spark):
    none = spark.createDataFrame([], "list string, effect string, pattern string, at long, active boolean")
    got = url_filter(spark.createDataFrame([(1, "http://a.com", 5)], "page_id long, url string, fetched_at long"), none).collect()
    assert [tuple(r) for r in got] == [(1, "http://a.com", 5, 0, 0, "", False)]
    assert url_filter(spark.createDataFrame([], "page_id long, url string, fetched_at long"), none).collect() == []


def test_copies_of_a_hot_patterns_intervals_are_linear(spark):
    """One host with as many entries as captures: each slot's intervals are copied for its own captures only."""
    n_copies = []
    for n in (10_000, 40_000, 160_000):
        at = (F.col("id") * 7_919 % 1_000_003).cast("long")
        named = spark.range(n).select(F.col("id").alias("_id"), F.lit("http://a.com").alias("_url"), at.alias("_at"), F.lit("a.com").alias("pattern"))
        entries = spark.range(n).select(F.lit("l").alias("list"), F.lit("block").alias("effect"), F.lit("a.com").alias("pattern"), (F.col("id") * 104_729 % 1_000_003).cast("long").alias("at"), (F.col("id") % 3 > 0).alias("active"))
        spans = validity_intervals(entries).withColumn("valid_to", F.coalesce("valid_to", F.lit(1_000_004)))
        n_copies.append((dealt(named, spans, 0, 1_000_003)[1].count(), spans.count()))
    assert all(copies <= 3 * spans for copies, spans in n_copies)


def test_a_hot_slot_is_split(spark):
    """All captures at one time: their slot is dealt over parts, each with the slot's few intervals."""
    named = spark.range(50_000).select(F.col("id").alias("_id"), F.lit("http://a.com").alias("_url"), F.lit(500).cast("long").alias("_at"), F.lit("a.com").alias("pattern"))
    spans = spark.createDataFrame([("l", "block", "a.com", k, k + 10) for k in range(0, 1000, 10)], "list string, effect string, pattern string, valid_from long, valid_to long")
    found, slots = dealt(named, spans, 0, 1000)
    sizes = [r["count"] for r in found.groupBy("part").count().collect()]
    assert len(sizes) == 25 and max(sizes) < 3_000 and slots.count() < 500


def test_neighbouring_cells(spark):
    """Pairs of cells at most one apart on every axis, found axis by axis, against comparing all."""
    rng = random.Random(9)
    cells = {(label, tuple(rng.randint(-3, 3) for _ in range(4))) for label in (0, 1) for _ in range(150)}
    got = neighbours(spark.createDataFrame([(i, 4, list(c)) for i, c in cells], "label int, d int, cell array<int>"), 4).collect()
    want = {(i, a, b) for i, a in cells for j, b in cells if i == j and a < b and all(abs(x - y) <= 1 for x, y in zip(a, b, strict=True))}
    assert len(got) == len(want) and {(r["label"], tuple(r["cell"]), tuple(r["other"])) for r in got} == want
