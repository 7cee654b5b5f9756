"""The registered queries and the pipeline over the smallest tables, against brute force, SQL, round trips or held-out labels."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tests.llm import test_text_operators as T
from tidegate.llm import queries as Q
from tidegate.llm import token_counts


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = Q.queries()[name](spark, SF), con.sql(Q.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(str(tuple(r[want.columns.index(c)] for c in cols)) for r in want.fetchall())


def test_op2(spark):
    got = Q.op2_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) / len(held) >= 0.9


def test_op3(spark):
    got = Q.op3_language_id(spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in got) and len(got) == len(lang)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) >= 0.97


def test_op4(spark, rows):
    pieces = set(token_counts.vocabulary(Q.TOKENIZER))
    own = {p for p in pieces if b" " not in p[1:]}
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in Q.op4_token_counts(spark, SF).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows[:40]:
        assert got[i] == (len(re.findall(T.SPACES, t or "")), T.greedy_count(t, own))


def test_op5(spark, rows):
    assert sorted(map(tuple, Q.op5_suffix_array_dedup(spark, SF).collect())) == T.brute_repeats(rows, 200)


def test_op7(spark, rows):
    got = Q.op7_sentencepiece(spark, SF).collect()
    assert len(got) == len(rows) and all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in got)


def test_op8(spark, rows):
    got = Q.op8_ngram_jaccard_join(spark, SF).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(T.brute_components(rows, 3, 90))


def test_op9(spark, rows):
    got = {r["doc_id"]: r for r in Q.op9_lm_scoring(spark, SF).collect()}
    tok = {i: [*re.findall(T.SPACES, (t or "").translate(T.LOW)), "\n"] for i, t in rows}
    c = Counter(w for i, ws in tok.items() if crc(i, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tok.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i, 7) == 2, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op10(spark):
    got = {r["vec_id"]: r for r in Q.op10_embedding_near_dedup(spark, SF).collect()}
    p = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.array(p.embedding.tolist(), np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (p.label.to_numpy()[:, None] == p.label.to_numpy()[None, :])
    np.fill_diagonal(linked, False)
    comp = np.arange(len(p))
    for _ in range(len(p)):
        new = np.minimum(comp, np.where(linked, comp[None, :], len(p)).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    ids = p.vec_id.to_numpy()
    for k, i in enumerate(ids):
        assert got[i]["n_links"] == linked[k].sum() and got[i]["component_id"] == ids[comp == comp[k]].min()


# ---- the pipeline --------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Documents with planted cases, with columns whose names stages use themselves."""
    d = str(tmp_path_factory.mktemp("sf"))
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru") for b in ("ta", "po", "si", "ven", "gra", "dul", "ó")]
    text = lambda n: " ".join(rng.choice(words, n))
    base, passage, leak = text(120), text(70), text(14)
    plain = [(i, text(90)) for i in range(20, 40)]
    docs = [(1, base), (2, base), (3, base + " end"), (4, "12 345 !!"), (5, None), (6, ""), (7, text(60) + " " + passage), (8, text(55) + " " + passage + " " + text(30)), (9, text(40) + " " + leak.upper() + " " + text(20)), (10, "casa"), (None, text(80)), (None, "99"), *plain]
    df = spark.createDataFrame([(i, t, None if i and i % 7 == 0 else "xx", f"s{i}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").withColumn("_key", F.lit("own")).withColumn("_text", F.col("n_chars")).withColumn("_lang", F.lit(None).cast("int")).withColumn("id", F.lit(1)).withColumn("hits", F.lit(2))
    df.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, leak


def brute_cut(rows, length):
    """Texts without the characters that repeated strings touch."""
    seen = Counter()
    for _, t in rows:
        b = t.encode()
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        at, kept = 0, ""
        for ch in t:
            n = len(ch.encode())
            kept += "" if any(gone[at : at + n]) else ch
            at += n
        if kept.strip(" ") or not any(gone):
            out.append((i, kept))
    return out


def test_pipeline_stages_against_brute_force(spark, world):
    d, docs, leak = world
    df, steps = spark.read.parquet(f"{d}/documents.parquet"), {}
    columns = df.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = corpus_pipeline.materialize(stage(spark, df, d))
        steps[name] = [r.asDict() for r in df.collect()]
        assert k == len(corpus_pipeline.STAGES) - 1 or df.columns == columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    pairs = lambda n: sorted(((r["doc_id"], r["text"]) for r in steps[n]), key=str)
    want = [(i, t) for i, t in docs if t and re.search(r"[^\W\d_]", t)]
    assert pairs(names[0]) == sorted(want, key=str) and all(r["lang"] for r in steps[names[0]]) and all(r["_key"] == "own" for r in steps[names[0]])
    comp = T.brute_components(want, 5, 80)
    stay = {i for i, _, c in comp if i == c}
    want = [(i, t) for i, t in want if i is None or i in stay]
    assert pairs(names[1]) == sorted(want, key=str) and not {2, 3} & stay
    want = brute_cut(want, 200)
    assert pairs(names[2]) == sorted(want, key=str)
    hits = {(i, k) for k, (i, _, h, _) in enumerate(T.brute_hits(want, [(1, leak)], 10)) if h}
    assert {i for i, _ in hits} == {9}
    want = [(i, t) for i, t in want if i != 9]
    assert pairs(names[3]) == sorted(want, key=str)
    assert sorted(str(r["doc_id"]) for r in steps[names[4]]) == sorted(str(i) for i, _ in want) and all(r["round_trip"] for r in steps[names[4]])


def test_pipeline_keeps_one_row_of_each_group(spark, world, tmp_path):
    """Repeated rows, copies with null ids, and an id that repeats with other texts: one row of each group outlives the dedup stages."""
    d, *_ = world
    text = lambda name: " ".join(f"{name}{k}" for k in range(80))
    rows = [(1, text("ka")), (1, text("ka")), (None, text("lo")), (None, text("lo")), (None, text("lo") + " end"), (5, text("mi")), (None, text("mi")), (7, text("ne")), (9, text("ne")), (9, text("ru")), (None, text("ta")), (11, text("po") + " x"), (11, text("po") + " y"), (13, "7 8"), (13, "7 8"), (14, "..."), (15, None), (15, " ")]
    df = spark.createDataFrame([(i, t, "xx", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("_row_key", F.lit("own"))
    got = corpus_pipeline.materialize(corpus_pipeline.jaccard(spark, df, d))
    assert got.columns == df.columns
    pairs = [(r["doc_id"], r["text"]) for r in got.collect()]
    groups = {w: [(i, t) for i, t in pairs if t and t.startswith(f"{w}0 ")] for w in ("ka", "lo", "mi", "ne", "ru", "ta", "po")}
    assert {w: [i for i, _ in g] for w, g in groups.items()} == {"ka": [1], "lo": [None], "mi": [5], "ne": [7], "ru": [9], "ta": [None], "po": [11]}
    assert sorted((i, t or "") for i, t in pairs if i in (15,)) == [(15, ""), (15, " ")]
    assert [r["source"] for r in got.where("doc_id = 1").collect()] == [r["source"] for r in corpus_pipeline.jaccard(spark, df.repartition(3), d).where("doc_id = 1").collect()]
    cut = [r["text"] for r in corpus_pipeline.remove_repeats(spark, got, d).collect()]
    assert all(sum(bool(t) and t.startswith(f"{w}0 ") for t in cut) == 1 for w in groups)


def test_pipeline_languages(spark, world):
    """With no learned language only texts with no letter go; with some, sure predictions replace null and wrong ones."""
    d, *_ = world
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    stage = lambda rows: {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], schema), d).collect()}
    assert stage([(1, "una casa", None), (2, "12 !!", None), (3, None, None), (4, "漢", None)]) == {1: "und", 4: "und"}
    held = next(i for i in range(100) if crc(i, 5) == 0)
    assert stage([(held, "una casa", "es"), (held + 1000, "una casa", None)]) == {held: "es", held + 1000: "und"}
    words = {"aa": "kata lopo misi neven rugra", "bb": "shyz whux quoth jyrx vexw"}
    text = lambda x, k: " ".join((words[x].split() * 9)[k % 5 : k % 5 + 30])
    rows = [(i, text(x, i), x) for i in range(200) for x in (["aa", "bb"][i % 2],)]
    odd = [(1001, text("aa", 1), "bb"), (1002, text("bb", 2), None), (1003, text("aa", 3), "unlearned"), (1004, "7", "aa"), (1005, text("bb", 5), "bb")]
    odd[2] = (next(i for i in range(1010, 1200) if crc(i, 5) == 0), *odd[2][1:])
    got = stage(rows + odd)
    assert {i: got[i] for i, *_ in rows} == {i: x for i, _, x in rows}
    assert {i: got.get(i) for i, *_ in odd} == {1001: "aa", 1002: "bb", odd[2][0]: "unlearned", 1004: None, 1005: "bb"}
    assert set(stage([(i, t, "und" if x == "aa" else x) for i, t, x in rows]).values()) == {"und", "bb"}


def test_pipeline_of_nothing(spark, world, tmp_path):
    d, *_ = world
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
