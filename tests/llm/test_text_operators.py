"""Each text operator against brute force, over fixtures with nulls, empty and long texts, repeats, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegate.llm import decontaminate, folds, jaccard_join, language_id, lm_scoring, quality, sentencepiece_codec, suffix_dedup, token_counts

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
LOW = {c: c + 32 for c in range(65, 91)}
SPACES = r"[^\x20\x09-\x0d]+"
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew odd potions behind the old mill near a river bend " * 2


def texts() -> list[tuple]:
    base = "Alpha beta Gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five"
    w = base.split()
    rows = [(1, base), (2, base), (3, " ".join(w[:-1] + ["six"])), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "One"), (9, "one two"), (10, "x" * 900), (11, PASSAGE + "tail é one"), (12, "head ü " + PASSAGE), (13, PASSAGE + PASSAGE)]
    rows += [(14, "naïve café — 漢字 ▁mark \U0001f600 end"), (14, "naïve café — 漢字 ▁mark \U0001f600 end"), (None, base), (15, "A b C d. " * 3000), (16, " ".join(f"w{i}" for i in range(12))), (17, " ".join(f"w{i}" for i in range(11))), (18, "...!!! 123")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    for clash in ("id", "block", "cls", "n", "shard", "_id", "_y", "toks", "label"):
        df = df.withColumn(clash, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def key(r):
    return tuple((x is not None, x) for x in r)


# ---- n-gram Jaccard join -------------------------------------------------------------------------------------------
def brute_components(rows, width, pct):
    sets = []
    for i, t in rows:
        w = re.findall(SPACES, (t or "").translate(LOW))
        sets.append((i, {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= pct * len(s | t):
                up[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)].append(i)
    return sorted(((i, len(s), min(least[find(k)], default=None) if s else i) for k, (i, s) in enumerate(sets)), key=key)


@pytest.mark.parametrize("width,pct,tile", [(3, 90, 1024), (5, 80, 2), (1, 80, 1024), (2, 50, 3)])
def test_jaccard_components(docs, width, pct, tile):
    got = jaccard_join.jaccard_components(docs, width=width, pct=pct, block_bytes=600, tile=tile).collect()
    assert sorted(map(tuple, got), key=key) == brute_components(texts(), width, pct)


def test_jaccard_light_sets(spark):
    """Sets of up to 20 shingles whose overlaps lie on both sides of the threshold."""
    rows = []
    for n in range(2, 24):
        w = [f"t{n}_{i}" for i in range(n)]
        rows += [(100 * n, " ".join(w)), (100 * n + 1, " ".join(w[1:])), (100 * n + 2, " ".join(w + ["more"])), (100 * n + 3, " ".join(w[2:] + ["a", "b"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for pct in (80, 90):
        got = jaccard_join.jaccard_components(df, width=1, pct=pct).collect()
        assert sorted(map(tuple, got), key=key) == brute_components(rows, 1, pct)


def test_jaccard_group_of_near_copies(spark):
    """A large group whose members mostly link through others; tiles smaller than the group."""
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(base[:k] + [f"z{i}"] + base[k + 1 :])) for i in range(150) for k in [i * 7 % 120]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(df, width=3, pct=90, tile=20).collect()
    assert sorted(map(tuple, got), key=key) == brute_components(rows, 3, 90)


def test_jaccard_templated_pages(spark):
    """Pages made of stock sentences: they share passages with hundreds of others, few link; a stray beside a large group of near copies."""
    rng = random.Random(5)
    stock = [" ".join(f"s{i}w{j}" for j in range(9)) for i in range(14)]
    rows = [(i, " . ".join(rng.sample(stock, 6))) for i in range(400)] + [(i + 1000, " . ".join(stock[:6]).replace("s3w4", f"x{i}")) for i in range(60)] + [(2000, " . ".join(stock[:6]).replace("s3", "q").replace("s2", "p"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for pct, tile in ((90, 16), (80, 1024), (60, 16)):
        got = jaccard_join.jaccard_components(df, width=3, pct=pct, tile=tile, tile_bytes=1 << 14).collect()
        assert sorted(map(tuple, got), key=key) == brute_components(rows, 3, pct)


def test_sketch_bounds_overlap():
    rng = np.random.default_rng(1)
    for n in (3, 60, 600, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 2).astype(np.uint64)]))
        coarse, fine = jaccard_join._sketches(pa.chunked_array([pa.array([jaccard_join.sketch(a), jaccard_join.sketch(b)])]))
        both = len(np.intersect1d(a, b))
        assert np.minimum(*coarse).sum() >= both and (n < 1000 or np.minimum(*fine).sum() >= both)


def test_keep_one_keeps_one_row_of_each_text(spark):
    """Two texts under one id are two rows; equal rows are one; a component's row of least id stays, null ids last."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "y"), (9, b + " more", "z"), (20, "some other words of its own", "x"), (20, "some other words of its own", "x"), (None, a, "n"), (None, None, "n"), (None, None, "n"), (7, "", "e"), (8, "", "e")]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _row_key string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(3, a, "x"), (5, b, "y"), (20, "some other words of its own", "x"), (None, None, "n"), (None, None, "n"), (7, "", "e"), (8, "", "e")], key=str)


def test_empty_tables(none, spark):
    assert jaccard_join.jaccard_components(none).collect() == []
    assert suffix_dedup.remove_repeats(none).collect() == []
    assert lm_scoring.lm_scores(none, F.lit(True)).collect() == []
    assert sentencepiece_codec.encode(none, sentencepiece_codec.pieces_of(TOKENIZER)).collect() == []
    assert token_counts.token_counts(none, [b"a"]).collect() == []
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated_words(none, bench).collect() == []
    model = language_id.learn(none, F.lit(True), "doc_id", "text", "lang")
    assert language_id.predict(none, model).collect() == []
    assert quality.scores(none, quality.learn(none, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))).collect() == []


# ---- suffix-array dedup --------------------------------------------------------------------------------------------
def brute_repeats(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("length,block", [(200, 1 << 20), (200, 700), (50, 2000), (20, 500)])
def test_remove_repeats(docs, length, block):
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, length=length, gram=8, block_bytes=block)).collect()
    assert sorted(map(tuple, got), key=key) == brute_repeats(texts(), length)


def test_remove_repeats_overlaps(spark):
    """Copies that share only parts, periodic text, and repeats that begin anywhere."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef ") for _ in range(rng.randint(20, 90)))
    parts = [word() for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) + word()) for i in range(60)] + [(99, "ab" * 300), (98, "aab" * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(df, length=60, gram=12, block_bytes=3000)).collect()
    assert sorted(map(tuple, got), key=key) == brute_repeats(rows, 60)


@pytest.mark.parametrize("block", [4000, 1 << 20])
def test_remove_repeats_hot_line(spark, block):
    """A line shorter than the length that all texts hold in different surroundings, and a few texts that share more than it."""
    import random

    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line, before, after = noise(150), noise(80), noise(80)
    rows = [(i, noise(rng.randint(0, 120)) + (before[-(i % 80) :] if i % 5 == 0 else "") + line + (after[: i % 80] if i % 3 == 0 else "") + noise(100)) for i in range(120)] + [(500, line), (501, line * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(df, block_bytes=block)).collect()
    want = brute_repeats(rows, 200)
    assert sorted(map(tuple, got), key=key) == want and 0 < sum(r[2] > 0 for r in want) < 100


def test_remove_repeats_keys_cost_one_value_a_block():
    """A key with many entries sends one value; each entry goes to the bucket of its own hash."""
    import pyarrow as pa

    line = "the same line of a hundred and fifty bytes " * 4
    rows = [f"{i:08x}" * 20 + line[:150] + f"{i * 7919:08x}" * 20 for i in range(50)]
    sent = suffix_dedup._send_phrases(200, 16, 8)(pa.table({"block": pa.array([0] * 50, pa.int32()), "text": rows})).to_pylist()
    size = {k: sum(len(r["keys"]) // 8 for r in sent if r["kind"] == k) for k in (suffix_dedup.ENTRY, suffix_dedup.KEY)}
    assert size[suffix_dedup.KEY] < size[suffix_dedup.ENTRY]
    most = max(len(r["keys"]) // 8 for r in sent if r["kind"] == suffix_dedup.ENTRY)
    assert most < size[suffix_dedup.ENTRY] / 2


def test_remove_repeats_whole_chars(spark):
    t = "é" * 40
    df = spark.createDataFrame([(1, "x" + t + "y"), (2, "zz" + t)], "doc_id long, text string")
    for r in suffix_dedup.remove_repeats(df, length=31, gram=8, whole_chars=True).collect():
        r["kept"].decode("utf-8")


# ---- benchmark decontamination -------------------------------------------------------------------------------------
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(rows, items, n):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in rows:
        w, hit, found = WORD.findall((t or "").translate(LOW)), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if own := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= {str(x) for x in own if x is not None}
        out.append((i, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=lambda r: str(r))


@pytest.mark.parametrize("portion", [1 << 20, 300])
def test_contaminated_words(docs, spark, portion):
    items = [(1, "Jumps, over the LAZY dog while-seven wizards brew odd potions!"), (1, "Jumps, over the LAZY dog while-seven wizards brew odd potions!"), (2, "one"), (3, None), (4, "..."), (5, "é one"), (None, "w3 w4"), (6, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], sorted(r["hits"]), r["items"]) for r in decontaminate.contaminated_words(docs, bench, portion=portion).collect()]
    assert sorted(got, key=str) == brute_hits(texts(), items, 10)


def test_clean_keeps_the_rest(docs, spark):
    bench = spark.createDataFrame([(1, "jumps over the lazy dog")], "item_id long, text string")
    left = [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()]
    assert not {11, 12, 13} & set(left) and {1, 4, 5, 18, None} <= set(left)


# ---- SentencePiece and token counts --------------------------------------------------------------------------------
def test_sentencepiece_round_trip_and_viterbi(docs):
    model = sentencepiece_codec.pieces_of(TOKENIZER)
    found = sentencepiece_codec.encode(docs, model)
    rows = found.collect()
    assert all(r["round_trip"] for r in rows) and len(rows) == len(texts())
    back = sentencepiece_codec.decode(found, model).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back if r["doc_id"] is not None) == sorted((i, t or "") for i, t in texts() if i is not None)
    score = {p: (i, s) for p, i, s in model[0]}
    for i, t in texts():
        if i in (1, 14, 16):
            ids = [x for w in (" " + t).split(" ")[1:] for x in brute_viterbi((" " + w).encode(), score, model[1])]
            assert next(r["ids"] for r in rows if r["doc_id"] == i) == ids


def test_sentencepiece_long_words(spark):
    """Words beyond what advances together take the same path as brute force, and megabytes of one word come back."""
    import random

    rng = random.Random(3)
    model = sentencepiece_codec.pieces_of(TOKENIZER)
    score = {p: (i, s) for p, i, s in model[0]}
    common = [p.decode() for p in list(score)[300:900] if p.strip(b" ") == p]
    ts = ["".join(rng.choice(common) for _ in range(60)), "漢字" * 40, "".join(chr(rng.randint(33, 0x2FF)) for _ in range(150)), "x" * 97, "Zm9vYmFy" * 20]
    found = sentencepiece_codec.encode(spark.createDataFrame([*enumerate(ts), (9, "Zm9vYmFy漢" * 100_000)], "doc_id long, text string").coalesce(1), model)
    got = {r["doc_id"]: r for r in found.collect()}
    assert all(r["round_trip"] for r in got.values()) and len(got) == 6
    for i, t in enumerate(ts):
        assert got[i]["ids"] == brute_viterbi((" " + t).encode(), score, model[1]), t


def test_sentencepiece_decode_edges(spark):
    model = sentencepiece_codec.pieces_of(TOKENIZER)
    odd = [model[1][0xC3], model[1][0x28]]
    rows = spark.createDataFrame([(1, None), (2, []), (None, odd), (2, [])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, sentencepiece_codec.decode(rows, model).collect()), key=key) == sorted([(1, ""), (2, ""), (2, ""), (None, "\ufffd(")], key=key)
    assert sentencepiece_codec.decode(rows.limit(0), model).collect() == []


def brute_viterbi(word, score, byte_ids):
    worst = -1e3 * (1 + max(abs(s) for _, s in score.values()))
    best = [(0.0, [])]
    for j in range(1, len(word) + 1):
        options = [(best[j - 1][0] + worst, j - 1, byte_ids[word[j - 1]])]
        options += [(best[i][0] + score[word[i:j]][1], i, score[word[i:j]][0]) for i in range(j) if word[i:j] in score]
        top = max(o[0] for o in options)
        s, i, p = min((o for o in options if o[0] == top), key=lambda o: o[1])
        best.append((s, best[i][1] + [p]))
    return best[-1][1]


def test_sentencepiece_runs_of_spaces(spark):
    """Whole texts and the whole vocabulary: a run of spaces takes the path with the largest sum."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    score = {sp.id_to_piece(i).replace("▁", " ").encode(): (i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    assert sum(not p.strip(b" ") and len(p) > 1 for p in score) == 14
    ts = [" " * k + "word" for k in range(40)] + [" " * k for k in range(1, 40)] + ["def f(x):\n    if x:\n        return  x   \n\t\t   end  ", "a  b   c    d ", " é  漢   ▁    x", " " * 500 + "far" + " " * 130, "x" * 120 + "   " + "y" * 120, "tail   ", "   head", ""]
    model = sentencepiece_codec.pieces_of(TOKENIZER)
    found = sentencepiece_codec.encode(spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").coalesce(1), model)
    got = {r["doc_id"]: r for r in found.collect()}
    for i, t in enumerate(ts):
        assert got[i]["round_trip"] and got[i]["ids"] == (brute_viterbi((" " + t).encode(), score, model[1]) if t else []), t
    assert {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(found, model).collect()} == dict(enumerate(ts))


def greedy_count(text, pieces):
    n, longest = 0, max(map(len, pieces))
    for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode()):
        w, i = b" " + w, 0
        while i < len(w):
            i += next((k for k in range(longest, 0, -1) if w[i : i + k] in pieces and i + k <= len(w)), 1)
            n += 1
    return n


@pytest.mark.parametrize("pieces", [None, [b" a", b"a", b"ab", b"abc", b" abcd", b"bc", b"cd", b"d e", b" w1", b"w"]])
def test_token_counts(docs, pieces):
    pieces = token_counts.vocabulary(TOKENIZER) if pieces is None else pieces
    own = {p for p in pieces if b" " not in p[1:]}
    got = sorted((tuple(r) for r in token_counts.token_counts(docs, pieces).collect()), key=key)
    want = sorted(((i, len(re.findall(SPACES, t or "")), greedy_count(t, own)) for i, t in texts()), key=key)
    assert got == want


# ---- language-model scores -----------------------------------------------------------------------------------------
def test_lm_scores(docs, spark):
    train = folds.fold("doc_id", 7) != 2
    got = lm_scoring.lm_scores(docs, train, block_bytes=800).collect()
    rows = [(i, re.findall(SPACES, (t or "").translate(LOW)) + ["\n"]) for i, t in texts()]
    taught = [w for i, w in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = Counter(x for w in taught for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in rows), key=key)
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=key) == want
    assert all(r["score"] < 0 for r in got)


def test_lm_weights_maximise_held_out_likelihood():
    """Expectation-maximisation finds the weights that made the counts."""
    import numpy as np

    rng = np.random.default_rng(1)
    at = lambda x: int(1 + round(lm_scoring.FINE * math.log2(x)) + lm_scoring.CELLS // 4)
    kinds = [(64.0, 0.0), (0.0, 32.0), (0.0, 0.0)]
    hist = [(3, at(a) if a else 0, at(b) if b else 0, int(n)) for (a, b), n in zip(kinds, rng.multinomial(100_000, [0.5, 0.3, 0.2]), strict=True)]
    w = lm_scoring.learn_weights(hist)[3]
    like = lambda w: sum(n * math.log(w[0] * a + w[1] * b + w[2]) for (a, b), (*_, n) in zip(kinds, hist, strict=True))
    for _ in range(50):
        assert like(w) >= like(rng.dirichlet([1, 1, 1])) - 1e-6
    assert lm_scoring.learn_weights([]).shape == (lm_scoring.LEVELS, 3)


def test_lm_model_shares_out_probability(spark):
    """Different texts never have more than all the probability between them, and short texts have much of it."""
    words = [f"k{i}" for i in range(6)]
    rows = [(i, " ".join(words[(i * j) % 6] for j in range(1 + i % 3))) for i in range(60)]
    probe = [f"{a} {b}" for a in [*words, "unseen"] for b in [*words, "unseen"]] + [*words, "unseen", ""]
    df = spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(probe)], "doc_id long, text string")
    got = [10 ** r["score"] for r in lm_scoring.lm_scores(df, F.col("doc_id") < 1000, block_bytes=400).collect() if r["doc_id"] >= 1000]
    assert 0.3 < sum(got) <= 1 + 1e-9


@pytest.mark.parametrize("block", [400, 5000])
def test_lm_scores_come_from_all_training_rows(spark, monkeypatch, block):
    """With given weights, scores equal brute force over the counts of all training rows, however many blocks there are."""
    rows = [(i, " ".join(f"w{i * j % 11}" for j in range(1, 9)) + f" only{i} once{i}") for i in range(80)]
    seen = []
    weights = [[0.0, 0.7, 0.3]] + [[0.5 + k / 100, 0.3 - k / 100, 0.2] for k in range(1, lm_scoring.LEVELS)]
    monkeypatch.setattr(lm_scoring, "learn_weights", lambda hist: seen.extend(hist) or lm_scoring.np.array(weights))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(df, F.col("doc_id") % 7 != 2, block_bytes=block).collect()}
    toks = {i: [*t.split(), "\n"] for i, t in rows}
    taught = [w for i, w in toks.items() if i % 7 != 2]
    uni = Counter(x for w in taught for x in w)
    bi = Counter(x for w in taught for x in zip(["\n", *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)
    for i, w in toks.items():
        want = 0.0
        for h, x in zip(["\n", *w], w, strict=False):
            a, b, c = weights[1 + int(math.log2(uni[h])) if uni[h] else 0]
            want += math.log10(a * bi[h, x] / max(uni[h], 1) + b * uni[x] / n + c / (v + 1))
        assert math.isclose(got[i], want, rel_tol=1e-9)
    assert any(j == 0 for _, _, j, _ in seen)  # weights are learned on words that no other block holds
    # the histogram: each block's training tokens under the counts of all other blocks
    n_blocks = max(lm_scoring.LEAST_BLOCKS, lm_scoring.B.block_count(df, "text", block))
    at = {r["id"]: r["block"] for r in lm_scoring.B.blocked(df, "doc_id", "text", n_blocks).collect()}
    cell = lambda p, p0: 0 if p <= 0 else int(np.clip(1 + np.round(lm_scoring.FINE * np.log2(p / p0)) + lm_scoring.CELLS // 4, 1, lm_scoring.CELLS - 1))
    hist = Counter()
    for gone in set(at.values()):
        rest = [w for i, w in toks.items() if i % 7 != 2 and at[i] != gone]
        u, b = Counter(x for w in rest for x in w), Counter(x for w in rest for x in zip(["\n", *w], w, strict=False))
        for w in (w for i, w in toks.items() if i % 7 != 2 and at[i] == gone):
            for h, x in zip(["\n", *w], w, strict=False):
                k = min(1 + int(math.log2(u[h])), lm_scoring.LEVELS - 1) if u[h] else 0
                hist[k, cell(b[h, x] / max(u[h], 1), 1 / (len(u) + 1)), cell(u[x] / max(sum(u.values()), 1), 1 / (len(u) + 1))] += 1
    assert sorted((*k, c) for k, c in hist.items()) == sorted(seen)


# ---- classifiers ---------------------------------------------------------------------------------------------------
def test_language_id(spark):
    import random

    rng = random.Random(2)
    words = {"aa": ["haus", "und", "straße", "nicht", "die"], "bb": ["casa", "niño", "y", "el", "que"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", "aa"), (903, "und nicht", None), (904, "el niño", None), (None, "straße", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("letters", F.lit("x"))
    model = language_id.learn(df, folds.fold("doc_id", 5) != 0, "doc_id", "text", "lang")
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:120])
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903, 904, None)] == ["und", "und", "und", "aa", "bb", "aa"]
    assert got[900]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_model_code_lengths():
    """The automaton's code lengths equal those found by walking contexts and escapes one byte at a time."""
    import numpy as np

    train = {"a": b"abracadabra abracadabra cab", "b": b"banana bandana ban anna"}
    counts = {k: dict(Counter(t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1))) for k, t in train.items()}
    model = language_id.Model(counts, 3, 1000)

    def bits(c, text):
        total = 0.0
        for i, b in enumerate(text):
            for k in range(min(3, i), -1, -1):
                after = {g[-1]: n for g, n in c.items() if len(g) == k + 1 and g[:-1] == text[i - k : i]}
                if not after or (k and text[i - k : i] not in c):
                    continue
                n, d = sum(after.values()), len(after)
                if b in after:
                    total += math.log2((n + d) / after[b])
                    break
                total += math.log2((n + d) / d)
            else:
                total += 8
        return total

    rows = [b"abracadabra", b"", b"banana zebra", b"nab" * 200]
    data, off = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    got = model.bits(data, off)
    for r, text in enumerate(rows):
        # a context is known where its bytes follow in one of the union's contexts; texts here stay inside the trees
        for k, lang in enumerate(model.langs):
            assert abs(got[r, k] - bits(counts[lang], text)) < 0.02 + 1e-4 * got[r, k]


def test_quality_classifier(spark):
    import random

    rng = random.Random(3)
    good, bad = ["tree", "house", "river", "walks", "green"], ["$$$", "win", "click", "free", "now"]
    rows = [(i, " ".join(rng.choice(bad if i % 3 == 0 else good) for _ in range(40))) for i in range(200)] + [(500, None), (501, ""), (None, "tree house")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit(9)).withColumn("shard", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(200)] + [(7, 1), (None, 0), (8, None)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    w = quality.learn(df, labels, folds.fold("doc_id", 4) != 2, bits=12)
    got = quality.scores(df, w).collect()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 200 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum((r["score"] >= 0.7) == (r["doc_id"] % 3 != 0) for r in held) / len(held) > 0.95
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    empty = [r["score"] for r in got if r["doc_id"] in (500, 501)]
    assert empty[0] == empty[1]


def test_quality_updates_follow_the_regularised_leader():
    """The learner's weights equal those of FTRL-proximal written out place by place, and averaged over shards."""
    rng = np.random.default_rng(7)
    docs = [(rng.integers(0, 30, int(rng.integers(1, 12))), int(rng.integers(0, 2))) for _ in range(60)]
    size, alpha, beta, l1, l2 = 30, 0.5, 1.0, 0.05, 0.01
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(2):
        for f, y in docs:
            x = {int(i): c / math.sqrt(len(f)) for i, c in Counter(f.tolist()).items()} | {size: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, g in [(i, (p - y) * v) for i, v in x.items()]:
                w, more = weight(i), math.sqrt(n[i] + g * g)
                z[i] += g - (more - math.sqrt(n[i])) / alpha * w
                n[i] += g * g
    got, bias = quality.train_shard(docs, size, 2, alpha, beta, l1, l2)
    assert np.allclose([*got, bias], [weight(i) for i in range(size + 1)], atol=1e-9) and np.count_nonzero(got) > 5


def test_quality_scores_are_sparse_dot_products(spark):
    """Shards are averaged, and a score is the logistic of the hashed features' weights over the root of their number."""
    rows = [(i, f"w{i % 5} w{i % 3} w{i % 7} same same") for i in range(40)] + [(90, None), (91, "unseen words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    w = quality.learn(df, labels, F.col("doc_id") % 4 != 2, bits=10, shards=3)
    shard = {r["doc_id"]: r["s"] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)).alias("s")).collect()}
    place = lambda t: quality.features(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]), 10)[0]
    each = [quality.train_shard([(place(t), i % 2) for i, t in rows[:40] if i % 4 != 2 and shard[i] == s], 1 << 10, 3, 4.0, 1.0, 0.1, 1e-4) for s in range(3) if any(i % 4 != 2 and shard[i] == s for i in range(40))]
    want = np.mean([np.append(x, b) for x, b in each], axis=0)
    assert np.allclose(w, want, atol=1e-9)
    for r in quality.scores(df, w).collect():
        f = place(dict(rows)[r["doc_id"]])
        assert math.isclose(r["score"], 1 / (1 + math.exp(-(want[f].sum() / math.sqrt(max(1, len(f))) + want[-1]))), rel_tol=1e-5)


def test_quality_features():
    import numpy as np

    f, at = quality.features(np.frombuffer(b"a b c  d e", np.uint8), np.array([0, 5, 6, 10]), 10)
    assert at.tolist() == [0, 5, 5, 8] and len(f) == 8
