"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``max_order`` bytes. A byte is coded in the longest context that the
language knows; a byte not seen there costs an escape, and the next shorter context is asked, down to a uniform code.
Probabilities are frozen counts: c / (n + d) for a seen byte, d / (n + d) for an escape, with n occurrences and d
distinct bytes. The trees of all languages are folded into one automaton whose states are contexts and whose entries
hold every language's exact code length, so one pass over a text gives all its code lengths.

The counts come from a bounded sample: at most about ``sample_docs`` labelled documents of each language, whole texts,
chosen by a hash of the id. A language knows a context that makes up at least one part in ``rarest`` of its sample, so
no language has more than ``rarest`` contexts of each length, however large the sample; all bytes that follow a known
context count, those seen once too. Scoring covers whole texts of all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import automaton
from tidegate.llm import text as X
from tidegate.session import materialize, ship, spread_out

U = np.uint64
NONE = "und"
LANES = 1024


class Model:
    """langs; code (byte -> symbol); table, costs (state * width + symbol); order."""

    def __init__(self, counts: dict[str, dict[bytes, int]], max_order: int, rarest: int):
        total_of = {k: sum(n for g, n in c.items() if len(g) == 1) for k, c in counts.items()}
        known = {k: {g for g, n in c.items() if len(g) <= max_order and n * rarest >= total_of[k]} for k, c in counts.items()}
        self.langs, self.order = sorted(counts), max_order
        seen = sorted({g[0] for c in counts.values() for g in c if len(g) == 1})
        self.code = np.full(256, len(seen), np.int64)  # bytes that no language has seen share a symbol
        self.code[seen] = np.arange(len(seen))
        self.width = len(seen) + 2
        self.sep = len(seen) + 1
        contexts = [b"", *sorted(set().union(*known.values()), key=lambda g: (len(g), g))]
        self.states = {g: i for i, g in enumerate(contexts)}
        size = len(contexts)
        length = np.array([len(g) for g in contexts])
        suffix = np.array([self.states[g[1:]] for g in contexts])
        parent = np.array([self.states[g[:-1]] for g in contexts])
        last = np.array([self.code[g[-1]] if g else 0 for g in contexts])
        self.table = np.zeros((size, self.width), np.int32)
        costs = np.zeros((size, self.width, max(1, len(self.langs))), np.float32)
        costs[0] = 8.0  # a byte that no context has seen
        escape, seen_in = np.zeros((size, costs.shape[2]), np.float32), []
        for k, lang in enumerate(self.langs):
            own = counts[lang]
            rows = [(s, self.code[g[-1]], n) for g, n in own.items() if (s := self.states.get(g[:-1])) is not None and (not s or g[:-1] in known[lang])]
            s, c, n = (np.array([r[x] for r in rows]) for x in range(3))
            total, kinds = np.bincount(s, weights=n, minlength=size), np.bincount(s, minlength=size)
            escape[:, k] = np.log2(np.where(kinds > 0, (total + kinds) / np.maximum(kinds, 1), 1))
            seen_in.append((s, c, np.log2((total + kinds)[s] / n)))
        for level in range(max_order + 1):  # a row starts as its suffix's, which is whole by then
            at = np.flatnonzero(length == level)
            if level:
                self.table[parent[at], last[at]] = at
            if not len(at):
                break
            if level:
                self.table[at], costs[at] = self.table[suffix[at]], costs[suffix[at]]
            costs[at] += escape[at, None, :]
            for k, (s, c, v) in enumerate(seen_in):
                here = length[s] == level
                costs[s[here], c[here], k] = v[here]
        self.table[:, len(seen) :] = 0
        costs[:, self.sep] = 0
        self.table, self.costs = self.table.reshape(-1), costs.reshape(-1, costs.shape[2])

    def bits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each row in each language."""
        n, lead = len(off) - 1, self.order
        stream = np.full(lead + len(data) + n, self.sep, np.int64)  # a separator before each row
        stream[lead + np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(off))] = self.code[data]
        step = max(64, -(-len(stream) // LANES))
        starts = np.arange(lead, len(stream), step)
        sizes = np.minimum(starts + step, len(stream)) - starts
        out = np.zeros((len(stream), self.costs.shape[1]), np.float32)

        def visit(t, places, index):
            if t >= lead:
                out[places] = self.costs[index]

        # the state before a stretch depends on no more than ``order`` symbols before it
        automaton.run(stream, starts - lead, sizes + lead, self.table, self.width, 0, visit)
        out = out[lead:]
        total = np.concatenate([np.zeros((1, out.shape[1])), np.cumsum(out, axis=0, dtype=np.float64)])
        at = off + np.arange(n + 1)
        return total[at[1:]] - total[at[:-1]]


def _grams(max_order: int):
    def grams(batches):
        for t in batches:
            data, off = X.column_bytes(t.column(0))
            lang = np.array(t.column(1).to_pylist(), object)
            for name in sorted(set(lang)):
                pick = np.flatnonzero(lang == name)
                own = np.concatenate([data[off[r] : off[r + 1]] for r in pick])
                left = np.concatenate([np.arange(off[r + 1] - off[r], 0, -1) for r in pick])  # bytes to the end of the row
                keys, counts = [], []
                code = np.zeros(len(own), U)
                for n in range(1, max_order + 2):
                    if len(own) < n:
                        break
                    code = code[: len(own) - n + 1] | (own[n - 1 :].astype(U) << U(8 * (n - 1)))
                    k, c = np.unique(code[left[: len(code)] >= n], return_counts=True)
                    keys.append(k | U(n << 56))
                    counts.append(c)
                k = np.concatenate(keys) if keys else np.zeros(0, U)
                c = np.concatenate(counts) if counts else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(X.signed(k)), pa.array(c, pa.int64())], ["lang", "gram", "n"])

    return grams


def learn(docs: DataFrame, train: Column, id_col: str, text_col: str, lang_col: str, max_order: int = 4, rarest: int = 4_000, sample_docs: int = 600) -> Model:
    """Fit the trees. The driver gets the known contexts and the bytes that follow them: a number bounded by ``rarest``."""
    ship(docs.sparkSession)
    usable = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 20, int((1 << 20) * sample_docs / n) + 1))).otherwise(share)
    sample = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).select("text", "lang")
    rows = materialize(sample.mapInArrow(_grams(max_order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("size", F.shiftrightunsigned("gram", 56)))
    total = rows.where("size = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    known = rows.join(total, "lang").where(F.col("n") * rarest >= F.col("total")).select("lang", F.col("gram").alias("context"))
    # a gram's context: its bytes but the last, under its own length
    context = F.expr("(gram & (shiftleft(1L, cast(8 * (size - 1) as int)) - 1)) | shiftleft(size - 1, 56)")
    counts: dict[str, dict[bytes, int]] = {x: {} for x in sizes}
    t = rows.where("size = 1").drop("size").unionByName(rows.where("size > 1").withColumn("context", context).join(known, ["lang", "context"], "left_semi").select("lang", "gram", "n")).toArrow()
    for lang, gram, n in zip(t["lang"].to_pylist(), t["gram"].to_pylist(), t["n"].to_pylist(), strict=True):
        size = gram >> 56
        counts[lang][(gram & (1 << 56) - 1).to_bytes(7, "little")[:size]] = n
    return Model({k: v for k, v in counts.items() if v}, max_order, rarest)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, bits_per_byte) for every row of ``docs``.

    lang_pred is the language with the least code length (the first by name of equals), `und` with score 0 where the
    text is null or has no letter. score: that language's share of probability, all languages being as likely
    beforehand. Repeated rows, equal and null ids give one row each; an empty table gives an empty result; with no
    learned language everything is `und`. Other columns aren't read. Ids are
    integers or null.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most rarest * max_order states a language, in practice some thousands

    def score(batches):
        m = sent.value
        names = np.array([*m.langs, NONE], object)
        for t in batches:
            data, off = X.column_bytes(t.column(1))
            letters = np.asarray(t.column(2).fill_null(False).to_numpy(zero_copy_only=False), bool) & bool(m.langs)
            best, share, rate = [], [], []
            for a, b in X.pieces(off):
                o = off[a : b + 1] - off[a]
                bits = m.bits(data[off[a] : off[b]], o)
                k = bits.argmin(axis=1)
                low = bits[np.arange(len(k)), k]
                best.append(k)
                share.append(1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1))
                rate.append(low / np.maximum(np.diff(o), 1))
            cat = lambda x: np.concatenate(x) if x else np.zeros(0)
            k = np.where(letters, cat(best), len(m.langs)).astype(np.int64)
            X.release()
            yield pa.RecordBatch.from_arrays([t.column(0).cast(pa.int64()), pa.array(names[k].tolist(), pa.string()), pa.array(np.where(letters, cat(share), 0.0)), pa.array(cat(rate))], ["id", "lang_pred", "score", "bits_per_byte"])

    rows = spread_out(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(text_col).rlike(r"\p{L}").alias("letters"))
    return rows.mapInArrow(score, "id long, lang_pred string, score double, bits_per_byte double").withColumnRenamed("id", id_col)
