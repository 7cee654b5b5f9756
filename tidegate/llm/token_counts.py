"""Word-piece counts by a linear longest-match automaton.

The vocabulary's trie gets failure links and, for each link, the number of pieces that greedy longest match has settled
by then. Folded into one dense table they give, for any state and byte, the next state and the number of pieces popped,
so a text's count is a sum over its bytes and no piece is built. A state's own count at a word's end is the pops of
running off its end.

A word is a maximal run of bytes other than ASCII white space, with the mark of a word's start before it; pieces are
matched greedily, longest first, and a byte that no piece covers counts as a piece of its own (byte fallback).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import automaton
from tidegate.llm import text as X
from tidegate.session import ship

MARK = "▁"
#: bytes of a text are one symbol each; all white space is one more
GAP, WIDTH = 256, 257
_kept: dict[int, "Automaton"] = {}


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a sentencepiece model file, with the mark of a word's start as one space; control and byte pieces left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return sorted({p.replace(MARK, " ").encode() for p in map(sp.id_to_piece, ids)})


class Automaton:
    """next and pops at state * WIDTH + symbol: the next state and the pieces popped. Pieces with a mark inside a word never match."""

    def __init__(self, pieces: list[bytes]):
        pieces = sorted({*(p for p in pieces if p and b" " not in p[1:]), *(bytes([b]) for b in range(256))})
        nodes = {b"": 0}
        levels: list[list[bytes]] = [[b""]]
        for p in pieces:
            for n in range(1, len(p) + 1):
                if p[:n] not in nodes:
                    nodes[p[:n]] = len(nodes)
                    while len(levels) <= n:
                        levels.append([])
                    levels[n].append(p[:n])
        token = np.zeros(len(nodes), bool)
        token[[nodes[p] for p in pieces]] = True
        to = np.zeros((len(nodes), WIDTH), np.int32)
        pops = np.zeros((len(nodes), WIDTH), np.int32)
        fail, popped = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        self.start = start = nodes[b" "]
        for level in levels:
            at = np.array([nodes[p] for p in level])
            if level != [b""]:
                up = np.array([nodes[p[:-1]] for p in level])
                last = np.array([p[-1] for p in level])
                # a piece pops itself; other nodes pop what their parent's failure link goes on to pop
                own = token[at] | (up == 0)
                fail[at] = np.where(own, 0, to[fail[up], last])
                popped[at] = np.where(own, 1, popped[up] + pops[fail[up], last])
                to[at] = to[fail[at]]
                pops[at] = pops[fail[at]] + popped[at, None]
            to[at, GAP] = start
            deeper = levels[len(level[0]) + 1] if len(level[0]) + 1 < len(levels) else []
            if deeper:
                u = np.array([nodes[p[:-1]] for p in deeper])
                b = np.array([p[-1] for p in deeper])
                to[u, b] = [nodes[p] for p in deeper]
                pops[u, b] = 0
        # a mark with no word behind it is no word: its end pops nothing
        pops[start, GAP] = 0
        self.next = to.reshape(-1)
        self.pops = pops.astype(np.uint8 if pops.max() < 256 else np.int32).reshape(-1)

    def counts(self, data: np.ndarray, off: np.ndarray, lanes: int = 1024) -> np.ndarray:
        """Pieces of each row."""
        n = len(off) - 1
        codes = np.full(len(data) + n, GAP, np.int64)
        at = off + np.arange(n + 1)
        place = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(off))
        codes[place] = np.where(X.SPACE[data], GAP, data.astype(np.int64))
        gaps = np.flatnonzero(codes == GAP) + 1  # stretches start behind a gap, where the state is known
        want = np.arange(0, len(codes), max(64, len(codes) // lanes))
        starts = np.unique(np.append(0, gaps[np.minimum(np.searchsorted(gaps, want), len(gaps) - 1)])) if len(gaps) else np.zeros(0, np.int64)
        starts = starts[starts < len(codes)]
        out = np.zeros(len(codes), self.pops.dtype)

        def visit(t, places, index):
            out[places] = self.pops[index]

        automaton.run(codes, starts, np.diff(np.append(starts, len(codes))), self.next, WIDTH, self.start, visit)
        return X.sums(out.astype(np.int64), at)


def token_counts(docs: DataFrame, pieces: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_tokens) for every row of ``docs``.

    Null and empty texts, and texts of white space alone, have 0 words and 0 tokens. Repeated rows, equal and null ids
    give one row each; an empty table gives an empty result; other columns aren't read. ``pieces`` is the tokenizer's
    vocabulary, which doesn't grow with the data; each Python worker builds its table from it once. Ids are
    integers or null.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def count(batches):
        key = hash(tuple(sent.value))
        if key not in _kept:
            _kept.clear()
            _kept[key] = Automaton(sent.value)
        a = _kept[key]
        for t in batches:
            data, off = X.column_bytes(t.column(1))
            tokens, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in X.pieces(off):
                part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                tokens.append(a.counts(part, o))
                words.append(np.diff(X.words(part, o, ~X.SPACE[part])[2]))
            yield pa.RecordBatch.from_arrays([t.column(0).cast(pa.int64()), pa.array(np.concatenate(words)), pa.array(np.concatenate(tokens))], ["id", "n_words", "n_tokens"])
            X.release()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "id long, n_words long, n_tokens long").withColumnRenamed("id", id_col)
