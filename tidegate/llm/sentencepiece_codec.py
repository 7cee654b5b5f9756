"""SentencePiece encoding and decoding by batched Viterbi search.

A text gets a space before it, and is divided before each space that follows something else; a space is the mark of a
word's start. Pieces hold spaces at their start only, or are runs of spaces, so no piece spans a division, and a run of
spaces is encoded with the word after it. The distinct words, with the spaces before them, are encoded once in a chunk. Words of equal length advance together: at each end every start is tried, the
substring's hash probes the sorted hashes of the pieces, and maxima over starts are kept as backpointers. The path
with the largest sum of the file's scores wins, on equal sums the longest last piece. A byte that no piece covers is a
byte piece, at a cost greater than any path of pieces has. Decoding joins the pieces, so it gives the text back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import text as X
from tidegate.session import ship, spread_out

U = np.uint64
MARK = "▁"
CHUNK = 2 << 20
#: longer words don't advance together (few have the same length): each probes the keys with all its substrings at once
TOGETHER = 96


def pieces_of(path: str) -> tuple[list[tuple[bytes, int, float]], list[int]]:
    """(piece, id, score) of a sentencepiece model file, the mark as a space, and the ids of the 256 byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = [(sp.id_to_piece(i).replace(MARK, " ").encode(), i, sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    # a space after something else would span words: such pieces are the only ones that can't be kept (the given file has none)
    return [x for x in plain if x[0] and b" " not in x[0].lstrip(b" ")], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


class Codec:
    def __init__(self, pieces: list[tuple[bytes, int, float]], byte_ids: list[int]):
        self.by_piece = {p: (i, s) for p, i, s in pieces}
        self.longest = max(map(len, self.by_piece), default=1)
        self.byte_ids = np.array(byte_ids, np.int32)
        self.worst = -1e3 * (1 + max((abs(s) for *_, s in pieces), default=1))
        words = list(self.by_piece)
        data = np.frombuffer(b"".join(words), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        h = X.span_hash(X.prefix_hash(data), off[:-1], off[1:])
        order = np.argsort(h)
        self.keys = h[order]
        self.ids = np.array([self.by_piece[words[i]][0] for i in order], np.int32)
        self.scores = np.array([self.by_piece[words[i]][1] for i in order])
        self.maybe = np.zeros(1 << 20, bool)  # leading bits of the keys: most other substrings stop here
        self.maybe[(self.keys >> U(44)).astype(np.int64)] = True
        size = 1 + max([*byte_ids, *(i for _, i, _ in pieces)])
        text = [b""] * size
        for p, i, _ in pieces:
            text[i] = p
        for b, i in enumerate(byte_ids):
            text[i] = bytes([b])
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_at = np.concatenate([[0], np.cumsum([len(x) for x in text])]).astype(np.int64)

    def _look(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys, or -1."""
        out = np.full(len(h), -1, np.int64)
        i = np.flatnonzero(self.maybe[(h >> U(44)).astype(np.int64)])
        p = np.minimum(np.searchsorted(self.keys, h[i]), len(self.keys) - 1)
        ok = self.keys[p] == h[i]
        out[i[ok]] = p[ok]
        return out

    def _equal(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of one length, as (counts, ids one word after the other). words: a row of bytes for each."""
        m, n = words.shape
        up, down = X.powers(n + 1)
        h = np.zeros((n + 1, m), U)
        np.cumsum((words.T.astype(U) + U(1)) * up[:n, None], axis=0, out=h[1:])
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0
        back, piece = np.zeros((n + 1, m), np.int16), np.zeros((n + 1, m), np.int32)
        for j in range(1, n + 1):
            best[j] = best[j - 1] + self.worst
            back[j], piece[j] = j - 1, self.byte_ids[words[:, j - 1]]
            for i in range(j - 1, max(0, j - self.longest) - 1, -1):
                p = self._look(X.mix((h[j] - h[i]) * down[i] + U((j - i) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)))
                k = np.flatnonzero(p >= 0)
                if len(k):
                    s = best[i, k] + self.scores[p[k]]
                    w = s >= best[j, k]
                    k = k[w]
                    best[j, k], back[j, k], piece[j, k] = s[w], i, self.ids[p[k]]
        at, row, steps = np.full(m, n), np.arange(m), []
        while len(row):
            steps.append((row, piece[at, row]))
            at = back[at, row].astype(np.int64)
            row, at = row[at > 0], at[at > 0]
        counts = np.bincount(np.concatenate([r for r, _ in steps]), minlength=m)
        first = np.cumsum(counts)
        out = np.empty(counts.sum(), np.int32)
        for k, (r, ids) in enumerate(steps):  # the last piece comes first
            out[first[r] - 1 - k] = ids
        return counts, out

    def _one(self, word: np.ndarray) -> np.ndarray:
        """Pieces of one word of any length: the substrings of each length probe the keys together, then maxima go from byte to byte."""
        n = len(word)
        h, at = X.prefix_hash(word), np.arange(n)
        best, back, piece = [0.0] * (n + 1), [0] * (n + 1), [0, *self.byte_ids[word].tolist()]
        starts, places = [], []
        for size in range(1, min(n, self.longest) + 1):
            p = self._look(X.span_hash(h, at[: n - size + 1], at[size - 1 :] + 1))
            starts.append(np.flatnonzero(p >= 0))
            places.append(p[starts[-1]])
        ends = np.concatenate([s + k + 1 for k, s in enumerate(starts)])
        order = np.argsort(ends, kind="stable")  # shorter pieces first: of equal sums the longest wins
        p = np.concatenate(places)[order]
        of = np.searchsorted(ends[order], np.arange(n + 2)).tolist()
        start, score, ids = np.concatenate(starts)[order].tolist(), self.scores[p].tolist(), self.ids[p].tolist()
        for j in range(1, n + 1):
            b, i = best[j - 1] + self.worst, j - 1
            for k in range(of[j], of[j + 1]):
                if (s := best[start[k]] + score[k]) >= b:
                    b, i, piece[j] = s, start[k], ids[k]
            best[j], back[j] = b, i
        out, j = [], n
        while j:
            out.append(piece[j])
            j = back[j]
        return np.array(out[::-1], np.int32)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and their offsets."""
        n = len(off) - 1
        full = np.flatnonzero(np.diff(off) > 0)
        lead = np.zeros(n + 1, np.int64)
        lead[full + 1] = 1
        new = off + np.cumsum(lead)  # offsets with a space before each row that isn't empty
        text = np.full(new[-1], 0x20, np.uint8)
        text[np.arange(len(data)) + np.repeat(np.cumsum(lead)[1:], np.diff(off))] = data
        begins = text == 0x20
        begins[1:] &= text[:-1] != 0x20
        begins[new[full]] = True  # a row that ends with spaces before it doesn't go on
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(text))[: len(starts)]
        size = ends - starts
        _, first, word = np.unique(X.span_hash(X.prefix_hash(text), starts, ends), return_index=True, return_inverse=True)
        counts = np.zeros(len(first), np.int64)
        parts, where = [], []
        for length in np.unique(size[first]):
            k = np.flatnonzero(size[first] == length)
            s = starts[first[k]]
            if length <= TOGETHER:
                c, ids = self._equal(text[s[:, None] + np.arange(length)])
            else:
                found = [self._one(text[i : i + length]) for i in s]
                c, ids = np.array([len(x) for x in found]), np.concatenate(found)
            counts[k] = c
            parts.append(ids)
            where.append(k)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        at = np.zeros(len(first), np.int64)
        if where:
            k = np.concatenate(where)
            at[k] = np.concatenate([[0], np.cumsum(counts[k])[:-1]])
        c = counts[word]
        to = np.concatenate([[0], np.cumsum(c)])
        out = ids[np.repeat(at[word] - to[:-1], c) + np.arange(to[-1])]
        return out, to[np.searchsorted(starts, new)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of rows of ids, and their offsets: the pieces joined, without the space before the row."""
        size = np.diff(self.text_at)[ids]
        to = np.concatenate([[0], np.cumsum(size)])
        text = self.text[np.repeat(self.text_at[ids] - to[:-1], size) + np.arange(to[-1])]
        off = to[at]
        full = np.flatnonzero(np.diff(off) > 0)
        keep = np.ones(len(text), bool)
        keep[off[full][text[off[full]] == 0x20]] = False
        return text[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def _codec(sent) -> Codec:
    if _kept.get("of") != sent.id:
        _kept.update(of=sent.id, codec=Codec(*sent.value))
    return _kept["codec"]


class _Sent:
    """A broadcast model, with a name by which a worker keeps what it builds from it."""

    def __init__(self, spark, model):
        self.b = spark.sparkContext.broadcast(model)
        self.id = f"{spark.sparkContext.applicationId}-{hash((tuple(model[0]), tuple(model[1])))}"

    @property
    def value(self):
        return self.b.value


_kept: dict = {}


def encode(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(id_col, ids, round_trip, *keep) for every row of ``docs``. keep: columns that go with their rows. round_trip: the ids decode to the text's bytes.

    Null and empty texts have no ids (and round_trip true). Words of any length and all bytes are encoded: a mark that
    a text holds itself is encoded by bytes. Repeated rows, equal and null ids give one row each; an empty table gives
    an empty result; other columns aren't read. ``model`` is a tokenizer's vocabulary: it doesn't grow with the data. Ids are
    integers or null.
    """
    ship(docs.sparkSession)
    sent = _Sent(docs.sparkSession, model)

    def run(batches):
        codec = _codec(sent)
        for t in batches:
            data, off = X.column_bytes(t.column(1))
            for a, b in X.pieces(off, CHUNK):
                part, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
                ids, at = codec.encode(part, o)
                back, back_at = codec.decode(ids, at)
                same = np.diff(back_at) == np.diff(o)
                if not (len(back) == len(part) and same.all() and (back == part).all()):
                    same = np.array([np.array_equal(back[back_at[r] : back_at[r + 1]], part[o[r] : o[r + 1]]) for r in range(b - a)])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([t.column(0)[a:b].cast(pa.int64()), lists, pa.array(same), *(t.column(2 + k)[a:b] for k in range(len(keep)))], ["id", "ids", "round_trip", *keep])
            X.release()

    types = dict(docs.dtypes)
    schema = ", ".join(["id long, ids array<int>, round_trip boolean", *(f"`{c}` {types[c]}" for c in keep)])
    return spread_out(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep)).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model: tuple, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) for every row: null ids give the empty text; ids that make no UTF-8 give the replacement character."""
    ship(rows.sparkSession)
    sent = _Sent(rows.sparkSession, model)

    def run(batches):
        codec = _codec(sent)
        for t in batches:
            lists = t.column(1).to_pylist()
            at = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            ids = np.array([i for x in lists for i in x or ()], np.int64)
            text, off = codec.decode(ids, at)
            out = [text[off[r] : off[r + 1]].tobytes().decode(errors="replace") for r in range(len(lists))]
            yield pa.RecordBatch.from_arrays([t.column(0).cast(pa.int64()), pa.array(out, pa.string())], ["id", "text"])

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
