"""Operator 1: SentencePiece encoding and decoding over a piece lattice.

Substrings of bounded length are looked up in the piece table; the hits are the edges of each word's lattice, and a
fold over a word's edges picks its path. The public model is a BPE model: its right path is the one its merges reach
(highest score first, leftmost first), which a best-sum Viterbi path is not, so the fold applies the merges.

Two forms share this definition. ``relational_words`` does it with DataFrame operations (explode, broadcast join to the
piece table, group by word, ``aggregate``). ``encode`` does it by batches in columns inside each task (explode and join
as sorted-hash lookups, one fold over all new words side by side), with no shuffle: a shuffle of every word occurrence
would be several times the input. A word is cut before its blanks, since no piece continues over one.

Defined cases: null texts have null ids and null decoding; empty texts have no ids; repeated rows are encoded each by
itself; an empty table gives no rows; characters without a piece become byte pieces (or the unknown piece, in a model
without them); extra columns are ignored. Models with another type or normalisation than this one raise an error.
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batches, drop, slices, splitmix, stash

BLANK = "▁"
MULT = splitmix(np.arange(100, 400, dtype=np.uint64)) | np.uint64(1)
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
LONG = 48


@dataclass(frozen=True)
class PieceConfig:
    model: str = "piece_bpe_32k.model"
    memo_words: int = 300_000
    slice_chars: int = 4_000_000


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffers message."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 5:
            value = struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        elif kind == 1:
            value = data[at : at + 8]
            at += 8
        else:
            size = varint()
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class Model:
    """Pieces of a model file; looks substrings up and folds merges."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.names, self.scores, self.kinds = [], [], []
        trainer, normal = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.names.append(piece[1].decode())
                self.scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        used = set(self.kinds)
        if trainer.get(3) != 2 or normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not used <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only byte-pair models with identity normalisation and a dummy prefix are supported")
        self.ids = {n: i for i, n in enumerate(self.names) if self.kinds[i] == NORMAL}
        if any(BLANK in n.lstrip(BLANK) for n in self.ids):
            raise ValueError("a piece continues over a blank")
        self.byte = {int(n[3:5], 16): i for i, n in enumerate(self.names) if self.kinds[i] == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.most = max(map(len, self.ids))
        self.rank = np.array(self.scores, np.float64)
        self.kind = "<u2" if len(self.names) <= 1 << 16 else "<u4"
        self.tables = {}
        for k in range(1, self.most + 1):
            some = [n for n in self.ids if len(n) == k]
            if some:
                codes = np.frombuffer("".join(some).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(-1, k)
                h = (codes * MULT[:k]).sum(1, dtype=np.uint64)
                by = np.argsort(h)
                self.tables[k] = (h[by], np.array([self.ids[n] for n in some], np.int32)[by])
        self.raw = [bytes([int(n[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else n.replace(BLANK, " ").encode() for n, t in zip(self.names, self.kinds, strict=True)]

    def edges(self, codes: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Piece of each (place, length), or -1; room is the number of symbols left in the word."""
        out = np.full((len(codes), self.most + 1), -1, np.int32)
        h = np.zeros(len(codes), np.uint64)
        for k in range(1, self.most + 1):
            h = h[: len(codes) - k + 1] + codes[k - 1 :] * MULT[k - 1]
            if k in self.tables:
                keys, ids = self.tables[k]
                at = np.flatnonzero(room[: len(h)] >= k)
                place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
                hit = keys[place] == h[at]
                out[at[hit], k] = ids[place[hit]]
        return out

    def spell(self, text: str) -> list[int]:
        """Ids of symbols without a piece."""
        return [self.byte[b] for b in text.encode("utf-8", "replace")] if self.byte else [self.unknown]

    def fold(self, words: list[str]) -> list[bytes]:
        """Ids of words, all merged side by side."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        ends = np.repeat(np.cumsum(sizes), sizes)
        owner = np.repeat(np.arange(len(words)), sizes)
        edges = self.edges(codes, ends - np.arange(len(codes)))
        following = np.arange(1, len(codes) + 1)  # where the symbol that starts here ends
        live = np.ones(len(codes), bool)
        at = np.arange(len(codes))  # starts of symbols in words that still merge
        while len(at):
            nxt = following[at]
            inner = nxt < ends[at]
            p = at[inner]
            last = following[nxt[inner]]
            fits = last - p <= self.most
            p, last = p[fits], last[fits]
            piece = edges[p, last - p]
            p, last, piece = p[piece >= 0], last[piece >= 0], piece[piece >= 0]
            if not len(p):
                break
            word, score = owner[p], self.rank[piece]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.maximum.reduceat(score, first), np.diff(np.r_[first, len(p)]))
            top = np.flatnonzero(score == best)
            top = top[np.r_[True, word[top][1:] != word[top][:-1]]]
            live[following[p[top]]] = False
            following[p[top]] = last[top]
            at = at[live[at]]
            going = np.zeros(len(words), bool)
            going[word[top]] = True
            at = at[going[owner[at]]]
        starts = np.flatnonzero(live)
        ids = edges[starts, np.minimum(following[starts] - starts, self.most)]
        whose = owner[starts]
        cuts = np.searchsorted(whose, np.arange(len(words) + 1))
        plain = ids.astype(self.kind).tobytes()
        width = np.dtype(self.kind).itemsize
        odd = set(whose[ids < 0].tolist())
        out = []
        for w in range(len(words)):
            lo, hi = cuts[w], cuts[w + 1]
            if w in odd:
                base = int(ends[starts[lo]] - sizes[w])
                flat = [x for s, i in zip(starts[lo:hi].tolist(), ids[lo:hi].tolist(), strict=True) for x in ([i] if i >= 0 else self.spell(words[w][s - base]))]
                out.append(np.array(flat, self.kind).tobytes())
            else:
                out.append(plain[lo * width : hi * width])
        return out

    def fold_long(self, word: str) -> bytes:
        """Ids of one long word: the same merges from a queue, in n log n."""
        n = len(word)
        end, start = list(range(1, n + 1)), list(range(-1, n - 1))  # by symbol start: its end, the start of the one before
        alive = [True] * n
        queue = []

        def offer(p):
            q = end[p]
            if q < n and end[q] - p <= self.most and (i := self.ids.get(word[p : end[q]])) is not None:
                heapq.heappush(queue, (-self.scores[i], p, q, end[q]))

        for p in range(n):
            offer(p)
        while queue:
            _, p, q, last = heapq.heappop(queue)
            if not (alive[p] and end[p] == q and q < n and alive[q] and end[q] == last):
                continue
            alive[q] = False
            end[p] = last
            if last < n:
                start[last] = p
            if start[p] >= 0:
                offer(start[p])
            offer(p)
        ids, p = [], 0
        while p < n:
            i = self.ids.get(word[p : end[p]])
            ids += [i] if i is not None else self.spell(word[p : end[p]])
            p = end[p]
        return np.array(ids, self.kind).tobytes()


def split_words(text: str | None) -> list[str]:
    """The words of a text, each without the blank that starts it; more blanks in a row, or at an end, belong to one word."""
    parts = text.split(" ") if text else []
    if "" in parts or (text and BLANK in text):
        return [w[1:] for w in re.findall(f"{BLANK}+[^{BLANK}]*", BLANK + text.replace(" ", BLANK))]
    return parts


class Encoder:
    """Ids of texts; keeps the ids of words met before, up to a bound."""

    def __init__(self, cfg: PieceConfig):
        self.cfg, self.model, self.seen = cfg, Model(public_tokenizers.path(cfg.model)), {}

    def texts(self, texts: list[str | None]) -> list[bytes | None]:
        found = list(map(split_words, texts))
        seen = self.seen
        new = [w for w in set().union(*found) if w not in seen] if found else []
        short = [w for w in new if len(w) < LONG]
        for lo in range(0, len(short), 20_000):
            some = short[lo : lo + 20_000]
            seen.update(zip(some, self.model.fold([BLANK + w for w in some]), strict=True))
        for w in new:
            if len(w) >= LONG:
                seen[w] = self.model.fold_long(BLANK + w)
        out = [None if t is None else b"".join(map(seen.__getitem__, parts)) for t, parts in zip(texts, found, strict=True)]
        if len(seen) > self.cfg.memo_words:
            seen.clear()
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.model.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text.removeprefix(" ")


def encode(docs: DataFrame, cfg: PieceConfig = PieceConfig()) -> DataFrame:
    """(doc_id, ids, decoded_same) of (doc_id, text): ids as an array, and whether decoding them gives the text again."""

    def part(batches):
        encoder = Encoder(cfg)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], cfg.slice_chars):
                found = encoder.texts(texts[lo:hi])
                arrays = [None if x is None else np.frombuffer(x, encoder.model.kind) for x in found]
                same = [None if x is None else encoder.decode(x) == t for x, t in zip(arrays, texts[lo:hi], strict=True)]
                sizes = np.cumsum([0, *(0 if x is None else len(x) for x in arrays)])
                flat = np.concatenate([x for x in arrays if x is not None] or [np.zeros(0, np.int32)]).astype(np.int32)
                null = pa.array([x is None for x in arrays])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat), mask=null)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists, pa.array(same, pa.bool_())], ["doc_id", "ids", "decoded_same"])

    return by_batches(docs).select("doc_id", "text").mapInArrow(part, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded_same boolean")


def decode(encoded: DataFrame, cfg: PieceConfig = PieceConfig()) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def part(batches):
        encoder = Encoder(cfg)
        for b in batches:
            texts = [None if x is None else encoder.decode(np.array(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(part, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, id, score): a few ten thousand rows, whatever the input."""
    return spark.createDataFrame([(n, i, float(model.scores[i])) for n, i in model.ids.items()], "piece string, id int, score double")


def relational_words(words: DataFrame, model: Model) -> DataFrame:
    """(word, ids) of distinct (word): the lattice by explode, equi-join with the piece table and group by word; a fold
    by ``aggregate`` applies the merges: of the edges over two neighbouring symbols the best, leftmost first, drops the
    bound between them.

    Every substring is kept in the group, with a null id where it is no piece, so the edge from a place over a length is
    found by its position and a step of the fold is linear in the symbols that are left.
    """
    most = model.most
    pieces = piece_table(words.sparkSession, model)
    place = words.select("word", F.length("word").alias("n"), F.explode(F.sequence(F.lit(1), F.length("word"))).alias("s"))
    sub = place.select("word", "n", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("n") - F.col("s") + 1))).alias("k")).withColumn("piece", F.expr("substring(word, s, k)"))
    found = sub.join(F.broadcast(pieces), "piece", "left").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("s", "k", "score", "id"))).alias("e"))
    # Where the edges from place s (from 0 on) begin: all places before have ``most`` edges, but for the last ones of the word.
    first = "s * {m} - if(s > n - {m}, (s - greatest(n - {m}, 0)) * (s - greatest(n - {m}, 0) - 1) div 2 + if(n < {m}, s * ({m} - n), 0), 0)".format(m=most)
    edge = lambda a, z: f"element_at(e, cast({first.replace('s ', f'{a} ').replace('(s', f'({a}')} as int) + {z} - {a})"
    step = f"""(b, i) -> if(b.done, b, aggregate(
        transform(sequence(0, greatest(size(b.at) - 3, 0)), j -> if(j + 2 < size(b.at) and b.at[j + 2] - b.at[j] <= {most}, struct({edge('b.at[j]', 'b.at[j + 2]')}.score as score, -j as j), struct(cast(null as double) as score, -j as j))),
        struct(cast(null as double) as score, 0 as j), (x, y) -> if(y.score is not null and (x.score is null or y > x), y, x),
        x -> if(x.score is null, struct(b.at as at, true as done), struct(concat(slice(b.at, 1, 1 - x.j), slice(b.at, 3 - x.j, size(b.at))) as at, false as done))))"""
    bounds = F.expr(f"aggregate(sequence(1, n), struct(sequence(0, n) as at, false as done), {step}, b -> b.at)")
    raw = "transform(sequence(1, octet_length(c)), z -> conv(substring(hex(c), 2 * z - 1, 2), 16, 10))"
    spelled = f"transform({raw}, y -> element_at(array({', '.join(str(model.byte.get(x, model.unknown)) for x in range(256))}), cast(y as int) + 1))" if model.byte else f"array({model.unknown})"
    ids = F.expr(f"flatten(transform(sequence(0, size(at) - 2), j -> if({edge('at[j]', 'at[j + 1]')}.id is not null, array({edge('at[j]', 'at[j + 1]')}.id), transform(array(substring(word, at[j] + 1, at[j + 1] - at[j])), c -> {spelled})[0])))")
    return found.withColumn("n", F.length("word")).select("word", "n", "e", bounds.alias("at")).select("word", ids.alias("ids"))


def relational_encode(docs: DataFrame, cfg: PieceConfig = PieceConfig(), broadcast_words: int = 300_000) -> DataFrame:
    """(doc_id, ids) of (doc_id, text) by the relational form: the distinct words of each task are made distinct by a
    shuffle, their lattices are joined and folded, and the ids go back to the texts, from a broadcast of the word table
    while it is small, else by a join of every row's distinct words. Long words are folded from a queue."""
    model = Model(public_tokenizers.path(cfg.model))
    by_batches(docs)

    def distinct(batches):
        seen: set[str] = set()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(split_words(t))
            if len(seen) > cfg.memo_words:
                yield pa.RecordBatch.from_arrays([pa.array([BLANK + w for w in seen], pa.string())], ["word"])
                seen = set()
        yield pa.RecordBatch.from_arrays([pa.array([BLANK + w for w in seen], pa.string())], ["word"])

    def long(batches):
        for b in batches:
            found = [np.frombuffer(model.fold_long(w), model.kind).tolist() for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["word", "ids"])

    words = stash(docs.select("text").mapInArrow(distinct, "word string").distinct(), "piece-words")
    short = F.length("word") < LONG
    table = relational_words(words.where(short), model).unionByName(words.where(~short).mapInArrow(long, "word string, ids array<int>"))
    table = stash(table, "piece-table")
    drop(words)
    kind = dict(docs.dtypes)["doc_id"]

    def compose(text: str | None, ids: dict) -> list[int] | None:
        return None if text is None else [x for w in split_words(text) for x in ids[w]]

    if table.count() <= broadcast_words:
        shared = docs.sparkSession.sparkContext.broadcast({r.word[1:]: r.ids for r in table.collect()})

        def part(batches):
            for b in batches:
                found = [compose(t, shared.value) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

        return docs.select("doc_id", "text").mapInArrow(part, f"doc_id {kind}, ids array<int>")

    def pairs(batches):
        for b in batches:
            own = [[BLANK + w for w in set(split_words(t))] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), list(map(len, own)))), pa.array([w for x in own for w in x], pa.string())], ["row", "word"])

    def joined(batches):
        for b in batches:
            found = [compose(t, {x["word"][1:]: x["ids"] for x in m or ()}) for t, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = stash(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "piece-rows")
    met = rows.select("row", "text").mapInArrow(pairs, "row long, word string").join(table, "word").groupBy("row").agg(F.collect_list(F.struct("word", "ids")).alias("m"))
    return rows.join(met, "row", "left").select("doc_id", "text", "m").mapInArrow(joined, f"doc_id {kind}, ids array<int>")


def piece_ids(documents: DataFrame, cfg: PieceConfig = PieceConfig()) -> DataFrame:
    """op1: ids, their number and whether they decode to the text."""
    return encode(documents, cfg).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_same")
