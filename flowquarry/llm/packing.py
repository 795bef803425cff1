"""Operator 4: concatenate-and-cut packing.

Pass one tokenizes each partition once and writes the ids with each document's offset inside its partition. The
partitions' totals (one row each) give the partitions' global offsets by a prefix sum. Pass two adds them, cuts the
stream every ``length`` tokens and returns boundary records: one per piece of a document in a sequence. Only the last
sequence is not full. A lost executor changes nothing: the offsets of pass two come from what pass one wrote.

Defined cases: null and empty texts are the end id alone; a long text is spread over as many sequences as it needs;
repeated rows are packed each by itself; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, slices, stash, trim


@dataclass(frozen=True)
class PackConfig:
    tokenizer: str = "byte_bpe_50k.json"
    #: the same vocabulary as ranks, for the fast path; its equality with ``tokenizer`` is tested.
    ranks: str | None = "byte_bpe_50k.tiktoken"
    end_id: int = 1
    length: int = 2048
    memo_chunks: int = 120_000


class Encoder:
    """Ids of texts. A blank before anything but white space always starts a new word in the tokenizer's pattern, so
    texts are encoded in chunks between blanks, and chunks met before are looked up. Texts where that does not hold
    (white space after a blank, the strings of special tokens) are encoded whole."""

    def __init__(self, cfg: PackConfig):
        from tokenizers import Tokenizer

        self.cfg = cfg
        self.whole = Tokenizer.from_file(public_tokenizers.path(cfg.tokenizer))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"
        self.rank = None
        if cfg.ranks:
            import tiktoken

            with open(public_tokenizers.path(cfg.ranks), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.rank = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = np.array([cfg.end_id], self.kind).tobytes()
        self.seen = _Chunks(self)

    def slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids and the end id, as little-endian bytes of ``kind``."""
        if not text:
            return self.end
        if self.rank is None or any(s in text for s in self.special):
            return self.slow(text) + self.end
        head, *rest = text.split(" ")
        seen = self.seen
        if len(seen) > self.cfg.memo_chunks:
            seen.clear()
        try:
            body = b"".join(map(seen.__getitem__, rest))
        except _Whole:
            return self.slow(text) + self.end
        first = np.array(self.rank.encode_ordinary(head), self.kind).tobytes() if head else b""
        return first + body + self.end


class _Whole(Exception):
    """The text cannot be cut into chunks."""


class _Chunks(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace():
            raise _Whole
        ids = np.array(self.encoder.rank.encode_ordinary(" " + chunk), self.encoder.kind).tobytes()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


def tokenize(docs: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """Pass one: (doc_id, ids, n, part, before), written to the shared folder."""

    def part(batches):
        encoder, number, before = Encoder(cfg), TaskContext.get().partitionId(), 0
        width = np.dtype(encoder.kind).itemsize
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], 4_000_000):
                ids = [encoder.encode(t) for t in texts[lo:hi]]
                n = np.array([len(x) // width for x in ids], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array(n), pa.array([number] * (hi - lo), pa.int32()), pa.array(starts)], ["doc_id", "ids", "n", "part", "before"])
        del encoder
        trim()

    kind = dict(docs.dtypes)["doc_id"]
    return stash(by_batches(docs).select("doc_id", "text").mapInArrow(part, f"doc_id {kind}, ids binary, n long, part int, before long"), "pack-ids")


def pack(docs: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """Boundary records: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    tokens = by_batches(tokenize(docs, cfg))
    base, total = {}, 0
    for row in tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n")).orderBy("part").collect():
        base[row.part] = total
        total += row.n
    length = cfg.length
    wide = Encoder(cfg).kind

    def part(batches):
        for b in batches:
            doc, out = [], []
            for i, (ids, n, p, before) in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True)):
                ids = np.frombuffer(ids, wide).astype("<u4")
                at, start = base[p] + before, 0
                while start < n:
                    take = min(n - start, length - at % length)
                    doc.append(i)
                    out.append((start, take, ids[start : start + take].tobytes(), n, at // length, at % length))
                    start += take
                    at += take
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    return tokens.select("doc_id", "ids", "n", "part", "before").mapInArrow(part, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def packed(documents: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """op4: the boundary records with a checksum in place of the ids."""
    return pack(documents, cfg).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
