"""Operator 10: quality classifier, a hashed word n-gram logistic regression learnt by follow-the-regularised-leader.

A text's words are its lower-cased runs of letters and digits and its runs of marks; its features are the hashed
single words and word pairs, with weight log(1 + count), scaled to unit length, plus a constant. Training uses a
bounded sample of the labelled rows (``train_rows``, drawn by a hash of the doc_id, whole texts); FTRL-proximal goes
over it ``epochs`` times. A score is the logistic of a sparse dot product.

Defined cases: null and empty texts have the constant feature alone. Rows whose label is null or other than 0 or 1
are not learnt from; several labels of one document are several examples. Without any label every score is 0.5.
Repeated rows are scored each by itself; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, crc_mod, slices, splitmix

WORD = re.compile(r"\w+|[^\w\s]+")


@dataclass(frozen=True)
class QualityConfig:
    bits: int = 18
    #: labelled rows that are learnt from, at most about so many.
    train_rows: int = 12_000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    threshold: float = 0.3
    memo_words: int = 400_000
    slice_chars: int = 4_000_000


class Hasher:
    """Hashed word n-grams of texts. A word's own hash is kept for words met before, up to a bound."""

    def __init__(self, cfg: QualityConfig):
        self.cfg, self.seen = cfg, {}

    def _words(self, tokens: list[str]) -> np.ndarray:
        """Hashes of the words of white-space tokens, in order."""
        seen = self.seen
        new = [t for t in set(tokens) if t not in seen]
        if new:
            found = [WORD.findall(t.lower()) for t in new]
            flat = [w for words in found for w in words]
            # A polynomial over code points, the words side by side.
            text = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            sizes = np.fromiter(map(len, flat), np.int64, len(flat))
            starts = np.cumsum(sizes) - sizes
            place = np.arange(len(text)) - np.repeat(starts, sizes)
            h = splitmix(np.add.reduceat(splitmix(text + (place.astype(np.uint64) << np.uint64(32))), starts)).tobytes()
            lo = 0
            for t, words in zip(new, found, strict=True):
                seen[t] = h[lo : lo + 8 * len(words)]
                lo += 8 * len(words)
        return np.frombuffer(b"".join(map(seen.__getitem__, tokens)), np.uint64)

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices (sorted, distinct; 0 is the constant) and weights."""
        tokens = text.split() if text else []
        if not tokens:
            return np.zeros(1, np.int64), np.ones(1, np.float32)
        h = self._words(tokens)
        if len(self.seen) > self.cfg.memo_words:
            self.seen = {}
        pairs = splitmix(h[:-1] * np.uint64(3) + h[1:])
        idx = (np.concatenate([h, pairs]) >> np.uint64(64 - self.cfg.bits)).astype(np.int64)
        idx, n = np.unique(idx[idx > 0], return_counts=True)
        x = np.log1p(n).astype(np.float32)
        x /= np.sqrt(float((x * x).sum())) or 1.0
        return np.concatenate([[0], idx]), np.concatenate([np.ones(1, np.float32), x])


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], cfg: QualityConfig) -> np.ndarray:
    """Weights after follow-the-proximally-regularised-leader updates, one example at a time."""
    z, n = np.zeros(1 << cfg.bits), np.zeros(1 << cfg.bits)
    order = np.random.default_rng(7)

    def weights(z, n):
        return np.where(np.abs(z) <= cfg.l1, 0.0, -(z - np.sign(z) * cfg.l1) / ((cfg.beta + np.sqrt(n)) / cfg.alpha + cfg.l2))

    for _ in range(cfg.epochs):
        for i in order.permutation(len(examples)):
            idx, x, y = examples[i]
            zi, ni = z[idx], n[idx]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            more = ni + g * g
            z[idx] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / cfg.alpha * w
            n[idx] = more
    return weights(z, n).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> np.ndarray | None:
    """Learn from (doc_id, text) and (doc_id, quality). Ids and labels of the sample are bounded, so they are broadcast."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    total = known.count()
    if not total:
        return None
    share = min(1.0, cfg.train_rows / total)
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def part(batches):
        hasher = Hasher(cfg)
        for b in batches:
            for i, (text, y) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                idx, x = hasher.features(text)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([y], pa.int32()), pa.array([idx.astype("<i4").tobytes()]), pa.array([x.astype("<f4").tobytes()])], ["doc_id", "y", "idx", "x"])

    joined = by_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    kind = dict(docs.dtypes)["doc_id"]
    rows = joined.select("doc_id", "text", "quality").mapInArrow(part, f"doc_id {kind}, y int, idx binary, x binary").toPandas().sort_values(["doc_id", "y"], kind="stable")
    if rows.empty:
        return None
    return ftrl([(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(np.float64), y) for i, x, y in zip(rows.idx, rows.x, rows.y, strict=True)], cfg)


def score(docs: DataFrame, weights: np.ndarray | None, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text)."""
    if weights is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def part(batches):
        w, hasher = shared.value, Hasher(cfg)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], cfg.slice_chars):
                dots = []
                for t in texts[lo:hi]:
                    idx, x = hasher.features(t)
                    dots.append(float(w[idx] @ x))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))))], ["doc_id", "score"])

    return by_batches(docs).select("doc_id", "text").mapInArrow(part, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def quality(documents: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """op10: learn from labels whose crc32 remainder is not 0, score every row."""
    weights = train(documents, labels.where(crc_mod("doc_id", 5) != 0), cfg)
    return score(documents, weights, cfg).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= cfg.threshold).cast("int").alias("predicted"))
