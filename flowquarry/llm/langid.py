"""Operator 2: language identification by interpolated Kneser-Ney character models.

A text is cut into lower-cased runs of letters; each run is a sequence between boundary marks, so contexts do not
cross runs. Training counts the n-grams of every labelled row (a word count in each batch, n-grams of its distinct
words, one small shuffle of partial sums). The model holds, for each order, a sorted array of n-gram hashes with the
log probability in every language, and a sorted array of context hashes with the log interpolation weights.
A text gets the language with the lowest cross-entropy per symbol. It is rejected if it has no letters, or if that
cross-entropy lies further above the language's usual one than a text of its length explains.

Defined cases: a null text, or one without letters, gives ``und``, score 0 and accepted false. Ties go to the
alphabetically first language. Repeated rows are scored each by itself. Extra columns are ignored (``identify``
returns only the id and its own columns). Without any labelled row every text gets ``und``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, crc_mod, drop, slices, splitmix, stash, trim

RUN = re.compile(r"[^\W\d_]+")
START, END = "\x02", "\x03"
MULT = splitmix(np.arange(64, dtype=np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class LangConfig:
    order: int = 4
    #: standard deviations above the usual cross-entropy at which a text is rejected.
    reject_z: float = 8.0
    memo_words: int = 150_000
    slice_chars: int = 8_000_000


def runs(token: str) -> list[str]:
    """The lower-cased runs of letters in a token without white space."""
    if token.isalpha():
        return [token.lower()]
    return [w for w in RUN.findall(token.lower()) if any(map(str.isalpha, w))]


def _flat(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all padded words in one array, and the position in it of each symbol to predict."""
    pad = START * (order - 1)
    text = "".join([f"{pad}{w}{END}" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + order for w in words), np.int64, len(words))
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return codes, np.flatnonzero(at >= order - 1)


def _hash(codes: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols that end at each position of ``last``."""
    if not len(last):
        return np.zeros(0, np.uint64)
    n = len(codes) - k + 1
    h = codes[:n] * MULT[0]
    for j in range(1, k):
        h += codes[j : n + j] * MULT[j]
    return h[last - (k - 1)]


def _codes(grams: list[str], k: int) -> np.ndarray:
    """Code points of grams of k symbols, one row for each."""
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, k)


def _keys(codes: np.ndarray) -> np.ndarray:
    k = codes.shape[1]
    return _hash(codes.astype(np.uint64).ravel(), np.arange(k - 1, codes.size, k), k)


def _spell(grams: list[str], k: int) -> np.ndarray:
    return _keys(_codes(grams, k))


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of codes, and the place of each row among them."""
    key = np.zeros(len(codes), np.uint64)
    for symbols in codes.T:
        # A place takes less than 43 bits, a code point 21.
        key = np.unique(key, return_inverse=True)[1].astype(np.uint64) << np.uint64(21) | symbols.astype(np.uint64)
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    return codes[first], at


def count_grams(docs: DataFrame, cfg: LangConfig) -> DataFrame:
    """(lang, gram, n) over all rows of (text, lang); partial sums by task, then one shuffle."""
    order = cfg.order

    def part(batches):
        words: dict[str, Counter] = {}
        found: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text is not None and lang is not None:
                    words.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, words.values())) > 200_000:
                gather(words, found)
                if sum(map(len, found.values())) > 500_000:
                    yield from flush(found)
        gather(words, found)
        yield from flush(found)
        trim()

    def gather(words, found):
        for lang, c in words.items():
            total = found.setdefault(lang, Counter())
            items = [(w, n) for token, n in c.items() for w in runs(token)]
            for lo in range(0, len(items), 100_000):
                some = items[lo : lo + 100_000]
                codes, last = _flat([w for w, _ in some], order)
                weight = np.repeat(np.fromiter((n for _, n in some), np.int64, len(some)), [len(w) + 1 for w, _ in some])
                _, first, inverse = np.unique(_hash(codes, last, order), return_index=True, return_inverse=True)
                sums = np.bincount(inverse, weights=weight).astype(np.int64)
                windows = codes[last[first][:, None] + np.arange(1 - order, 1)].astype("<u4")
                text = windows.tobytes().decode("utf-32-le", "surrogatepass")
                total.update({text[i * order : (i + 1) * order]: n for i, n in enumerate(sums.tolist())})
        words.clear()

    def flush(found):
        for lang, c in found.items():
            keys = list(c)
            for lo in range(0, len(keys), 50_000):
                some = keys[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.string()), pa.array([c[k] for k in some], pa.int64())], ["lang", "gram", "n"])
        found.clear()

    return by_batches(docs).select("text", "lang").mapInArrow(part, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class LangModel:
    langs: list[str]
    order: int
    floor: np.ndarray
    #: by order: hashes sorted, log probabilities (n-gram x language)
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    #: by order: hashes of contexts sorted, log weight of the order below
    contexts: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    #: by language: usual cross-entropy a symbol, variance of a text's mean, variance of a symbol
    usual: np.ndarray | None = None

    def log_probs(self, codes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Log probability of the symbol at each position, in every language."""
        out = np.zeros((len(last), len(self.langs)), np.float32)
        left = np.arange(len(last))
        for k in range(self.order, 0, -1):
            keys, values = self.grams[k]
            h = _hash(codes, last[left], k)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            out[left[hit]] += values[at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            if k > 1:
                keys, values = self.contexts[k]
                h = _hash(codes, last[left] - 1, k - 1)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                out[left[hit]] += values[at[hit]]
        out[left] += self.floor
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """Sum of log probabilities of each word, in every language."""
        codes, last = _flat(words, self.order)
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        return np.add.reduceat(self.log_probs(codes, last), np.cumsum(sizes) - sizes, axis=0)


def build_model(table: pd.DataFrame, cfg: LangConfig) -> LangModel | None:
    """Interpolated Kneser-Ney from (lang, gram, n) of the highest order: continuation counts below it."""
    if table.empty:
        return None
    return _build(table.lang.to_numpy(dtype=object), _codes(table.gram.tolist(), cfg.order), table.n.to_numpy())


def _build(lang: np.ndarray, codes: np.ndarray, n: np.ndarray) -> LangModel:
    langs, col = np.unique(lang.astype(str), return_inverse=True)
    langs, order = langs.tolist(), codes.shape[1]
    grams, at = _distinct(codes)
    c = np.zeros((len(grams), len(langs)))
    np.add.at(c, (at, col), n)
    #: by order: grams, counts, and the place of each gram without its first symbol in the order below
    counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for k in range(order, 0, -1):
        if k == 1:
            counts[1] = (grams, c, np.zeros(len(grams), np.int64))
            break
        fewer, at = _distinct(grams[:, 1:])
        counts[k] = (grams, c, at)
        below = np.zeros((len(fewer), len(langs)))
        np.add.at(below, at, (c > 0).astype(float))
        grams, c = fewer, below
    symbols = len(grams) + 1
    model = LangModel(langs, order, np.log(np.full(len(langs), 1 / symbols, np.float32)))
    lower = np.full((1, len(langs)), 1 / symbols)
    for k in range(1, order + 1):
        grams, c, shorter = counts.pop(k)
        once, twice = (c == 1).sum(0), (c == 2).sum(0)
        d = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
        heads, at = _distinct(grams[:, :-1])
        total, kinds = np.zeros((len(heads), len(langs))), np.zeros((len(heads), len(langs)))
        np.add.at(total, at, c)
        np.add.at(kinds, at, (c > 0).astype(float))
        gamma = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        p = np.maximum(c - d, 0) / np.maximum(total[at], 1) + gamma[at] * lower[shorter]
        keys = _keys(grams)
        by = np.argsort(keys)
        model.grams[k] = (keys[by], np.log(p[by]).astype(np.float32))
        if k > 1:
            keys = _keys(heads)
            by = np.argsort(keys)
            model.contexts[k] = (keys[by], np.log(gamma[by]).astype(np.float32))
        else:
            model.floor = np.log(gamma[0] / symbols).astype(np.float32)
        lower = p
    return model


class _Memo(dict):
    """Numbers tokens in the order in which they come."""

    def __missing__(self, token):
        self[token] = n = len(self)
        return n


class Scorer:
    """Sums a model's word scores over texts; keeps the scores of tokens it has met, up to a bound."""

    def __init__(self, model: LangModel, cfg: LangConfig):
        self.model, self.cfg = model, cfg
        self._reset()

    def _reset(self):
        self.at, self.rows = _Memo(), np.zeros((0, len(self.model.langs) + 1), np.float32)

    def _learn(self, tokens: list[str]) -> np.ndarray:
        """Sums of log probabilities and numbers of symbols of white-space tokens."""
        found = [runs(t) for t in tokens]
        flat = [w for words in found for w in words]
        row = np.zeros((len(tokens), len(self.model.langs) + 1), np.float32)
        if flat:
            each = np.hstack([self.model.words(flat), np.fromiter((len(w) + 1 for w in flat), np.float32, len(flat))[:, None]])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            some = sizes > 0
            row[some] = np.add.reduceat(each, (np.cumsum(sizes) - sizes)[some], axis=0)
        return row

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood (text x language) and number of symbols (0: no letters)."""
        get = self.at.__getitem__
        found = [np.fromiter(map(get, t.split()), np.int64) if t else () for t in texts]
        if len(self.at) > len(self.rows):
            new = list(self.at)[len(self.rows) :]
            self.rows = np.vstack([self.rows, *(self._learn(new[lo : lo + 20_000]) for lo in range(0, len(new), 20_000))])
        out = np.zeros((len(texts), len(self.model.langs) + 1))
        for i, idx in enumerate(found):
            if len(idx):
                out[i] = self.rows[idx].sum(0, dtype=np.float64)
        if len(self.at) > self.cfg.memo_words:
            self._reset()
        return out[:, :-1], out[:, -1]


def _part(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Languages, code points and counts of a batch of (lang, gram, n)."""
    lang = batch.column(0).dictionary_encode()
    grams = batch.column(1).to_pylist()
    return lang.dictionary.to_numpy(zero_copy_only=False)[lang.indices.to_numpy()], _codes(grams, len(grams[0])), batch.column(2).to_numpy()


def train(docs: DataFrame, cfg: LangConfig = LangConfig()) -> LangModel | None:
    """Learn from the text and lang of all rows with both."""
    spark = docs.sparkSession
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    grams = count_grams(rows, cfg)
    # Every n-gram is kept, so that discounts and continuation counts are those of the whole table.
    table = stash(grams, "langid-grams")
    parts = [_part(b) for b in table.toArrow().to_batches(max_chunksize=100_000) if b.num_rows]
    drop(table)
    if not parts:
        return None
    model = _build(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
    del parts
    trim()
    _calibrate(model, _histograms(_score(rows, model, cfg, ["lang"]), model).toPandas())
    return model


#: Width of a bin of cross-entropies, and bins of text lengths for each doubling.
CE_BIN, N_BINS = 0.001, 16


def _histograms(seen: DataFrame, model: LangModel) -> DataFrame:
    """(lang, kind, bin, n) of all rows with letters that get their own language: cross-entropies (ce) and lengths (n)."""
    names = F.array(*[F.lit(x) for x in model.langs])
    own = seen.select("row.lang", "best", "ce", "n").where((F.col("n") > 0) & (F.col("lang") == F.get(names, F.col("best"))))
    ce, n = F.floor(F.col("ce") / CE_BIN), F.floor(F.log2("n") * N_BINS)
    each = F.array(F.struct(F.lit("ce").alias("kind"), ce.alias("bin")), F.struct(F.lit("n").alias("kind"), n.alias("bin")))
    return own.select("lang", F.explode(each).alias("x")).groupBy("lang", "x.kind", "x.bin").agg(F.count("*").alias("n"))


def _median(values: np.ndarray, weights: np.ndarray) -> float:
    by = np.argsort(values)
    total = np.cumsum(weights[by])
    return float(values[by][np.searchsorted(total, total[-1] / 2)])


def _calibrate(model: LangModel, seen: pd.DataFrame) -> None:
    """Median and spread of the cross-entropy of each language, from histograms of all its labelled rows."""

    def usual(s: pd.DataFrame) -> tuple[float, float, float]:
        ce, n = s[s.kind == "ce"], s[s.kind == "n"]
        x, w = (ce.bin.to_numpy() + 0.5) * CE_BIN, ce.n.to_numpy()
        mid = _median(x, w)
        return mid, max(0.05, 1.4826 * _median(np.abs(x - mid), w)), float(2 ** _median((n.bin.to_numpy() + 0.5) / N_BINS, n.n.to_numpy()))

    pooled = usual(seen) if len(seen) else (3.0, 0.05, 50.0)
    found = []
    for lang in model.langs:
        s = seen[seen.lang == lang]
        mid, spread, n = usual(s) if len(s) else pooled
        # So few rows in the whole table tell no spread: such a language is judged no more strictly than all together.
        if s[s.kind == "ce"].n.sum() < 20:
            mid, spread = max(mid, pooled[0]), max(spread, pooled[1])
        found.append((mid, spread**2, 4.0 + spread**2 * n))
    model.usual = np.array(found)


def _score(docs: DataFrame, model: LangModel, cfg: LangConfig, keep: list[str]) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    # The columns to keep travel as one struct, so that their names cannot clash with what is made here.
    row = ", ".join(f"`{k}`: {kinds[k]}" for k in keep)
    schema = f"row struct<{row}>, best int, ce double, n double, score double"

    def part(batches):
        m = shared.value
        scorer = Scorer(m, cfg)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], cfg.slice_chars):
                ll, n = scorer.texts(texts[lo:hi])
                ce = -ll / np.maximum(n, 1)[:, None]
                best = ce.argmin(1)
                low = ce[np.arange(len(best)), best]
                # The posterior of the best language, with the evidence of at most 50 symbols.
                post = 1 / np.exp(-(ce - low[:, None]) * np.minimum(n, 50)[:, None]).sum(1)
                none = n == 0
                cols = [b.column(0).slice(lo, hi - lo), pa.array(np.where(none, -1, best), pa.int32()), pa.array(np.where(none, 0.0, low)), pa.array(n), pa.array(np.where(none, 0.0, np.clip(post, 0, 1)))]
                yield pa.RecordBatch.from_arrays(cols, ["row", "best", "ce", "n", "score"])
        del scorer
        trim()

    return by_batches(docs).select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), "text").mapInArrow(part, schema)


def identify(docs: DataFrame, model: LangModel | None, cfg: LangConfig = LangConfig(), keep: tuple[str, ...] = ("doc_id",), made: tuple[str, ...] = ("lang_pred", "score", "cross_entropy", "accepted")) -> DataFrame:
    """Per row: the columns of ``keep``, and the prediction under the names ``made``."""
    cols = [F.col(f"`{k}`") for k in keep]
    if model is None:
        return docs.select(*cols, F.lit("und").alias(made[0]), F.lit(0.0).alias(made[1]), F.lit(None).cast("double").alias(made[2]), F.lit(False).alias(made[3]))
    scored = _score(docs, model, cfg, list(keep))
    names = F.array(*[F.lit(x) for x in model.langs])
    best, ce, n = F.col("best"), F.col("ce"), F.col("n")
    mid, wide, each = (F.get(F.array(*[F.lit(float(x)) for x in model.usual[:, i]]), best) for i in range(3))
    fits = ce <= mid + cfg.reject_z * F.sqrt(wide + each / F.greatest(n, F.lit(1.0)))
    some = best >= 0
    cols = [F.col(f"row.`{k}`") for k in keep]
    return scored.select(*cols, F.when(some, F.get(names, best)).otherwise("und").alias(made[0]), F.col("score").alias(made[1]), F.when(some, ce).alias(made[2]), F.when(some, fits).otherwise(False).alias(made[3]))


def language_id(documents: DataFrame, cfg: LangConfig = LangConfig()) -> DataFrame:
    """op2: train on rows whose crc32 remainder is not 2, predict every row."""
    held = crc_mod("doc_id", 4) == 2
    model = train(documents.where(~held), cfg)
    return identify(documents, model, cfg).select("doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
