"""Operators 3 and 6: vector search by collision counting and by the threshold algorithm.

Rows are dealt into blocks of bounded size by a hash of their id; the stated query set is dealt into blocks as well,
and every block of queries meets every block of rows once (blocks are joined on their numbers, not crossed). Each
meeting returns the k best of a query in that block, and a top-k merge keeps the k best of all.

Operator 3 (QALSH-style): a block holds its vectors, scaled to one length by an extra coordinate so that the largest
inner product is the nearest point, projected on ``projections`` random lines, each line sorted. A query's windows on
all lines are centred on its own projection; their width grows by the factor ``grow`` (virtual rehashing) until enough
vectors lie in at least ``collide`` windows. Those are verified with exact inner products.

Operator 6 (Fagin): a block holds its integer vectors and, for every dimension, their order. A query reads all lists
from the end its component favours, one depth after another, scores what it meets, and stops in the block as soon as
the sum over the lists at the current depth cannot reach the kth best score.

Defined cases: vectors that are null, hold null or non-finite components (operator 3: or are zero) take no part, as
queries or candidates; vectors whose length differs from the most common one take no part; a repeated vec_id counts
once, with the least of its valid vectors; a null vec_id takes no part; equal scores go to the smaller vec_id; an empty table gives
no rows; extra columns are ignored. Operator 6 scores in 64-bit integers where 53 bits may not be enough, and in
unbounded ones beyond; components and scores outside 64 bits count as the nearest 64-bit number, so such scores tie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


@dataclass(frozen=True)
class SearchConfig:
    k: int = 20
    query_step: int = 20
    rows_per_block: int = 8192
    queries_per_block: int = 2048
    #: operator 3
    projections: int = 96
    collide: float = 0.7
    #: share of a block, beyond k, that must collide before a query's windows stop growing
    verify: float = 0.16
    first: float = 0.3
    grow: float = 1.12
    seed: int = 11


def usable(embeddings: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, v): one row for each id; v is an array of doubles without null or non-finite components."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size(v) > 0)
    if not zero:
        fine &= F.exists(v, lambda x: x != 0)
    # Validity comes first: an invalid vector must not stand for its id.
    valid = embeddings.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return valid.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding")).select("vec_id", v.alias("v"))


def _meet(rows: DataFrame, cfg: SearchConfig, search, schema: str) -> DataFrame:
    """Apply search(rows, queries) to every meeting of a block of rows with a block of queries."""
    rows = stash(rows, "vectors")
    is_query = F.col("vec_id") % cfg.query_step == 0
    shape = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).orderBy(F.desc("n"), "d").first()
    if shape is None:
        return rows.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("v") == shape.d)
    # 4 blocks at least, so that small inputs use several tasks as well
    nb, nq = max(4, -(-shape.n // cfg.rows_per_block)), max(1, -(-shape.q // cfg.queries_per_block))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(nb)).cast("int")
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(nq)).cast("int")
    base = rows.select("vec_id", "v", block.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("p"))
    asks = rows.where(is_query).select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("b"), part.alias("p"))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        left, right = left.sort_values("vec_id"), right.sort_values("vec_id")
        return search(left.vec_id.to_numpy(), np.stack(left.v.to_numpy()), right.vec_id.to_numpy(), np.stack(right.v.to_numpy()))

    return base.groupBy("b", "p").cogroup(asks.groupBy("b", "p")).applyInPandas(pair, schema)


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: the blocks return k each, so a query's rows are bounded by k times the blocks."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    rows = found.groupBy("query_id").agg(best.alias("x")).select("query_id", F.posexplode("x").alias("i", "x"))
    return rows.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _frame(rows: list[tuple[int, np.ndarray, np.ndarray]], kind=np.float64) -> pd.DataFrame:
    if not rows:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return pd.DataFrame({"query_id": np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]), "vec_id": np.concatenate([r[1] for r in rows]), "score": np.concatenate([r[2] for r in rows]).astype(kind)})


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class CollisionIndex:
    """Sorted projections of a block's distinct vectors."""

    def __init__(self, vectors: np.ndarray, cfg: SearchConfig):
        self.cfg, self.vectors = cfg, vectors
        norms = np.sqrt((vectors * vectors).sum(1))
        self.reach = norms.max()
        lifted = np.hstack([vectors, np.sqrt(np.maximum(self.reach**2 - norms**2, 0))[:, None]]) / self.reach
        lines = np.random.default_rng(cfg.seed).normal(size=(lifted.shape[1], cfg.projections))
        self.lines = lines[:-1]
        places = lifted @ lines
        self.order = np.argsort(places, axis=0).T.copy().astype(np.int32)
        self.sorted = np.take_along_axis(places, self.order.T.astype(np.int64), axis=0).T.copy()

    def candidates(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each query the vectors that collide with it on enough lines; all queries' windows grow together."""
        cfg, n, m = self.cfg, len(self.vectors), self.cfg.projections
        own = (queries / np.sqrt((queries * queries).sum(1, keepdims=True)) @ self.lines).T
        wanted, need = min(n, int(cfg.k + cfg.verify * n) + 1), int(np.ceil(cfg.collide * m))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        active = np.arange(len(queries))
        lo = np.stack([np.searchsorted(self.sorted[j], own[j]) for j in range(m)])
        hi, counts = lo.copy(), np.zeros((len(queries), n), np.int16)
        # The first width takes in about a share ``first`` of a line's range.
        width = max(0.05, cfg.first * float(np.mean(self.sorted[:, -1] - self.sorted[:, 0])) / 2)
        while len(active):
            left = np.stack([np.searchsorted(self.sorted[j], own[j, active] - width) for j in range(m)])
            right = np.stack([np.searchsorted(self.sorted[j], own[j, active] + width, "right") for j in range(m)])
            going = []
            for i, q in enumerate(active.tolist()):
                bounds = zip(left[:, i].tolist(), lo[:, q].tolist(), hi[:, q].tolist(), right[:, i].tolist(), strict=True)
                met = [x for j, (a, b, c, d) in enumerate(bounds) for x in (self.order[j, a:b], self.order[j, c:d])]
                counts[q] += np.bincount(np.concatenate(met), minlength=n).astype(np.int16)
                some = np.flatnonzero(counts[q] >= need)
                if len(some) >= wanted or (not left[:, i].any() and (right[:, i] == n).all()):
                    out[q] = some
                else:
                    going.append(q)
            lo[:, active], hi[:, active] = left, right
            active = np.array(going, np.int64)
            width *= cfg.grow
        return out


def approximate_search(embeddings: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """op3: (query_id, rank, vec_id, score)."""

    def search(ids, vectors, query_ids, queries):
        distinct, inverse = np.unique(vectors, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        by = np.argsort(inverse, kind="stable")  # ids ascend within a vector
        starts = np.searchsorted(inverse[by], np.arange(len(distinct) + 1))
        index, rows = CollisionIndex(distinct, cfg), []
        found = (c for lo in range(0, len(queries), 256) for c in index.candidates(queries[lo : lo + 256]))
        for q, x, some in zip(query_ids.tolist(), queries, found, strict=True):
            # Summed in one fixed order for every vector, so equal vectors have equal scores in every block.
            scores = np.einsum("ij,j->i", distinct[some], x)
            # k + 1 ids of a vector are enough: one may be the query's own.
            order = np.argsort(-scores, kind="stable")[: cfg.k + 1] if len(some) > 4 * cfg.k else np.arange(len(some))
            if len(some) > 4 * cfg.k:
                order = np.flatnonzero(scores >= scores[order[-1]])
            members = [by[starts[d] : starts[d + 1]][: cfg.k + 1] for d in some[order]]
            at = np.concatenate(members) if members else np.zeros(0, np.int64)
            s = np.repeat(scores[order], [len(m) for m in members])
            keep = ids[at] != q
            at, s = at[keep], s[keep]
            best = _top(ids[at], s, cfg.k)
            rows.append((q, ids[at][best], s[best]))
        return _frame(rows)

    return _merge(_meet(usable(embeddings, zero=False), cfg, search, "query_id long, vec_id long, score double"), cfg.k)


class ThresholdIndex:
    """A block's integer vectors and their order in every dimension."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(vectors, self.order.astype(np.int64), axis=0)

    def top(self, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(ids)
        dims = np.flatnonzero(query)
        up = query[dims] > 0
        seen = np.zeros(n, bool)
        place = int(np.searchsorted(ids, own))
        if place < n and ids[place] == own:
            seen[place] = True
        at, scores = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        depth, step = 0, 32
        while depth < n:
            end = min(n, depth + step)
            # A list is read from its largest values where the query's component is positive, else from its smallest.
            rise = self.order[n - end : n - depth][:, dims[up]] if up.any() else np.zeros((0, 0), np.int32)
            fall = self.order[depth:end][:, dims[~up]] if (~up).any() else np.zeros((0, 0), np.int32)
            mark = np.zeros(n, bool)
            mark[rise.ravel()] = True
            mark[fall.ravel()] = True
            mark &= ~seen
            new = np.flatnonzero(mark)
            seen[new] = True
            at, scores = np.concatenate([at, new]), np.concatenate([scores, self.vectors[new] @ query])
            depth, step = end, step * 2
            if len(at) > k:
                best = _top(ids[at], scores, k)
                at, scores = at[best], scores[best]
            bound = (self.sorted[n - depth, dims[up]] * query[dims[up]]).sum() + (self.sorted[depth - 1, dims[~up]] * query[dims[~up]]).sum()
            # Unseen vectors score the bound at most; one that equals the kth could have a smaller id.
            if len(at) == k and bound < scores.min():
                break
        if not len(dims):
            rest = np.flatnonzero(~seen)
            at, scores = np.concatenate([at, rest]), np.concatenate([scores, np.zeros(len(rest), scores.dtype)])
        best = _top(ids[at], scores, k)
        return ids[at[best]], scores[best]


def exact_search(embeddings: DataFrame, cfg: SearchConfig = SearchConfig(k=5, query_step=50)) -> DataFrame:
    """op6: (query_id, rank, vec_id, score) on floor(256 * x)."""
    rows = usable(embeddings, zero=True).withColumn("v", F.transform("v", lambda x: F.floor(x * 256).cast("long")))

    def search(ids, vectors, query_ids, queries):
        most = float(np.abs(vectors.astype(float)).max()) * float(np.abs(queries.astype(float)).max()) * vectors.shape[1]
        if most >= 2.0**62:
            return _frame([(q, *unbounded_top(ids, vectors, x, q, cfg.k)) for q, x in zip(query_ids.tolist(), queries, strict=True)], np.int64)
        kind = np.float64 if most < 2.0**53 else np.int64
        index, out = ThresholdIndex(vectors.astype(kind)), []
        for q, x in zip(query_ids.tolist(), queries.astype(kind), strict=True):
            out.append((q, *index.top(ids, x, q, cfg.k)))
        return _frame(out, np.int64)

    return _merge(_meet(rows, cfg, search, "query_id long, vec_id long, score long"), cfg.k)


def unbounded_top(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by unbounded integers, for components whose products leave 64 bits."""
    x = [int(v) for v in query]
    top = int(np.iinfo(np.int64).max)
    scores = (sum(a * b for a, b in zip(map(int, row), x, strict=True)) for row in vectors)
    found = sorted((-max(-top, min(top, s)), i) for i, s in zip(ids.tolist(), scores, strict=True) if i != own)[:k]
    return np.array([i for _, i in found], np.int64), np.array([-s for s, _ in found], np.int64)
