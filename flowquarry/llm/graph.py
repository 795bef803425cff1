"""Connected components by alternating star contraction: every round few shuffles of edges, no vertex gathered whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stash


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges' components as stars: (least vertex, other vertex)."""
    if not len(u):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above
    child = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[child]], ids[child]


def _contract(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The edges of each task as stars, so that no more than a spanning forest of them is shuffled."""

    def part(batches):
        held, n = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n > most:
                held = [stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                n = len(held[0][0])
                if 2 * n > most:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["u", "v"])
                    held, n = [], 0
        if held:
            u, v = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for lo in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[lo : lo + 100_000]), pa.array(v[lo : lo + 100_000])], ["u", "v"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(part, "u long, v long")


def _large(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a vertex to the least of the vertex and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Link a vertex and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, root) of every vertex of (u, v) but the roots: root is the least vertex that is reachable."""
    first = stash(_contract(edges.where("u <> v")), "cc")
    now = stash(_small(first), "cc")
    drop(first)
    for _ in range(most_rounds):
        # Settled: every vertex has at most one edge up, and then none from below.
        ends = now.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(now.select("v", F.lit(0), F.lit(1)))
        sums = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not sums.where("up > 1 or (up = 1 and down = 1)").limit(1).count():
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        last, now = now, stash(_small(_large(now)), "cc")
        drop(last)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
