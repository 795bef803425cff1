"""Vector search: recall against brute force, exact top-k with ties, odd tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype("f4")
    x[300:420] = x[7]  # a common vector
    x[500:600] *= 3
    rows = [(i, v.tolist(), 0, 0.1) for i, v in enumerate(x)]
    rows += [(2000, None, 0, 0.0), (2020, [0.0] * 16, 0, 0.0), (2040, [float("nan")] * 16, 1, 0.0), (2060, [None] * 16, 1, 0.0), (2100, [1.0] * 3, 1, 0.0), (None, [1.0] * 16, 1, 0.0), rows[3], rows[20], rows[20]]
    return x, spark.createDataFrame(rows, SCHEMA)


def brute(x, ids, queries, k):
    out = {}
    for q in queries:
        s = np.einsum("ij,j->i", x, x[q])
        keep = [i for i in ids if i != q]
        out[q] = sorted(((-s[i], i) for i in keep))[:k]
    return out


def test_collision_search_recall_and_ties(spark, table):
    x, df = table
    got = vectors.approximate_search(df, vectors.SearchConfig(rows_per_block=400, queries_per_block=30)).toPandas()
    x = x.astype(float)
    want = brute(x, range(len(x)), [i for i in range(len(x)) if i % 20 == 0], 20)
    assert set(got.query_id) == set(want)
    hits = sum(len({i for _, i in w} & set(got[got.query_id == q].vec_id)) for q, w in want.items())
    assert hits >= 0.9 * 20 * len(want)
    assert not (got.query_id == got.vec_id).any()
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21))
        assert np.allclose(g.score, [x[q] @ x[i] for i in g.vec_id])
        assert list(zip(-g.score, g.vec_id, strict=True)) == sorted(zip(-g.score, g.vec_id, strict=True))


def test_threshold_search_is_exact(spark, table):
    x, df = table
    got = vectors.exact_search(df, vectors.SearchConfig(k=5, query_step=50, rows_per_block=300, queries_per_block=7)).toPandas()
    y = np.zeros((2021, 16))
    y[: len(x)] = np.floor(x.astype(float) * 256)
    want = brute(y, [*range(len(x)), 2020], [i for i in range(len(x)) if i % 50 == 0], 5)
    assert {q: [(-float(s), i) for s, i in zip(g.sort_values("rank").score, g.sort_values("rank").vec_id, strict=True)] for q, g in got.groupby("query_id")} == {q: [(float(s), i) for s, i in w] for q, w in want.items()}


def test_few_rows_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 1, 0.0), (1, [2.0, 1.0], 1, 0.0), (100, [0.0, -1.0], 1, 0.0)], SCHEMA)
    assert vectors.approximate_search(few).count() == 4 and vectors.exact_search(few).count() == 4
    assert vectors.approximate_search(few.limit(0)).count() == 0 and vectors.exact_search(few.limit(0)).count() == 0


def test_an_invalid_vector_does_not_hide_a_valid_one(spark):
    rows = [(1, [None, 1.0]), (1, [3.0, 4.0]), (1, [2.0, 9.0]), (2, [float("-inf"), 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (3, [5.0, 0.0]), (4, None), (4, [None, None])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: list(r.v) for r in vectors.usable(table, False).collect()} == {1: [2.0, 9.0], 2: [1.0, 1.0], 3: [5.0, 0.0]}
    assert {r.vec_id: list(r.v) for r in vectors.usable(table, True).collect()} == {1: [2.0, 9.0], 2: [1.0, 1.0], 3: [0.0, 0.0]}


@pytest.mark.parametrize("size", [3.0, 3e6, 3e9, 3e15])
def test_large_components_are_exact(spark, size):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * size).tolist(), "b", "p") for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, b string, p string").withColumn("v", F.lit(1)).withColumn("score", F.lit(2))
    got = vectors.exact_search(df).collect()
    top = 2**63 - 1
    clip = lambda s: max(-top, min(top, s))
    ints = {i: [math.floor(c * 256) for c in v] for i, v, *_ in rows}
    for q in (0, 50, 100):
        want = sorted((clip(-sum(a * b for a, b in zip(ints[i], ints[q], strict=True))), i) for i in ints if i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, clip(-s)) for s, i in want]


def test_recall_on_the_real_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").toPandas().dropna()
    x, ids = np.stack([np.asarray(v, float) for v in rows.embedding]), rows.vec_id.to_numpy()
    got = vectors.approximate_search(table).toPandas().groupby("query_id").vec_id.agg(set)
    hits, queries = 0, [i for i, v in enumerate(ids) if v % 20 == 0]
    for i in queries:
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        hits += len(set(ids[order]) & got[ids[i]])
    assert len(got) == len(queries) and hits >= 0.9 * 20 * len(queries)
