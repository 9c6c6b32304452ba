"""op4 against brute force, at several sizes and spreads of length."""

import numpy as np
import pytest
from brindle.llm import neighbours

TABLE = "/root/testdata/sf0.1/embeddings.parquet"


def _recall(spark, ids, x, every=20, k=20) -> np.ndarray:
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, k=k, every=every).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    out = []
    for j in np.flatnonzero(ids % every == 0):
        s = x @ x[j]
        s[j] = -np.inf
        out.append(len(got.get(ids[j], set()) & set(ids[np.lexsort((ids, -s))[:k]].tolist())) / k)
    return np.array(out)


@pytest.mark.parametrize("n", [600, 1000, 2000, 8000])
@pytest.mark.parametrize("spread", [0, 0.5])
def test_recall(spark, n, spread):
    if n == 8000:
        x, ids = np.random.default_rng(1).normal(size=(n, 64)), np.arange(n)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    else:
        t = spark.read.parquet(TABLE).orderBy("vec_id").limit(n).toPandas()
        x, ids = np.array(t["embedding"].tolist(), float), t["vec_id"].to_numpy()
    x = x * np.random.default_rng(2).lognormal(0, spread, (len(x), 1))
    r = _recall(spark, ids, x)
    print(f"\n{n} vectors, spread {spread}: recall@20 {r.mean():.3f}, least {r.min():.2f}")
    assert r.mean() >= 0.97 and r.min() >= 0.8


def test_every_id_as_query(spark):
    """The two thousand vectors of sf0.1 with uneven lengths, each a query."""
    t = spark.read.parquet(TABLE).toPandas()
    x, ids = np.array(t["embedding"].tolist(), float), t["vec_id"].to_numpy()
    for spread in (0, 0.7):
        r = _recall(spark, ids, x * np.random.default_rng(3).lognormal(0, spread, (len(x), 1)), every=1)
        print(f"\nall ids, spread {spread}: recall@20 {r.mean():.3f}, least {r.min():.2f}")
        assert len(r) == len(x) and r.mean() >= 0.97


@pytest.mark.parametrize("n", [1, 2, 15, 21, 60])
def test_few_vectors(spark, n):
    x = np.random.default_rng(3).normal(size=(n, 64))
    got = neighbours.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), every=1).collect()
    assert len(got) == n * min(20, n - 1)


def test_exact_way(spark):
    x = np.random.default_rng(5).normal(size=(700, 16)) * np.random.default_rng(6).lognormal(0, 1, (700, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in neighbours.search(df, exact=True, block=100).collect()}
    for q in range(0, 700, 20):
        s = x @ x[q]
        s[q] = -np.inf
        for k, i in enumerate(np.argsort(-s, kind="stable")[:20]):
            assert got[q, k + 1][0] == i and abs(got[q, k + 1][1] - s[i]) < 1e-9


def test_hot_copies_and_ties(spark):
    """A third of all rows are one vector; every tie goes to the smaller vec_id."""
    rng = np.random.default_rng(7)
    x = rng.integers(-2, 3, (900, 8)).astype(float)
    x[::3] = x[3]
    x[(x == 0).all(1)] = 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert [got[q][k] for k in range(1, 21)] == [(i, s[i]) for i in np.lexsort((np.arange(900), -s))[:20].tolist()]


def test_scores_are_rounded_once():
    import math

    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 50, 64)) * 10.0 ** rng.integers(-200, 150, (2, 50, 1))
    want = [math.fsum(x) for x in (a * b).tolist()]
    assert np.allclose(neighbours.inner(a, b), want, rtol=1e-12)
    assert neighbours.inner(np.array([[1e16, 1.0, -1e16]]), np.ones((1, 3))).tolist() == [1.0]
