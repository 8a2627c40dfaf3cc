"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callwatch.llm import vector_search

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)], SCHEMA)


def exact(ids, x, k=20):
    """Each query's k best of other ids; ids are distinct."""
    found = {}
    for q in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]
        found[int(ids[q])] = [(int(ids[i]), scores[i]) for i in order]
    return found


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(found, true):
    return sum(len({v for v, _ in found.get(q, [])} & {v for v, _ in best}) for q, best in true.items()) / sum(map(len, true.values()))


@pytest.mark.parametrize("kind", ["isotropic", "clusters", "lengths"])
def test_recall(spark, kind, monkeypatch):
    monkeypatch.setattr(vector_search, "CELL_ROWS", 500)
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 300)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2500, 24))
    if kind == "clusters":
        x = x * 0.2 + rng.standard_normal((12, 24))[rng.integers(0, 12, 2500)]
    if kind == "lengths":
        x *= rng.lognormal(0, 0.5, 2500)[:, None]
    x = x.astype(np.float32).astype(np.float64)
    ids = rng.permutation(2500) * 3
    true, found = exact(ids, x), got(vector_search.nearest_neighbours(table(spark, x, ids)))
    assert recall(found, true) >= 0.93 and set(found) == set(true)
    for q, best in found.items():
        assert len(best) == 20 and [(-s, v) for v, s in best] == sorted((-s, v) for v, s in best)
        at = {int(i): v for i, v in zip(ids, x)}
        assert np.allclose([s for _, s in best], [at[v] @ at[q] for v, _ in best], rtol=0, atol=1e-12)


def test_clusters_need_few_leaves():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((12, 24))[rng.integers(0, 12, 6000)] * 3 + rng.standard_normal((6000, 24)) * 0.2
    forest = vector_search.fit_forest(x, 6000, float(np.sqrt((x * x).sum(axis=1).max())))
    assert forest.budget < 0.5


def test_copies_are_ties_by_id(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(2)
    x = np.concatenate([np.tile(rng.standard_normal(8), (700, 1)), rng.standard_normal((300, 8))]).astype(np.float32).astype(np.float64)
    ids = rng.permutation(1000)
    true, found = exact(ids, x), got(vector_search.nearest_neighbours(table(spark, x, ids)))
    hot = {int(i) for i in ids[:700]}
    for q in set(true) & hot:
        assert found[q] == true[q]


def test_unusable_vectors_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1, 0], [0, 1], [0, 0], None, [nan, 1], [inf, 1], [None, 1], [], [1, 2, 3], [-1, -1], [0.0, -0.0]]
    df = table(spark, vectors, [0, 1, 2, 3, 4, 5, 6, 7, 8, 20, 40]).unionByName(spark.createDataFrame([(None, [5.0, 5.0], 0)], SCHEMA))
    assert got(vector_search.nearest_neighbours(df)) == {0: [(1, 0.0), (20, -1.0)], 20: [(0, -1.0), (1, -1.0)]}
    odd = df.withColumns({c: F.lit("?") for c in ("cell", "part", "kind", "leaves", "score", "rank", "query_id", "vector")})
    assert got(vector_search.nearest_neighbours(odd)) == got(vector_search.nearest_neighbours(df))
    for empty in (df.filter("false"), df.filter("vec_id in (2, 3)")):
        assert vector_search.nearest_neighbours(empty).count() == 0


def test_rows_that_share_an_id_are_one_answer(spark):
    df = table(spark, [[1, 0], [1, 0], [2, 0], [0, 1], [3, 3]], [0, 0, 1, 1, 2])
    assert got(vector_search.nearest_neighbours(df)) == {0: [(2, 3.0), (1, 2.0)]}
