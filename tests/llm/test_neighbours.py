import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesift.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, every, k):
    found = {}
    for i, q in zip(ids, vectors, strict=True):
        if i % every == 0:
            scores = [(-(q @ v) / (np.linalg.norm(q) * np.linalg.norm(v)), j) for j, v in zip(ids, vectors, strict=True) if j != i]
            found[i] = [j for _, j in sorted((round(s, 9), j) for s, j in scores)[:k]]
    return found


def brute_sets(vectors, every, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found = {}
    for q in range(0, len(unit), every):
        scores = unit @ unit[q]
        scores[q] = -2
        found[q] = set(np.argpartition(-scores, k)[:k].tolist())
    return found


@pytest.mark.parametrize("size, bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbouring_cells(size, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * size, indexing="ij"), -1).reshape(-1, size)
    keys = neighbours.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_recall_and_scores(spark):
    random_ = np.random.default_rng(1)
    vectors = random_.normal(size=(3000, 32)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    found = neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), block=512).collect()
    exact, double = brute(range(3000), vectors.astype(float), 50, 5), vectors.astype(float)
    got = {}
    for r in sorted(found, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
        q, v = double[r.query_id], double[r.vec_id]
        assert math.isclose(r.score, q @ v / (np.linalg.norm(q) * np.linalg.norm(v)), abs_tol=1e-12)
    assert set(got) == set(exact) and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(exact[q])) for q in exact) / (5 * len(exact)) >= 0.9


def test_comparisons_and_recall_of_the_window(spark):
    """With windows of their real share, vectors without structure are compared less often than by a plain scan."""
    size, setting = 20_000, neighbours.Orderings(least=1)
    vectors = np.random.default_rng(3).normal(size=(size, 64)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], SCHEMA)
    places = spark.range(size).select(F.explode(F.array(*map(F.lit, range(setting.count)))).alias("ordering"), F.col("id").alias("place"))
    looked_at = neighbours._windows(places, size, setting).agg(F.sum(F.col("high") - F.col("low") + 1)).first()[0]
    assert looked_at / size < 0.9 * size
    got = {}
    for r in neighbours.nearest_neighbours(frame, 100, setting=setting, block=1024, queries=64).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    exact = brute_sets(vectors.astype(float), 100, 5)
    assert all(len(v) == 5 for v in got.values()) and set(got) == set(exact)
    assert sum(len(got[q] & exact[q]) for q in exact) / (5 * len(exact)) >= 0.9


def test_blocks_with_many_queries(spark):
    """Copies of a block for some of its queries each change nothing."""
    vectors = np.random.default_rng(4).normal(size=(600, 16))
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    setting = neighbours.Orderings(4, 4, 5, 0.3, 1)
    few, many = (sorted(map(tuple, neighbours.nearest_neighbours(frame, 2, 5, setting, block=300, queries=n).collect())) for n in (100, 10_000))
    whole = neighbours.nearest_neighbours(frame, 2, 5, neighbours.Orderings(1, 4, 5, 1.0, 1), block=200)
    exact = brute_sets(vectors, 2, 5)
    assert len(few) == 300 * 5 and [r[:3] for r in few] == [r[:3] for r in many]
    assert sum(r[2] in exact[r[0]] for r in few) / len(few) >= 0.8
    assert all(r.vec_id in exact[r.query_id] for r in whole.collect())


def test_common_vector_and_ties(spark):
    random_ = np.random.default_rng(2)
    vectors = random_.normal(size=(900, 8))
    vectors[::3] = vectors[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows + rows[:5], "vec_id long, embedding array<double>, label int")
    got = {}
    for r in neighbours.nearest_neighbours(frame, block=10_000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(range(900), vectors, 50, 5)
    assert got[150] == [0, 3, 6, 9, 12]


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (50, [0.9, 0.1], 1), (1, [1.0, 1.0], 1), (2, None, 1), (3, [], 1), (4, [0.0, 0.0], 1), (5, [1.0, nan], 1),
            (6, [1.0, None], 1), (7, [1.0, float("inf")], 1), (100, [1.0, 2.0, 3.0], 1), (None, [1.0, 0.0], 1), (1, [1.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "2 AS v", "'x' AS asks")
    got = neighbours.nearest_neighbours(frame).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert neighbours.nearest_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
