import numpy as np
import pytest

from vicinal.operators import knn, radius

SCHEMA = "id bigint, vector array<double>"


def grouped(n, seed=0, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 5
    return [(i, (centres[rng.integers(12)] + rng.normal(size=dim) * 0.3).tolist()) for i in range(n)]


def brute(left, right, r, metric):
    a, b = (np.array([v for _, v in rows]) for rows in (left, right))
    d = knn._distances(metric, a, b)
    return sorted((left[i][0], right[j][0]) for i, j in zip(*np.nonzero(d <= r)))


def ids(frame):
    return sorted((r["left_id"], r["right_id"]) for r in frame.collect())


@pytest.mark.parametrize("metric,r", [("euclidean", 0.9), ("euclidean", 0.0), ("manhattan", 2.0), ("cosine", 0.01), ("cosine", 1.2), ("hamming", 0.5), ("dot_product", -150.0), ("jaccard", 0.1)])
def test_equals_brute_force(spark, metric, r, monkeypatch):
    """For all metrics, with rows of a cell cut into many blocks."""
    monkeypatch.setattr(radius, "QUERY_ROWS", 16)
    monkeypatch.setattr(radius, "ITEM_ROWS", 16)
    left, right = grouped(60), grouped(200)[60:] + [(500, [0.0] * 8)] * 2 + [(600 + i, grouped(60)[3][1]) for i in range(40)]
    if metric in ("hamming", "jaccard"):
        left, right = ([(i, np.abs(np.round(v)).tolist()) for i, v in rows] for rows in (left, right))
    frames = [spark.createDataFrame(rows, SCHEMA).repartition(3) for rows in (left, right)]
    want = brute(left, right, r, metric)
    assert want and ids(radius.radius_join(*frames, r, metric, pivots=10)) == want


def test_pivots_spare_most_pairs_of_grouped_vectors(spark):
    rows = grouped(600)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = radius.pruned(frame, frame, 0.5).first()
    assert got["n_left"] == got["n_right"] == 600 and got["share"] > 0.8
    assert got["compared"] == round((1 - got["share"]) * 600 * 600)
    every = radius.pruned(frame, frame, 0.5, pivots=0).first()
    assert every["compared"] == 360_000 and every["share"] == 0


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 0.0]), (5, [float("inf"), 0.0]), (6, []), (7, [1.0, 0.0]), (7, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert ids(radius.radius_join(frame, frame, 0.1)) == sorted((a, b) for a in (1, 7, 7) for b in (1, 7, 7))
    assert ids(radius.radius_join(frame, frame.limit(0), 0.1)) == [] and ids(radius.radius_join(frame.limit(0), frame, 0.1)) == []
    assert ids(radius.radius_join(frame, frame, -1.0)) == []
    assert radius.pruned(frame, frame.limit(0), 0.1).first()["share"] == 0
