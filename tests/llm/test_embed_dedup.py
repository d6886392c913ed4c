import numpy as np
import pytest

from vicinal.llm import embed_dedup, rabitq


def make(seed=0, n=60, dim=32):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = [base[i] + rng.normal(size=dim) * s for i in range(0, n, 3) for s in (0.05, 0.1, 0.2, 0.3)]
    hub = [base[0] + rng.normal(size=dim) * 0.05 for _ in range(40)]
    return [list(map(float, v)) for v in [*base, *near, *hub, base[5], base[5], base[7] * 3]]


def slow(rows, threshold=0.95):
    """(id, links, component) by all pairs."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                near[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], int(near[i].sum()), min(rows[j][0] for j in seen)))
    return sorted(out)


@pytest.mark.parametrize("block", [4, 1024])
def test_equals_brute_force(spark, block):
    rows = [(i, v) for i, v in enumerate(make())]
    rows += [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [1.0, None] * 16), (904, [1.0] * 3), (905, [2.0] * 3), (906, [float("inf")] * 32), (907, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, n int, cid string").repartition(3)
    out = embed_dedup.near_vectors(df, recall=0.9999, block=block).collect()
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out)
    assert got == slow(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (0, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert sorted(map(tuple, embed_dedup.near_vectors(df).collect())) == [(0, 2, 0, True), (1, 2, 0, False), (1, 2, 0, False)]
    assert embed_dedup.near_vectors(df.limit(0)).collect() == []


def at_threshold(rng, n, dim=64):
    """n pairs of a cosine just above the threshold, the hardest to meet."""
    base = rng.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return base, base * 0.951 + side * np.sqrt(1 - 0.951**2)


@pytest.mark.parametrize("n", [200, 2000, 6000])
def test_recall_of_the_production_plan(spark, n):
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(np.concatenate(at_threshold(np.random.default_rng(3), n)))], "vec_id bigint, embedding array<double>")
    found = embed_dedup.near_vectors(df).agg({"n_links": "sum"}).first()[0] / 2
    assert 0.96 * n <= found <= n


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    turns = embed_dedup._turns(64, 1)
    assert len(turns) == embed_dedup.ROTATIONS and all(np.allclose(t @ t.T, np.eye(64)) for t in turns)
    x, q = at_threshold(rng, 3000)
    one, two = (rabitq.encode(np.einsum("rde,ne->nrd", turns, v)) for v in (x, q))
    again = rabitq.unpack(rabitq.pack(one), 64, embed_dedup.ROTATIONS)
    assert (again.signs == one.signs).all() and (again.factor == one.factor).all()
    a, b = (rabitq.Told(c, turns, 0.95) for c in (one, two))
    for at in range(0, 3000, 500):
        guess, bound = rabitq.estimate(a.take(slice(at, at + 500)), b.take(slice(at, at + 500)), embed_dedup.EPS)
        error, pairs = guess - x[at : at + 500] @ q[at : at + 500].T, np.arange(500)
        assert abs(error.mean()) < 0.005 and abs(error[pairs, pairs].mean()) < 0.005
        assert (error[pairs, pairs] >= -bound[pairs, pairs]).mean() > 0.99
