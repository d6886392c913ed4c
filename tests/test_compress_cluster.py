import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.functions import quantize as Q
from vicinal.operators import cluster as C
from vicinal.operators import lloyd, quantized


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalar(spark):
    v = [0.0, 0.25, 0.5, 0.75, 1.0]
    q = value(spark, Q.scalar_quantize(v))
    assert q["codes"] == [0, 64, 128, 191, 255] and (q["lo"], q["hi"]) == (0, 1)
    assert value(spark, Q.scalar_dequantize(Q.scalar_quantize(v))) == pytest.approx(v, abs=0.01)
    assert value(spark, Q.scalar_quantize([0.0, 0.5, 1.0], 1))["codes"] == [0, 0, 1]  # halves to even
    assert value(spark, Q.scalar_quantize([3.0, 3.0]))["codes"] == [0, 0] and value(spark, Q.scalar_dequantize(Q.scalar_quantize([3.0, 3.0]))) == [3, 3]
    assert value(spark, Q.scalar_quantize([]))["codes"] == []
    with pytest.raises(ValueError):
        Q.scalar_quantize(v, 9)


def test_binary(spark):
    v = [1.0, -1.0, 0.0, 2.0, -3.0, 4.0, 5.0, -6.0, 7.0]
    code = value(spark, Q.binary_quantize(v))
    assert code == [0b10010110, 0b10000000] and value(spark, Q.hex_code(Q.binary_quantize(v))) == "9680"
    assert value(spark, Q.binary_dequantize(Q.binary_quantize(v), 9)) == [1 if x > 0 else -1 for x in v]
    assert value(spark, Q.binary_dequantize(Q.binary_quantize(v), 18))[9:] == [-1] * 9 and value(spark, Q.binary_dequantize(Q.binary_quantize(v), 0)) == []
    ints = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, Q.hamming_bytes(ints(255, 1), ints(254))) == 9 and value(spark, Q.binary_quantize([])) == []


def test_product_quantizer(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)]) for i in range(40)], "id bigint, vector array<double>").cache()
    pq = quantized.ProductQuantizer(16, 4, 16).train(rows, max_iters=5)
    coded = rows.select("id", "vector", pq.encode(F.col("vector")).alias("code")).withColumn("again", pq.decode(F.col("code"))).orderBy("id").collect()
    q = coded[0]["vector"]
    adc = {r["id"]: r["distance"] for r in quantized.adc_top_k(rows, pq, q, 40).collect()}
    for r in coded:
        assert len(r["code"]) == 4 and max(r["code"]) < 16
        assert adc[r["id"]] == pytest.approx(sum((a - b) ** 2 for a, b in zip(q, r["again"])))
        for m in range(4):
            part = r["vector"][m * 4 : m * 4 + 4]
            d = [sum((a - b) ** 2 for a, b in zip(part, c)) for c in pq.codebook[m]]
            assert r["code"][m] == d.index(min(d))
    assert quantized.ProductQuantizer.from_dict(pq.to_dict()).codebook == pq.codebook
    assert pq.distance_table(q, "dot_product")[0][0] == pytest.approx(-sum(a * b for a, b in zip(q, pq.codebook[0][0])))
    for bad in ((10, 3, 4), (8, 0, 4), (8, 2, 257)):
        with pytest.raises(ValueError):
            quantized.ProductQuantizer(*bad)
    with pytest.raises(ValueError):
        quantized.ProductQuantizer(4, 2, 2).encode(F.col("vector"))


def blobs(spark, dim=4):
    rng = random.Random(7)
    rows = [(f"i{g}{n:02d}", [(1.0 if j == g else 0.0) + rng.uniform(-0.1, 0.1) for j in range(dim)], '{"category": "c%d", "n": %d, "ok": true}' % (g, n % 2)) for g in range(3) for n in range(10)]
    return spark.createDataFrame(rows, "id string, vector array<double>, metadata string").cache()


def test_kmeans_and_report(spark):
    found = C.kmeans(blobs(spark), 3)
    groups = {}
    for r in found.assignments.collect():
        groups.setdefault(r["cluster"], set()).add(r["id"][:2])
    assert sorted(map(sorted, groups.values())) == [["i0"], ["i1"], ["i2"]]
    assert found.summary["silhouette_score"] > 0.4 and found.summary["converged"] and found.summary["k"] == 3
    rows = found.clusters.collect()
    assert [r["size"] for r in rows] == [10, 10, 10] and all(r["diameter"] >= r["dispersion"] >= 0 for r in rows)
    top = C.top_variant_metadata(found.assignments).collect()
    assert {(r["key"], r["value"], r["count"]) for r in top if r["key"] != "category"} == {("n", "0", 5), ("n", "1", 5), ("ok", "True", 10)}
    again = C.kmeans(blobs(spark), 3)
    assert again.centroids == found.centroids


def test_edge_cases(spark):
    one = blobs(spark).limit(1)
    assert C.kmeans(one, 3).summary["k"] == 1 and C.silhouette(one.withColumn("cluster", F.lit(0)), "cosine").first()[0] == 0
    none = C.kmeans(blobs(spark).filter("false"), 3)
    assert none.summary["k"] == 3 and none.clusters.count() == 0
    assert C.kmeans(blobs(spark), 2, "dot_product").summary["iterations"] == 1
    copies = spark.createDataFrame([(str(i), [1.0, 2.0]) for i in range(5)], "id string, vector array<double>")
    assert C.kmeans(copies, 2, "euclidean").assignments.count() == 5


def test_hierarchical(spark):
    found = C.cluster(blobs(spark), 3, "hierarchical")
    sizes = [r["size"] for r in found.clusters.collect()]
    assert sum(sizes) == 30 and len(sizes) >= 3 and found.summary["silhouette_score"] > 0.3 and found.summary["method"] == "hierarchical"
    assert found.assignments.select("id").distinct().count() == 30


def test_silhouette_by_definition(spark):
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(12, 3)), [0, 0, 0, 0, 1, 1, 1, 1, 1, 2, 2, 3]
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], c[i]) for i in range(12)], "id bigint, vector array<double>, cluster int")
    s = []
    for i in range(12):
        mean = lambda g: np.mean([np.linalg.norm(x[i] - x[j]) for j in range(12) if j != i and c[j] == g])
        if c.count(c[i]) == 1:
            s.append(0.0)
            continue
        a, b = mean(c[i]), min(mean(g) for g in set(c) - {c[i]})
        s.append((b - a) / max(a, b))
    assert C.silhouette(rows, "euclidean").first()[0] == pytest.approx(np.mean(s))


def test_seeds_are_drawn_by_squared_distance(spark):
    rows = spark.createDataFrame([(i, [float(i == 9) * 100.0 + i * 1e-3]) for i in range(10)], "id bigint, vector array<double>")
    picks = [lloyd.seed_plus_plus(rows, 2, "euclidean", seed) for seed in range(6)]
    assert all(any(v[0] > 50 for v in p) for p in picks)


def test_step_plan_and_nulls(spark):
    """A Lloyd round is one Python pass that gives a row a cluster and task; rows without a whole vector do not count."""
    from vicinal.operators.lloyd import step

    rows = [(i, [float(i % 3), 1.0 + i]) for i in range(600)] + [(900, None), (901, [1.0, None])]
    frame = spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(4)
    out = step(frame, [[0.0, 0.0], [1.0, 300.0], [0.0, 1e9]], "euclidean")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    got = {r["cluster"]: (r["n"], r["centroid"]) for r in out.collect()}
    near = [min((0, 1, 2), key=lambda c: (round(((v[0] - (0, 1, 0)[c]) ** 2 + (v[1] - (0, 300, 1e9)[c]) ** 2) ** 0.5, 12), c)) for _, v in rows[:600]]
    for c in set(near):
        own = [v for (_, v), x in zip(rows, near) if x == c]
        assert got[c][0] == len(own)
        assert all(abs(a - sum(col) / len(own)) < 1e-9 for a, col in zip(got[c][1], zip(*own)))
    assert set(got) == set(near) == {0, 1}
    assert step(frame.filter("id < 0"), [[0.0, 0.0]], "euclidean").collect() == []


def test_hierarchy_by_levels(spark, monkeypatch):
    """Passes follow depth and rounds, not nodes; groups are told apart; every row has a leaf."""
    import random

    from vicinal.operators import cluster as C

    rng = random.Random(3)
    middle = [[rng.gauss(0, 30) for _ in range(6)] for _ in range(16)]
    rows = [(i, [x + rng.gauss(0, 0.5) for x in middle[i % 16]]) for i in range(640)]
    frame = spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(3)
    passes = []
    real = C.summed
    monkeypatch.setattr(C, "summed", lambda *a, **b: passes.append(1) or real(*a, **b))
    found = C.hierarchical(frame, 4, 2, 4, "euclidean", report=False)
    leaves = {r["id"]: r["cluster"] for r in found.assignments.select("id", "cluster").collect()}
    assert len(leaves) == 640 and sorted(set(leaves.values())) == list(range(len(set(leaves.values()))))
    assert len(passes) <= 2 * C.ROUNDS + 1  # of up to 1 + 4 nodes with 15 rounds each
    inertia = sum(r["inertia"] for r in found.clusters.collect())
    whole = C.kmeans(frame, 1, "euclidean", report=False).clusters.first()["inertia"]
    assert inertia < 0.35 * whole
    assert sum(r["size"] for r in found.clusters.collect()) == 640
    few = C.hierarchical(frame.limit(3), 2, 3, 4, "euclidean", report=False)
    assert {r["cluster"] for r in few.assignments.collect()} == {0}
    same = C.hierarchical(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], frame.schema), 2, 3, 4, "euclidean", report=False)
    assert {r["cluster"] for r in same.assignments.collect()} == {0}
