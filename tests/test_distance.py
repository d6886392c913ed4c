import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vicinal.functions import distance as D
from vicinal.schema import CollectionConfig, parse_index, parse_metric


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def slow(metric, a, b):
    dot = sum(x * y for x, y in zip(a, b))
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    match metric:
        case "cosine":
            return 1.0 if na * nb == 0 else max(0, 1 - max(-1, min(1, dot / (na * nb))))
        case "euclidean":
            return math.dist(a, b)
        case "dot_product":
            return -dot
        case "manhattan":
            return sum(abs(x - y) for x, y in zip(a, b))
        case "hamming":
            return sum(x != y for x, y in zip(a, b)) / len(a) if a else 0.0
        case _:
            low, high = sum(map(min, a, b)), sum(map(max, a, b))
            return 1 - (1.0 if not a or (high == 0 and a == b) else 0.0 if high <= 0 else max(0, min(1, low / high)))


CASES = [([1, 2, 3], [4, 5, 6]), ([0, 0], [3, 4]), ([0, 0, 0], [0, 0, 0]), ([-1, -2], [-1, -2]), ([1, 0, 1, 0], [1, 1, 0, 0]), ([1, 2], [-1, -2]), ([0, 0], [1, 1])]


@pytest.mark.parametrize("metric", D.METRICS)
def test_goldens_and_random(spark, metric):
    rng = random.Random(1)
    cases = CASES + [([rng.gauss(0, 1) for _ in range(9)], [rng.gauss(0, 1) for _ in range(9)]) for _ in range(20)]
    rows = spark.createDataFrame([(list(map(float, a)), list(map(float, b))) for a, b in cases], "a array<double>, b array<double>")
    got = [r["d"] for r in rows.select(D.distance(metric, F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == pytest.approx([slow(metric, a, b) for a, b in cases])


def test_known_values(spark):
    assert value(spark, D.dot([1, 2, 3], [4, 5, 6])) == 32
    assert value(spark, D.euclidean_distance([0, 0], [3, 4])) == 5
    assert value(spark, D.similarity("manhattan", [1, 2, 3], [4, 5, 6])) == pytest.approx(0.1)
    assert value(spark, D.jaccard_similarity([1, 0, 1], [1, 1, 0])) == pytest.approx(1 / 3)
    assert value(spark, D.set_jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("a"), F.lit("d")))) == 0.5
    assert value(spark, D.set_jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1
    assert value(spark, D.normalize([0.0, 0.0])) == [0, 0] and value(spark, D.normalize([3.0, 4.0])) == pytest.approx([0.6, 0.8])
    assert value(spark, D.hamming_distance([], [])) == 0 and value(spark, D.jaccard_similarity([], [])) == 1


def test_lengths_must_agree(spark):
    with pytest.raises(Exception, match="length"):
        value(spark, D.dot([1, 2], [1, 2, 3]))
    rows = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>")
    with pytest.raises(Exception, match="length"):
        D.centroid(rows, "v").collect()


def test_scores(spark):
    for metric, d, want in (("cosine", 0.25, 0.75), ("cosine", 1.5, 0), ("euclidean", 1.0, 0.5), ("dot_product", -3.0, 3.0), ("hamming", 0.4, 0.6), ("jaccard", 2.0, 0.0)):
        assert value(spark, D.score(metric, F.lit(d))) == pytest.approx(want)


def test_projection(spark):
    assert value(spark, D.random_projection([1.0, 2.0], 2, 4)) == [1, 2, 0, 0]
    v = [float(i) for i in range(8)]
    matrix = D.projection_matrix(8, 3, 7)
    assert value(spark, D.random_projection(v, 8, 3, 7)) == pytest.approx([sum(a * b for a, b in zip(v, row)) for row in matrix])


def test_centroid_and_sql_functions(spark):
    rows = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0]), ("b", [0.0, 1.0])], "g string, v array<double>")
    assert {r["g"]: r["centroid"] for r in D.centroid(rows, "v", ["g"]).collect()} == {"a": [2, 4], "b": [0, 1]}
    D.register_functions(spark)
    r = spark.sql("SELECT vs_dot(a, b) AS d, vs_cosine(a, b) AS c, vs_euclidean(a, b) AS e, vs_manhattan(a, b) AS m, vs_norm(b) AS n FROM VALUES (array(1D, 0D), array(3D, 4D)) AS t(a, b)").first()
    assert tuple(r) == pytest.approx((3, 0.6, math.sqrt(20), 6, 5))


def test_names_and_configs():
    assert parse_metric(" Dot-Product ") == "dot_product" and parse_metric("dot") == "dot_product" and parse_index(" IVF") == "ivf"
    for bad in (lambda: parse_metric("x"), lambda: parse_index("y"), lambda: CollectionConfig("a", 0)):
        with pytest.raises(ValueError):
            bad()
    c = CollectionConfig("a", 4, "l2" if False else "euclidean", "flat")
    assert CollectionConfig.from_dict(c.to_dict()) == c


@given(st.lists(st.floats(-1e3, 1e3), min_size=1, max_size=6))
@settings(max_examples=15, deadline=None)
def test_distance_to_itself(spark, v):
    assert value(spark, D.euclidean_distance(v, v)) == 0 and value(spark, D.hamming_distance(v, v)) == 0
