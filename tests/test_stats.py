import math

import pytest
from pyspark.sql import functions as F

from vicinal.operators import stats


def test_latency_report():
    got = stats.latency_report([i / 1000 for i in range(1, 101)])
    assert (got["p50_ms"], got["p95_ms"], got["p99_ms"]) == (51, 96, 100) and got["mean_ms"] == pytest.approx(50.5) and got["qps"] == pytest.approx(100 / 5.05)
    assert stats.latency_report([])["qps"] == 0 and stats.latency_report([0.25])["p99_ms"] == 250


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", None), ("b", 3.0)], "g string, v double")
    assert {r["g"]: tuple(r)[1:] for r in stats.percentiles(df, "v", "g").collect()} == {"a": (100, 50, 95, 99), "b": (1, 3, 3, 3)}


def test_random_vectors(spark):
    v = stats.random_vector(8, 3)
    assert v == stats.random_vector(8, 3) != stats.random_vector(8, 4) and sum(x * x for x in v) == pytest.approx(1)
    rows = stats.with_random_vectors(spark.range(20), 5, name="v").collect()
    assert all(math.isclose(sum(x * x for x in r["v"]), 1) for r in rows) and len({tuple(r["v"]) for r in rows}) == 20
    assert stats.with_random_vectors(spark.range(1), 3, normalized=False).select(F.size("vector")).first()[0] == 3
