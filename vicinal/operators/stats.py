"""Figures of benchmark runs: percentiles by place, queries a second, random test vectors."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.functions.distance import normalize

#: The percentiles of a report.
PERCENTILES = (0.5, 0.95, 0.99)
#: Ranges that a group is cut into.
BUCKETS = 64


def latency_report(seconds: Sequence[float]) -> dict[str, float]:
    """mean, p50, p95, p99 in milliseconds (the value at place floor(n * p) of the sorted list) and queries a second."""
    ordered = sorted(seconds)
    if not ordered:
        return {"mean_ms": 0.0, "p50_ms": 0.0, "p95_ms": 0.0, "p99_ms": 0.0, "qps": 0.0}
    at = {f"p{round(p * 100)}_ms": ordered[min(len(ordered) - 1, math.floor(len(ordered) * p))] * 1000 for p in PERCENTILES}
    total = sum(ordered)
    return {"mean_ms": total / len(ordered) * 1000, **at, "qps": len(ordered) / total if total else 0.0}


def percentiles(df: DataFrame, value: str, by: str, points: Sequence[float] = PERCENTILES) -> DataFrame:
    """(by, n, p50, ...): the values at place floor(n * p) of each group's sorted values, nulls left out.

    Equal values are counted first. Approximate quantiles cut a group into ``BUCKETS`` ranges, sums of the ranges' counts tell in
    which of them a place is, and only those ranges are sorted, so that no task sorts a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    counts = counts.withColumn("k", F.coalesce(F.concat(F.lit("="), F.col("g").cast("string")), F.lit("")))
    edges = counts.groupBy("k").agg(F.percentile_approx("v", [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("edges"))
    ranged = counts.join(edges, "k").withColumn("b", F.size(F.filter("edges", lambda e: e < F.col("v")))).drop("edges")
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # of BUCKETS rows at most
    totals = ranged.groupBy("k", "b").agg(F.sum("c").alias("size"))
    totals = totals.withColumns({"below": F.coalesce(F.sum("size").over(before), F.lit(0)), "n": F.sum("size").over(Window.partitionBy("k"))})
    places = F.array(*[F.least(F.floor(F.col("n") * p) + 1, F.col("n")) for p in points])
    totals = totals.withColumn("places", places).filter(F.exists("places", lambda x: (x > F.col("below")) & (x <= F.col("below") + F.col("size"))))
    inside = Window.partitionBy("k", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.join(totals.select("k", "b", "below", "n", "places"), ["k", "b"]).withColumn("upto", F.col("below") + F.sum("c").over(inside))
    here = lambda i: (F.col("places")[i] > F.col("upto") - F.col("c")) & (F.col("places")[i] <= F.col("upto"))
    return found.groupBy(F.col("g").alias(by)).agg(F.max("n").alias("n"), *[F.max(F.when(here(i), F.col("v"))).alias(f"p{round(p * 100)}") for i, p in enumerate(points)])


def random_vector(dimension: int, seed: int | None = None, normalized: bool = True) -> list[float]:
    """Gaussian numbers, as a unit vector if ``normalized``."""
    rng = random.Random(seed)
    v = [rng.gauss(0.0, 1.0) for _ in range(dimension)]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if normalized and n > 0 else v


def with_random_vectors(df: DataFrame, dimension: int, seed: int = 42, normalized: bool = True, name: str = "vector") -> DataFrame:
    """``df`` with a column of Gaussian vectors, drawn on the executors."""
    drawn = df.withColumn(name, F.array(*[F.randn(seed + i) for i in range(dimension)]))
    return drawn.withColumn(name, normalize(F.col(name))) if normalized else drawn  # a step of its own: a draw is made once
